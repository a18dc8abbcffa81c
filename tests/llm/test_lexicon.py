"""Ids and decoded texts against the tokenizer library; the transducer against plain tables."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import tokenizers

from molcorpus.llm import lexicon

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def rules():
    return lexicon.Rules(PATH)


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(PATH)


def sha(data):
    return hashlib.sha256(data).hexdigest()


def check(row, text, library):
    ids = library.encode(text or "", add_special_tokens=False).ids
    assert row["n_tokens"] == len(ids), text
    assert row["ids_sha256"] == sha(np.array(ids, "<u4").tobytes())
    assert row["decoded_sha256"] == sha(library.decode(ids, skip_special_tokens=False).encode())
    if "ids" in row:
        assert row["ids"] == ids


def texts():
    draw = random.Random(5)
    letters = "abcdeABC ééÉß中\n\t 0123 !?'s\U0001f600 ́ΣσİǅﬁΩẞ \x85\x1c<|>"
    own = ["".join(draw.choices(letters, k=draw.randint(0, 300))) for _ in range(300)]
    own += ["a" * 5000, " " * 700, "ab" * 900, "supercalifragilistic" * 20, "\n" * 90, "DON'T we'll I'M o'clock 'Twas"]
    own += ["ΟΔΥΣΣΕΥΣ ΣΑΣ", "é<|endoftext|>́x", "a<|startoftext|><|endoftext|>", "<|endoftext", "한국어 텍스트", "!!!???...", "हिन्दी पाठ"]
    return own + ["the quick brown fox jumps over the lazy dog"] * 5


@pytest.mark.parametrize("size", [0, 3, 1000])
def test_equals_the_library(documents, rules, library, size):
    own = texts()
    docs = documents(own)
    rows = lexicon.encode(docs, rules, lexicon.build(docs, rules, size=size)).collect()
    assert len(rows) == len(own)
    for r in rows:
        check(r.asDict(), own[r["doc_id"]], library)
        assert lexicon.decode(rules, r["ids"]) == library.decode(r["ids"], skip_special_tokens=False)


def test_awkward_rows(awkward, no_rows, rules, library):
    name = lexicon.build(awkward, rules)
    rows = lexicon.encode(awkward, rules, name, keep=["text", "score", "n"]).collect()
    assert len(rows) == 12
    for r in rows:
        check(r.asDict(), r["text"], library)
        assert r["score"] == 0.5
    clashing = awkward.withColumnRenamed("id", "ids").withColumnRenamed("n", "_0").withColumnRenamed("source", "_text")
    for r in lexicon.encode(clashing, rules, name, key="lang", text="text").collect():
        assert set(r.asDict()) == {"lang", "n_tokens", "ids", "ids_sha256", "decoded_sha256"}
    empty = lexicon.build(no_rows, rules)
    assert lexicon.encode(no_rows, rules, empty).collect() == []
    assert len(lexicon.encode(awkward, rules, empty).collect()) == 12


def test_frequent_words_are_those_of_all_texts(documents, rules):
    counts = {r["word"]: r["n"] for r in lexicon.word_counts(documents(["a b a", "A <|endoftext|> c'll", None, "x" * 65]), rules).collect()}
    assert counts == {"a": 3, "b": 1, "c": 1, "'ll": 1}


def test_transducer_holds_what_it_was_given(tmp_path):
    draw = random.Random(9)
    entries = {}
    for _ in range(3000):
        word = bytes(draw.choices(b"abc", k=draw.randint(1, 8)))
        entries[word] = tuple(draw.choices(range(4), k=draw.randint(1, 4)))
    machine = lexicon.compile_words(list(entries.items()))
    path = tmp_path / "machine"
    path.write_bytes(machine.to_bytes())
    mapped = lexicon.Transducer.open(str(path))
    asked = [bytes(draw.choices(b"abcd", k=draw.randint(0, 9))) for _ in range(4000)] + list(entries) + [b"a" * 100]
    held, ids, count = mapped.walk(asked)
    places = np.concatenate([[0], np.cumsum(count)])
    for i, word in enumerate(asked):
        assert held[i] == (word in entries)
        assert tuple(ids[places[i] : places[i + 1]]) == entries.get(word, ())


def test_transducer_is_minimal():
    """Words of one ending and one residual output share all states of the ending."""
    words = [(b"walking", (1, 9)), (b"talking", (2, 9)), (b"stalking", (3, 9))]
    machine = lexicon.compile_words(words)
    # root, "s", "st" and then the shared "alking": one state after each of its letters and before
    assert len(machine.last) == 1 + 1 + 7
    plain = lexicon.compile_words([(w, (0,)) for w in (b"a", b"b", b"ab", b"bb")])
    assert len(plain.last) == 3
    assert lexicon.compile_words([]).walk([b"a", b""])[0].tolist() == [False, False]


def test_long_and_short_words_merge_alike(rules):
    draw = random.Random(4)
    words = ["".join(draw.choices("theandingstr", k=draw.randint(1, 60))).encode() for _ in range(300)]
    ids, places = rules.merge(words)
    for i, w in enumerate(words):
        assert ids[places[i] : places[i + 1]].tolist() == rules.merge_long(w)


def test_every_assigned_character_is_classed_alike(rules, library):
    """All assigned characters in one text each block: words and lower case as in the library."""
    import unicodedata

    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) not in ("Cn", "Co")]
    own = ["".join(f"a{chr(c)}0{chr(c)}!" for c in points[i : i + 500]) for i in range(0, len(points), 500)]
    empty = lexicon.compile_words([])
    for text in own:
        sizes, which, distinct = lexicon._words_of(rules, pa.array([text]))
        flat, places = lexicon.encode_words(rules, empty, distinct)
        got = [t for w in which.tolist() for t in flat[places[w] : places[w + 1]].tolist()]
        assert got == library.encode(text, add_special_tokens=False).ids
