"""Rule tokenizers: string Column in, array-of-tokens Column out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from molcorpus.functions import patterns as P
from molcorpus.functions.text import bind, find_all

# Marks the start of each token when a token list is handled as one string.
MARK = "\u0001"


def tok_character(smi: Column) -> Column:
    return find_all(smi, P.CHARACTER_TOKEN)


def tok_element(smi: Column) -> Column:
    """Brackets, elements (longest first), aromatics, bonds and digits; other
    characters vanish, a single backslash among them."""
    return find_all(smi, P.ELEMENT_TOKEN_JAVA)


def tok_element_plain(smi: Column) -> Column:
    return tok_element(smi)


def tok_atomwise(smi: Column) -> Column:
    return find_all(smi, P.ATOM_TOKEN)


def tok_whitespace(text: Column) -> Column:
    """Runs of word characters and runs of other visible characters."""
    return find_all(text, P.WORD_TOKEN_JAVA)


def tok_kmer(smi: Column, k: int = 4, stride: int = 1) -> Column:
    """Full windows of k atoms; single atoms when too short; one empty token
    when there are no atoms."""

    def windows(atoms: Column) -> Column:
        n = F.size(atoms)
        starts = F.when(n >= k, F.sequence(F.lit(1), n - (k - 1), F.lit(stride)))
        full = F.transform(starts, lambda i: F.array_join(F.slice(atoms, i, k), ""))
        return F.when(n >= k, full).when(n > 0, atoms).otherwise(F.array(F.lit("")))

    return bind(tok_atomwise(smi), windows)


def _marked(tokens: Column) -> Column:
    return F.concat(F.lit(MARK), F.array_join(tokens, MARK))


def _ring(token: Column) -> Column:
    return (
        F.when(token.rlike("^%?[0-9]+$"), F.concat(F.lit("RING"), F.ltrim(token, F.lit("%"))))
        .otherwise(token)
    )


def tok_aromatic_runs(smi: Column) -> Column:
    """A run that starts at an aromatic letter and goes on over lowercase tokens
    and ring numbers becomes one token; other ring numbers are renamed."""
    lower_bracket = r"\[[^\]\p{Lu}\p{Lt}]*\p{Ll}[^\]\p{Lu}\p{Lt}]*\]"
    goes_on = f"[{P.AROMATICS}0-9]|{P.RING_NUMBER}|{lower_bracket}"
    run = f"{MARK}[{P.AROMATICS}](?:{MARK}(?:{goes_on}))*+"
    marked = _marked(find_all(smi, P.BRACKET_ATOM_TOKEN_JAVA))
    pieces = find_all(marked, f"{run}|{MARK}[^{MARK}]+")
    return F.transform(
        pieces,
        lambda p: F.when(
            p.rlike(f"^{MARK}[{P.AROMATICS}]"),
            F.concat(F.lit("AROM_RING:"), F.replace(p, F.lit(MARK), F.lit(""))),
        ).otherwise(_ring(F.substring(p, 2, 1 << 30))),
    )


def tok_rings(smi: Column) -> Column:
    """Element tokens with ring numbers renamed outside square brackets."""
    marked = _marked(tok_element(smi))
    bracketed = rf"{MARK}\[(?:{MARK}[^{MARK}\]]+)*+(?:{MARK}\])?"
    pieces = find_all(marked, f"{bracketed}|{MARK}[^{MARK}]+")
    return F.flatten(
        F.transform(
            pieces,
            lambda p: F.when(
                p.startswith(f"{MARK}["), F.split(F.substring(p, 2, 1 << 30), MARK)
            ).otherwise(F.array(_ring(F.substring(p, 2, 1 << 30)))),
        )
    )


def tok_paren_groups(smi: Column) -> Column:
    """Each outermost ``( ... )`` group is one token. Outside groups characters
    are taken one at a time, so only one-character tokens occur there."""
    characters = find_all(smi, "(?s).")
    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("text"))

    def step(state: Column, ch: Column) -> Column:
        opens = (ch == "(").cast("int")
        closes = ((ch == ")") & (state["depth"] > 0)).cast("int")
        depth = state["depth"] + opens - closes
        before = F.when((opens == 1) & (state["depth"] == 0), MARK).otherwise("")
        after = F.when((closes == 1) & (depth == 0), MARK).otherwise("")
        return F.struct(
            depth.alias("depth"), F.concat(state["text"], before, ch, after).alias("text")
        )

    separated = F.aggregate(characters, start, step)["text"]
    pieces = F.array_remove(F.split(separated, MARK), "")
    return F.flatten(
        F.transform(
            pieces,
            lambda p: F.when(p.startswith("(") & p.endswith(")"), F.array(p))
            .when(p.startswith("("), find_all(p, P.BRACKET_ATOM_TOKEN_JAVA))
            .otherwise(find_all(p, P.ONE_CHARACTER_TOKEN)),
        )
    )


# Names under which a tokenizer is picked.
TOKENIZERS: dict[str, Callable[[Column], Column]] = {
    "character": tok_character,
    "element": tok_element,
    "paren_groups": tok_paren_groups,
    "aromatic_runs": tok_aromatic_runs,
    "element_plain": tok_element_plain,
    "rings": tok_rings,
    "atomwise": tok_atomwise,
    "kmer": tok_kmer,
    "whitespace": tok_whitespace,
}
