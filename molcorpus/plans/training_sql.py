"""Learned tokenizers as recursive SQL: training one merge at a time, applying
merges in order, and walking along words by the longest token.

The training loop's table holds rows of three kinds: words (0) as strings of
private characters, symbols (1) as private character and token, and merges (2).
"""

from __future__ import annotations

from molcorpus.functions import patterns as P
from molcorpus.plans.registry import literal
from molcorpus.plans.tokenization import SIMPLE_SQL

SEGMENT_TOKENS = f"""segment_tokens AS (SELECT doc_id, seg, unnest(range(len(t))) AS pos, unnest(t) AS word
  FROM (SELECT doc_id, seg, regexp_extract_all(smi, {literal(P.WORD_TOKEN_RE2)}) AS t FROM segments)),
words AS (SELECT word, count(*) AS c, 0 AS doc_id, 0 AS seg FROM segment_tokens GROUP BY word)"""
SEGMENT_WORDS = """words AS (SELECT smi AS word, count(*) AS c, min({'d': doc_id, 's': seg})['d'] AS doc_id,
    min({'d': doc_id, 's': seg})['s'] AS seg FROM segments GROUP BY smi)"""

SPELLINGS = {
    "characters": "string_split(word, '')",
    "continued": "list_transform(string_split(word, ''), "
    "lambda x, i: CASE WHEN i > 1 THEN concat('##', x) ELSE x END)",
    "atoms": SIMPLE_SQL["atomwise"].replace("smi", "word"),
}


def multiplier_sql(tok: str, base: float, pattern: float, valid: float) -> str:
    outside = f"regexp_replace({tok}, {literal(P.BRACKET)}, '', 'g')"
    signs = f"list_transform(regexp_extract_all({outside}, '[()]'), lambda x: CASE x WHEN '(' THEN 1 ELSE -1 END)"
    balanced = (
        f"coalesce(list_sum({signs}), 0) = 0 AND coalesce(list_min(list_transform("
        f"range(1, len({signs}) + 1), lambda i: list_sum(({signs})[1:i]))), 0) >= 0"
    )
    rings = f"regexp_extract_all({outside}, '%[0-9]{{2}}|[0-9]')"
    odd = f"list_filter(list_distinct({rings}), lambda r: len(list_filter({rings}, lambda q: q = r)) % 2 = 1)"
    known = f"regexp_matches({tok}, {literal(f'^(?:{P.BRACKET_ATOM_TOKEN})+$')})"
    organic = f"regexp_matches({tok}, {literal(f'^(?:{P.ATOM_TOKEN})+$')})"
    dangling = (
        rf"(regexp_matches({tok}, '^[=#\-+.:~@/)(0-9%]') OR regexp_matches({tok}, '[=#\-+.:~@/(]$')"
        f" OR contains({tok}, '()') OR contains({tok}, '(('))"
    )
    ringless = f"(regexp_matches({outside}, '[bcnops]') AND NOT regexp_matches({outside}, '[0-9]'))"
    part = f"({known} AND {balanced} AND len({odd}) = 0 AND NOT {dangling})"
    return (
        f"CASE WHEN {part} AND {organic} AND NOT {ringless} THEN {valid!r}::DOUBLE "
        f"WHEN {part} THEN {pattern!r}::DOUBLE ELSE {base!r}::DOUBLE END"
    )


def training_cte(
    name: str,
    spelling: str,
    max_size: int,
    min_freq: int,
    specials: list[str] = P.SPECIAL_TOKENS,
    count_specials: bool = True,
    first_ties: bool = False,
    multiplier: str = "1",
) -> str:
    """CTEs from ``words (word, c, doc_id, seg)`` to ``<name>_merges``,
    ``<name>_vocab`` and ``<name>_frequencies``. ``multiplier`` is an expression
    over the column ``tok``."""
    n = name
    if spelling == "continued":  # plain letters of all words, then those that go on
        symbols = f"""SELECT DISTINCT unnest([sym, CASE WHEN pos > 1 THEN substr(sym, 3) ELSE sym END]) AS sym
          FROM {n}_spelled"""
        order, right = "(sym LIKE '##_%'), sym", "substr(r.tok, 3)"
    else:
        symbols = f"""SELECT sym, min({{'d': doc_id, 's': seg, 'p': pos}}) AS first
          FROM {n}_spelled GROUP BY sym"""
        order, right = "first" if first_ties else "sym", "r.tok"
    tie = "min({'d': doc_id, 's': seg, 'p': i})" if first_ties else "pair"
    extra = len(specials) if count_specials else 0
    size = f"(SELECT count(*) FROM {n}_loop WHERE kind = 1)"
    return f"""{n}_spelled AS (SELECT word, c, doc_id, seg, unnest(range(1, len(s) + 1)) AS pos, unnest(s) AS sym
  FROM (SELECT *, {SPELLINGS[spelling]} AS s FROM words)),
{n}_alphabet AS (SELECT sym, chr((2047 + row_number() OVER (ORDER BY {order}))::INTEGER) AS ch FROM ({symbols})),
{n}_coded AS (SELECT word, any_value(c) AS c, any_value(doc_id) AS doc_id, any_value(seg) AS seg,
    string_agg(ch, '' ORDER BY pos) AS w FROM {n}_spelled JOIN {n}_alphabet USING (sym) GROUP BY word),
{n}_loop AS (
  SELECT 0 AS step, 0 AS kind, w, c, doc_id, seg, NULL::VARCHAR AS tok FROM {n}_coded
  UNION ALL SELECT 0, 1, ch, NULL, NULL, NULL, sym FROM {n}_alphabet
  UNION ALL
  SELECT * FROM (
    WITH pairs AS (SELECT pair, sum(c)::BIGINT AS n, {tie} AS tie FROM (
        SELECT c, doc_id, seg, unnest(range(1, length(w))) AS i,
          unnest(list_transform(range(1, length(w)), lambda i: substr(w, i, 2))) AS pair
        FROM {n}_loop WHERE kind = 0) GROUP BY pair),
    named AS (SELECT pair, n, tie, concat(l.tok, {right}) AS tok FROM pairs
      JOIN {n}_loop l ON l.kind = 1 AND l.w = pair[1] JOIN {n}_loop r ON r.kind = 1 AND r.w = pair[2]),
    best AS (SELECT pair, n, tok FROM named ORDER BY n * {multiplier} DESC, tie LIMIT 1),
    target AS (SELECT pair, n, tok, (SELECT w FROM {n}_loop k WHERE k.kind = 1 AND k.tok = best.tok) AS existing,
        chr((2048 + {size})::INTEGER) AS fresh FROM best
      WHERE n >= {max(min_freq, 1)} AND {size} + {extra} < {max_size})
    SELECT step + 1, kind, CASE kind WHEN 0 THEN replace(w, t.pair, coalesce(t.existing, t.fresh)) ELSE w END,
      c, doc_id, seg, l.tok FROM {n}_loop l, target t WHERE kind < 2
    UNION ALL SELECT (SELECT max(step) + 1 FROM {n}_loop), 1, fresh, NULL, NULL, NULL, tok FROM target
      WHERE existing IS NULL
    UNION ALL SELECT (SELECT max(step) + 1 FROM {n}_loop), 2, pair, n, NULL, NULL, tok FROM target)),
{n}_symbols AS (SELECT w, tok FROM {n}_loop WHERE kind = 1 AND step = (SELECT max(step) FROM {n}_loop)),
{n}_merges AS (SELECT (step - 1)::BIGINT AS rank, l.tok AS "left", r.tok AS "right", m.tok AS token, m.c AS freq,
    m.w AS pair, s.w AS fused
  FROM {n}_loop m JOIN {n}_symbols l ON l.w = m.w[1] JOIN {n}_symbols r ON r.w = m.w[2]
  JOIN {n}_symbols s ON s.tok = m.tok WHERE m.kind = 2),
{n}_vocab AS (SELECT tok AS token, (unicode(w) - 2048 + {len(specials)})::BIGINT AS id FROM {n}_symbols
  UNION ALL SELECT unnest({specials}), unnest(range({len(specials)}))),
{n}_frequencies AS (SELECT token, sum(freq)::BIGINT AS freq FROM (
    SELECT sym AS token, sum(c) AS freq FROM {n}_spelled GROUP BY sym
    UNION ALL SELECT token, freq FROM {n}_merges) GROUP BY token)"""


def merged_cte(name: str) -> str:
    """``<name>_pieces (word, pos, token)``: all merges applied by rank. No two
    merges may make the same token."""
    n = name
    return f"""{n}_applied AS (
  SELECT 0 AS step, word, w FROM {n}_coded
  UNION ALL SELECT step + 1, word, replace(w, pair, fused) FROM {n}_applied JOIN {n}_merges ON rank = step),
{n}_pieces AS (
  SELECT word, pos, tok AS token FROM (
    SELECT word, unnest(range(length(w))) AS pos, unnest(string_split(w, '')) AS ch FROM {n}_applied
    WHERE step = (SELECT max(step) FROM {n}_applied)) JOIN {n}_symbols ON w = ch)"""


def walk_cte(name: str, tokens: str) -> str:
    """``<name>_pieces (word, pos, token)``: from each place of a word the longest
    piece of ``tokens (piece, at_start)`` (null: at any place), else one
    character as ``[UNK]``."""
    n = name
    return f"""{n}_tokens AS ({tokens}),
{n}_lengths AS (SELECT DISTINCT length(piece) AS len FROM {n}_tokens WHERE piece <> ''),
{n}_spots AS (SELECT word, pos, max(len) AS len FROM (
    SELECT word, pos, len, substr(word, pos, len) AS piece FROM (
      SELECT word, unnest(range(1, length(word) + 1)) AS pos FROM words), {n}_lengths
    WHERE pos + len - 1 <= length(word)) JOIN {n}_tokens USING (piece)
  WHERE at_start IS NULL OR at_start = (pos = 1) GROUP BY word, pos),
{n}_walk AS (
  SELECT word, 1::BIGINT AS pos FROM words
  UNION ALL SELECT word, pos + coalesce(len, 1) FROM {n}_walk LEFT JOIN {n}_spots USING (word, pos)
    WHERE pos <= length(word)),
{n}_pieces AS (SELECT word, pos, CASE WHEN len IS NULL THEN '[UNK]' ELSE substr(word, pos, len) END AS token
  FROM {n}_walk LEFT JOIN {n}_spots USING (word, pos) WHERE pos <= length(word))"""


def longest_match_cte(name: str, vocab: str) -> str:
    return walk_cte(name, f"SELECT token AS piece, NULL::BOOLEAN AS at_start FROM {vocab}")


def wordpiece_cte(name: str, vocab: str) -> str:
    """The same with continuing pieces; a word with an unknown place, or too long,
    is one ``[UNK]``."""
    n = name
    tokens = f"""SELECT CASE WHEN token LIKE '##_%' THEN substr(token, 3) ELSE token END AS piece,
      NOT token LIKE '##_%' AS at_start FROM {vocab}"""
    return f"""{walk_cte(f'{n}_raw', tokens)},
{n}_failed AS (SELECT word FROM {n}_raw_pieces GROUP BY word
  HAVING bool_or(token = '[UNK]') OR length(word) > 100),
{n}_pieces AS (
  SELECT word, pos, CASE WHEN pos > 1 THEN concat('##', token) ELSE token END AS token
  FROM {n}_raw_pieces WHERE word NOT IN (SELECT word FROM {n}_failed)
  UNION ALL SELECT word, 1, '[UNK]' FROM {n}_failed)"""
