"""Queries on the rule tokenizers and their fertility."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from molcorpus.functions import patterns as P
from molcorpus.functions.tokenizers import TOKENIZERS
from molcorpus.operators import evaluate as E
from molcorpus.plans.detection import SEGMENTS_CTE, segments
from molcorpus.plans.registry import literal, query
from molcorpus.sources.samples import ANNOTATED_SQL

# --- SQL side: one list expression per tokenizer, over a column smi -----------


def _find(pattern: str) -> str:
    return f"regexp_extract_all(smi, {literal(pattern)})"


_ATOMS = _find(P.ATOM_TOKEN)
SIMPLE_SQL = {
    "character": _find(P.CHARACTER_TOKEN),
    "element": _find(P.ELEMENT_TOKEN),
    "element_plain": _find(P.ELEMENT_TOKEN),
    "atomwise": _ATOMS,
    "kmer": f"""CASE WHEN len({_ATOMS}) >= 4 THEN list_transform(range(len({_ATOMS}) - 3),
        lambda i: array_to_string({_ATOMS}[i + 1 : i + 4], ''))
      WHEN len({_ATOMS}) > 0 THEN {_ATOMS} ELSE [''] END""",
    "whitespace": _find(P.WORD_TOKEN_RE2),
}


def _positions(pattern: str, name: str) -> str:
    return f"""{name} AS (SELECT doc_id, seg, unnest(range(len(t))) AS pos, unnest(t) AS tok
      FROM (SELECT doc_id, seg, {_find(pattern)} AS t FROM segments))"""


_RING_SQL = "CASE WHEN regexp_matches(tok, '^%?[0-9]+$') THEN concat('RING', ltrim(tok, '%')) ELSE tok END"

RINGS_CTE = f"""{_positions(P.ELEMENT_TOKEN, 'ring_tokens')},
rings AS (
  SELECT doc_id, seg, list(CASE WHEN coalesce(last_mark, '') = '[' THEN tok ELSE {_RING_SQL} END
      ORDER BY pos) AS tokens
  FROM (SELECT *, last_value(CASE WHEN tok IN ('[', ']') THEN tok END IGNORE NULLS) OVER (
          PARTITION BY doc_id, seg ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING
        ) AS last_mark FROM ring_tokens)
  GROUP BY doc_id, seg)"""

_IS_RUN = (
    r"regexp_matches(tok, '^([bcnops0-9]|%[0-9]{2})$') OR "
    r"(tok[1] = '[' AND upper(tok) <> tok AND lower(tok) = tok)"
)
AROMATIC_CTE = f"""{_positions(P.BRACKET_ATOM_TOKEN, 'run_tokens')},
flagged AS (SELECT *, {_IS_RUN} AS goes_on, regexp_matches(tok, '^[bcnops]$') AS starts FROM run_tokens),
islands AS (SELECT *, sum(CASE WHEN goes_on THEN 0 ELSE 1 END) OVER (
    PARTITION BY doc_id, seg ORDER BY pos) AS island FROM flagged),
opened AS (SELECT *, min(CASE WHEN starts AND goes_on THEN pos END) OVER (
    PARTITION BY doc_id, seg, island) AS first_start FROM islands),
members AS (SELECT *, goes_on AND first_start IS NOT NULL AND pos >= first_start AS in_run FROM opened),
pieces AS (
  SELECT doc_id, seg, first_start AS pos, concat('AROM_RING:', string_agg(tok, '' ORDER BY pos)) AS tok
  FROM members WHERE in_run GROUP BY doc_id, seg, island, first_start
  UNION ALL
  SELECT doc_id, seg, pos, CASE WHEN tok[1] = '[' THEN tok ELSE {_RING_SQL} END
  FROM members WHERE NOT in_run),
aromatic_runs AS (SELECT doc_id, seg, list(tok ORDER BY pos) AS tokens FROM pieces GROUP BY doc_id, seg)"""

PAREN_CTE = f"""characters AS (SELECT doc_id, seg, unnest(range(length(smi))) AS pos,
    unnest(string_split(smi, '')) AS ch FROM segments),
running AS (SELECT *, sum(CASE ch WHEN '(' THEN 1 WHEN ')' THEN -1 ELSE 0 END) OVER (
    PARTITION BY doc_id, seg ORDER BY pos) AS total FROM characters),
depths AS (SELECT *, total - least(0, min(total) OVER (PARTITION BY doc_id, seg ORDER BY pos)) AS depth
  FROM running),
befores AS (SELECT *, lag(depth, 1, 0) OVER (PARTITION BY doc_id, seg ORDER BY pos) AS before FROM depths),
grouped AS (SELECT *, before > 0 OR ch = '(' AS inside,
    sum(CASE WHEN ch = '(' AND before = 0 THEN 1 ELSE 0 END) OVER (
      PARTITION BY doc_id, seg ORDER BY pos) AS grp FROM befores),
items AS (
  SELECT doc_id, seg, min(pos) AS pos, string_agg(ch, '' ORDER BY pos) AS item
  FROM grouped WHERE inside GROUP BY doc_id, seg, grp
  UNION ALL SELECT doc_id, seg, pos, ch FROM grouped WHERE NOT inside),
paren_groups AS (SELECT doc_id, seg, flatten(list(
    CASE WHEN prefix(item, '(') AND suffix(item, ')') THEN [item]
    ELSE regexp_extract_all(item, {literal(P.BRACKET_ATOM_TOKEN)}) END ORDER BY pos)) AS tokens
  FROM items GROUP BY doc_id, seg)"""

_SEGMENTS = f"WITH {ANNOTATED_SQL}, {SEGMENTS_CTE}"
_SHOW = "doc_id, seg, array_to_string(tokens, ' ') AS tokens, len(tokens)::BIGINT AS n_tokens"


def _simple_sql(name: str) -> str:
    return f"{_SEGMENTS} SELECT {_SHOW} FROM (SELECT *, {SIMPLE_SQL[name]} AS tokens FROM segments)"


def _cte_sql(cte: str, name: str) -> str:
    return f"""{_SEGMENTS}, {cte} SELECT {_SHOW} FROM (
      SELECT s.doc_id, s.seg, coalesce(t.tokens, []) AS tokens
      FROM segments s LEFT JOIN {name} t USING (doc_id, seg))"""


# --- Spark side ----------------------------------------------------------------


def _tokens(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tokens = TOKENIZERS[name](F.col("smi"))
    return (
        segments(spark, sf_dir)
        .select("doc_id", F.col("seg").cast("bigint").alias("seg"), tokens.alias("t"))
        .select("doc_id", "seg", F.array_join("t", " ").alias("tokens"),
                F.size("t").cast("bigint").alias("n_tokens"))
    )


@query(_simple_sql("character"))
def tok_character(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tokens(spark, sf_dir, "character")


@query(_simple_sql("element"))
def tok_element(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tokens(spark, sf_dir, "element")


@query(_cte_sql(PAREN_CTE, "paren_groups"))
def tok_paren_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tokens(spark, sf_dir, "paren_groups")


@query(_cte_sql(AROMATIC_CTE, "aromatic_runs"))
def tok_aromatic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tokens(spark, sf_dir, "aromatic_runs")


@query(_simple_sql("element_plain"))
def tok_element_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tokens(spark, sf_dir, "element_plain")


@query(_cte_sql(RINGS_CTE, "rings"))
def tok_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tokens(spark, sf_dir, "rings")


@query(_simple_sql("atomwise"))
def tok_atomwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tokens(spark, sf_dir, "atomwise")


@query(_simple_sql("kmer"))
def tok_kmer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tokens(spark, sf_dir, "kmer")


@query(_simple_sql("whitespace"))
def tok_whitespace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tokens(spark, sf_dir, "whitespace")


# --- Fertility -------------------------------------------------------------------


def stats_sql(group: str = "") -> str:
    by = f"{group}, " if group else ""
    quantile = "list_sort(list(n))[floor({} * count(*))::BIGINT + 1]::BIGINT"
    return f"""SELECT {by}count(*) AS total_smiles, sum(n)::BIGINT AS total_tokens,
      round(avg(n), 9) AS average_tokens, round(stddev_pop(n), 6) AS std_tokens,
      {quantile.format(0.5)} AS median_tokens, {quantile.format(0.25)} AS percentile_25,
      {quantile.format(0.75)} AS percentile_75, max(n)::BIGINT AS max_tokens,
      min(n)::BIGINT AS min_tokens, count(*) FILTER (WHERE n = 0) AS n_empty
    FROM counts {f'GROUP BY {group}' if group else ''}"""


@query(f"{_SEGMENTS}, counts AS (SELECT len({SIMPLE_SQL['element']}) AS n FROM segments) {stats_sql()}")
def fertility_element(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = TOKENIZERS["element"](F.col("smi"))
    return E.fertility(segments(spark, sf_dir), {"element": F.size(tokens)}).drop("tokenizer")


_ALL_COUNTS = " UNION ALL ".join(
    [f"SELECT '{n}' AS tokenizer, len({sql}) AS n FROM segments" for n, sql in SIMPLE_SQL.items()]
    + [
        f"SELECT '{n}', coalesce(len(t.tokens), 0) FROM segments LEFT JOIN {n} t USING (doc_id, seg)"
        for n in ("rings", "aromatic_runs", "paren_groups")
    ]
)


@query(
    f"{_SEGMENTS}, {RINGS_CTE}, {AROMATIC_CTE}, {PAREN_CTE}, counts AS ({_ALL_COUNTS}) "
    + stats_sql("tokenizer")
)
def fertility_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rule tokenizers in one pass over the segments."""
    sizes = {name: F.size(tokenize(F.col("smi"))) for name, tokenize in TOKENIZERS.items()}
    return E.fertility(segments(spark, sf_dir), sizes)


@query(
    f"""{_SEGMENTS}, counts AS (
      SELECT 'element' AS tokenizer, len({SIMPLE_SQL['element']}) AS n FROM segments
      UNION ALL SELECT 'bracket_only', len({_find(P.BRACKET)}) FROM segments)
    SELECT tokenizer, count(*) AS total_smiles, count(*) FILTER (WHERE n = 0) AS n_empty
    FROM counts GROUP BY tokenizer"""
)
def fertility_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tokenizer that finds nothing in some SMILES is reported, not hidden."""
    smi = F.col("smi")
    sizes = {
        "element": F.size(TOKENIZERS["element"](smi)),
        "bracket_only": F.size(F.regexp_extract_all(smi, F.lit(P.BRACKET), F.lit(0))),
    }
    return E.fertility(segments(spark, sf_dir), sizes).select("tokenizer", "total_smiles", "n_empty")
