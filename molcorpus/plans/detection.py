"""Queries on finding and checking SMILES in text."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from molcorpus.functions import patterns as P
from molcorpus.functions import smiles as S
from molcorpus.functions.text import entries
from molcorpus.functions.text import words as split_text
from molcorpus.operators import annotate as A
from molcorpus.operators import extract as X
from molcorpus.plans.registry import literal, query
from molcorpus.sources.samples import ANNOTATED_SQL, annotated, table

# --- SQL side ----------------------------------------------------------------


def words_sql(relation: str, col: str) -> str:
    """(doc_id, pos, word, prev) of a text column."""
    return f"""
    SELECT doc_id, unnest(range(len(w))) AS pos, unnest(w) AS word,
           unnest(list_concat([NULL], w))  AS prev
    FROM (SELECT doc_id, list_filter(regexp_split_to_array({col}, {literal(P.SPACES)}),
                 lambda x: x <> '') AS w FROM {relation})
    """


def words_cte(relation: str, col: str) -> str:
    return f"words AS (SELECT * FROM ({words_sql(relation, col)}) WHERE word IS NOT NULL)"


_PREV = f"lower(trim(prev, {literal(P.PREVIOUS_PUNCTUATION)}))"
_NO_BRACKETS = r"regexp_replace(c, '\[.*?\]', '', 'g')"
_BARE = f"regexp_replace(c, {literal(P.BRACKET + '|' + P.ELEMENT)}, '', 'g')"
_ELEMENT_CASE = " ".join(
    f"WHEN '{s}' THEN '{n.lower()}'" for s, n in P.ELEMENT_NAMES.items()
)

RULES_SQL = {
    "empty": "c = ''",
    "stop_word": "c IN (" + ", ".join(literal(w) for w in P.STOP_WORDS) + ")",
    "acronym": "regexp_matches(c, '^[A-Z]{4,}$') AND NOT regexp_matches(c, '^[CNOPSFI]+$')",
    "dot_digit": r"regexp_matches(c, '\.\p{Nd}')",
    "section_code": r"regexp_matches(c, '^(SS|SC)\p{Nd}+(\.\p{Nd}+)*$')",
    "roman": r"regexp_matches(c, '^\(?(?:I{1,3}|IV|VI{0,3}|IX)\)?$')",
    "state_suffix": "suffix(c, '(s)') OR suffix(c, '(l)') OR suffix(c, '(g)')"
    " OR suffix(c, '(aq)') OR suffix(c, '.s')",
    "slash_without_double_bond": "(contains(c, '/') OR contains(c, chr(92))) AND NOT contains(c, '=')",
    "odd_ring_digit": " OR ".join(
        f"(length({_NO_BRACKETS}) - length(replace({_NO_BRACKETS}, '{d}', ''))) % 2 = 1"
        for d in range(10)
    ),
    "no_capital_or_digit": r"NOT regexp_matches(c, '[A-Z\p{Nd}]')",
    "starts_with_digit": r"regexp_matches(c, '^\p{Nd}')",
    "dash_digit": r"regexp_matches(c, '-\p{Nd}')"
    r" AND NOT (regexp_matches(c, '\[[^\]]*-\p{Nd}[^\]]*\]')"
    r" OR regexp_matches(c, '\p{Nd}-\p{Nd}') OR length(c) > 8)",
    "dash_word": "regexp_matches(c, '-[A-Z][a-z]{2,}')",
    "formula_without_context": "CASE c "
    + " ".join(
        f"WHEN '{f}' THEN NOT coalesce("
        + " OR ".join(f"suffix({_PREV}, '{e}')" for e in endings)
        + ", false)"
        for f, endings in P.CONTEXT_SUFFIXES.items()
    )
    + " ELSE false END",
    "element_without_name": f"coalesce((CASE c {_ELEMENT_CASE} END) IS NOT NULL AND "
    f"NOT coalesce({_PREV} = (CASE c {_ELEMENT_CASE} END), false), false)",
    "plural_acronym": "suffix(c, 's') AND upper(c[:-2]) = c[:-2] AND lower(c[:-2]) <> c[:-2]"
    " AND c NOT IN (" + ", ".join(literal(e) for e in P.ELEMENTS) + ")"
    r" AND NOT regexp_matches(c, '[\p{Nd}=#\-+()\[\]]')",
    "no_letter": "NOT regexp_matches(c, '[a-zA-Z]')",
    "outside_grammar": f"NOT regexp_matches(c, {literal(P.DETECTION_WHOLE)})",
    "aromatic_letters_only": f"regexp_matches({_BARE}, '[bcnops]') AND NOT ("
    f"regexp_matches({_BARE}, {literal(P.DETECTION_SPECIAL)}) OR "
    f"regexp_matches(c, {literal(P.BRACKET)}))",
}

_CORE_SQL = f"regexp_replace(word, {literal(P.PEEL_ENDS)}, '', 'g')"
_CLEAN_SQL = f"trim({{}}, {literal(P.TOKEN_PUNCTUATION)})"


def rejected_sql(names: list[str] | None = None) -> str:
    return " OR ".join(f"({RULES_SQL[n]})" for n in names or RULES_SQL)


TAGGED_WORDS_CTE = f"""
cores AS (SELECT doc_id, pos, word, prev, {_CORE_SQL} AS core,
            contains(word, '[START_SMILES]') AND contains(word, '[END_SMILES]') AS already
          FROM words),
verdicts AS (SELECT *, NOT already AND NOT ({rejected_sql()}) AS hit
             FROM (SELECT *, core AS c FROM cores)),
reannotated AS (
  SELECT doc_id,
    string_agg(CASE WHEN hit THEN concat(
        regexp_extract(word, {literal(P.PEEL_START)}), '[START_SMILES]', core, '[END_SMILES]',
        substr(word, length(regexp_extract(word, {literal(P.PEEL_START)})) + length(core) + 1))
      ELSE word END, ' ' ORDER BY pos) AS text_reannotated,
    count(*) FILTER (WHERE hit) AS reannotated_smiles_count
  FROM verdicts GROUP BY doc_id)"""


def _set_sql(col: str) -> str:
    return (
        f"list_distinct(list_transform(regexp_extract_all({col}, "
        f"{literal(P.TAGGED_ONE_LINE)}, 1), lambda x: regexp_replace(x, {literal(P.STRIP)}, '', 'g')))"
    )


ANNOTATED_WORDS = f"WITH {ANNOTATED_SQL}, {words_cte('annotated', 'text_raw')}, {TAGGED_WORDS_CTE}"
_CONFUSION = f"""{ANNOTATED_WORDS},
pairs AS (SELECT a.doc_id, {_set_sql('r.text_reannotated')} AS p, {_set_sql('a.text_tags')} AS t
          FROM annotated a JOIN reannotated r USING (doc_id)),
sets AS (SELECT doc_id, list_filter(p, lambda x: list_contains(t, x)) AS tp_set,
           list_filter(p, lambda x: NOT list_contains(t, x)) AS fp_set,
           list_filter(t, lambda x: NOT list_contains(p, x)) AS fn_set FROM pairs),
confusion AS (SELECT doc_id, len(tp_set)::BIGINT AS tp, len(fp_set)::BIGINT AS fp,
                len(fn_set)::BIGINT AS fn, fp_set, fn_set FROM sets)"""

# --- Spark side --------------------------------------------------------------


def reannotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.annotate(annotated(spark, sf_dir), "text_raw")


def _confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.confusion(reannotated(spark, sf_dir), "doc_id", "text_reannotated", "text_tags")


@query(f"WITH {ANNOTATED_SQL}, {words_cte('annotated', 'text_raw')} SELECT doc_id, pos, word FROM words")
def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.split_words(annotated(spark, sf_dir), "doc_id", "text_raw").withColumn(
        "pos", F.col("pos").cast("bigint")
    )


@query(
    f"""WITH {ANNOTATED_SQL}, {words_cte('annotated', 'text_raw')}
    SELECT word, regexp_extract(word, {literal(P.PEEL_START)}) AS prefix, {_CORE_SQL} AS core,
      substr(word, length(regexp_extract(word, {literal(P.PEEL_START)})) + length({_CORE_SQL}) + 1) AS suffix,
      count(*) AS n
    FROM words GROUP BY word"""
)
def peel(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = A.split_words(annotated(spark, sf_dir), "doc_id", "text_raw")
    distinct = split.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return distinct.select("word", "n", *[c.alias(n) for n, c in A.peel(F.col("word")).items()])


@query(
    f"""WITH {ANNOTATED_SQL}, {words_cte('annotated', 'text_raw')}
    SELECT doc_id, pos, word, lag(word) OVER (PARTITION BY doc_id ORDER BY pos) AS prev,
      string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY pos
        ROWS BETWEEN 7 PRECEDING AND 2 FOLLOWING) AS context
    FROM words"""
)
def context_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.with_context(annotated(spark, sf_dir), "doc_id", "text_raw").withColumn(
        "pos", F.col("pos").cast("bigint")
    )


@query(
    f"""WITH {ANNOTATED_SQL}, {words_cte('annotated', 'text_raw')},
    pairs AS (SELECT word AS token, prev, count(*) AS n FROM words GROUP BY word, prev)
    SELECT token, prev, n, {', '.join(f'({sql}) AS {name}' for name, sql in RULES_SQL.items())},
      NOT ({rejected_sql()}) AS is_smiles
    FROM (SELECT *, {_CLEAN_SQL.format('token')} AS c FROM pairs)"""
)
def is_smiles_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rule on its own for each distinct (word, previous word)."""
    split = annotated(spark, sf_dir).select(split_text(F.col("text_raw")).alias("w"))
    pairs = (
        entries(split, ["w"], "w", "pos", "token")
        .select("token", F.get("w", F.col("pos") - 1).alias("prev"))
        .groupBy("token", "prev")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("c", S.clean(F.col("token")))
    )
    rules = S.rejections(F.col("c"), F.col("prev"))
    ruled = pairs.select("token", "prev", "n", *[rule.alias(name) for name, rule in rules.items()])
    return ruled.withColumn("is_smiles", ~reduce(or_, (F.col(name) for name in rules)))


@query(f"{ANNOTATED_WORDS} SELECT * FROM reannotated")
def annotate_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reannotated(spark, sf_dir).select(
        "doc_id", "text_reannotated", "reannotated_smiles_count"
    )


@query(
    f"{ANNOTATED_WORDS} SELECT a.*, r.text_reannotated, r.reannotated_smiles_count "
    "FROM annotated a JOIN reannotated r USING (doc_id)"
)
def reannotate_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reannotated(spark, sf_dir)


_REVIEW = f"""WITH {ANNOTATED_SQL}, {words_cte('annotated', 'text_raw')},
context AS (
  SELECT doc_id, pos, prev, word, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY pos
    ROWS BETWEEN 7 PRECEDING AND 2 FOLLOWING) AS context FROM words),
candidates AS (
  SELECT doc_id, pos, c AS token, prev, context, c
  FROM (SELECT *, {_CLEAN_SQL.format(_CORE_SQL)} AS c FROM context)
  WHERE length(c) <= 6 AND NOT (contains(word, '[START_SMILES]') AND contains(word, '[END_SMILES]'))
    AND NOT ({rejected_sql(list(S.RULES_BEFORE_REVIEW))}))"""


@query(f"{_REVIEW} SELECT doc_id, pos, token, prev, context FROM candidates")
def ambiguous_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.ambiguous_candidates(annotated(spark, sf_dir), "doc_id", "text_raw").withColumn(
        "pos", F.col("pos").cast("bigint")
    )


@query(
    f"""{_REVIEW},
    reviewed AS (SELECT *, CASE substr(md5(concat(token, context)), 1, 1)
        WHEN '0' THEN 'YES' WHEN '1' THEN 'NO' END AS answer FROM candidates)
    SELECT doc_id, pos, token, CASE answer WHEN 'YES' THEN true WHEN 'NO' THEN false
      ELSE NOT ({rejected_sql([n for n in RULES_SQL if n not in S.RULES_BEFORE_REVIEW])}) END AS is_smiles
    FROM reviewed"""
)
def reviewed_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates after a review that answered for some of them (by hash)."""
    candidates = A.ambiguous_candidates(annotated(spark, sf_dir), "doc_id", "text_raw")
    first = F.substring(F.md5(F.concat("token", "context")), 1, 1)
    verdicts = candidates.select(
        "token", "context", F.when(first == "0", "YES").when(first == "1", "NO").alias("answer")
    ).filter("answer IS NOT NULL")
    return A.apply_verdicts(candidates, verdicts).select(
        "doc_id", F.col("pos").cast("bigint").alias("pos"), "token", "is_smiles"
    )


@query(f"{_CONFUSION} SELECT doc_id, tp, fp, fn FROM confusion")
def confusion_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _confusion(spark, sf_dir).select("doc_id", "tp", "fp", "fn")


@query(
    f"{_CONFUSION} SELECT sum(tp)::BIGINT AS total_tp, sum(fp)::BIGINT AS total_fp, "
    "sum(fn)::BIGINT AS total_fn FROM confusion"
)
def confusion_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.confusion_totals(_confusion(spark, sf_dir))


def _top_sql(side: str) -> str:
    return (
        f"{_CONFUSION} SELECT smiles, count(*) AS freq FROM (SELECT unnest({side}_set) AS smiles "
        "FROM confusion) GROUP BY smiles ORDER BY freq DESC, smiles LIMIT 1000"
    )


@query(_top_sql("fp"))
def top_false_positives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.top_errors(_confusion(spark, sf_dir), "fp")


@query(_top_sql("fn"))
def top_false_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.top_errors(_confusion(spark, sf_dir), "fn")


@query(
    f"""{ANNOTATED_WORDS} SELECT a.doc_id,
      len(regexp_extract_all(a.text_tags, {literal(P.TAGGED)}))::BIGINT AS stored,
      r.reannotated_smiles_count AS recomputed,
      (r.reannotated_smiles_count - len(regexp_extract_all(a.text_tags, {literal(P.TAGGED)})))::BIGINT
        AS difference
    FROM annotated a JOIN reannotated r USING (doc_id)"""
)
def smiles_count_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = F.size(F.regexp_extract_all("text_tags", F.lit(P.TAGGED), F.lit(0)))
    return A.count_check(
        reannotated(spark, sf_dir).withColumn("stored_count", stored),
        "doc_id", "stored_count", "reannotated_smiles_count",
    )


# --- Extraction ---------------------------------------------------------------

SEGMENTS_CTE = f"""
found AS (SELECT doc_id, list_filter(list_transform(
    regexp_extract_all(text_tags, {literal(P.TAGGED)}, 1),
    lambda x: regexp_replace(x, {literal(P.STRIP)}, '', 'g')), lambda x: x <> '') AS s FROM annotated),
segments AS (SELECT doc_id, unnest(range(len(s))) AS seg, unnest(s) AS smi FROM found)"""


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.extract_segments(annotated(spark, sf_dir), "doc_id", "text_tags")


@query(f"WITH {ANNOTATED_SQL}, {SEGMENTS_CTE} SELECT doc_id, seg, smi FROM segments")
def extract_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments(spark, sf_dir).withColumn("seg", F.col("seg").cast("bigint"))


@query(
    f"""WITH {ANNOTATED_SQL}
    SELECT doc_id, unnest({_set_sql('text_tags')}) AS smi FROM annotated"""
)
def segment_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotated(spark, sf_dir).select(
        "doc_id", F.explode(X.segment_set(F.col("text_tags"))).alias("smi")
    )


@query("SELECT text FROM documents")
def normalise_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.normalise_text(table(spark, sf_dir, "documents"), "text")
