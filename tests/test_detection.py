"""Golden rows for the detection rules, peeling and tagging."""

from pyspark.sql import functions as F

from molcorpus.functions import smiles as S
from molcorpus.operators import annotate as A

CASES = [
    # token, previous word, verdict
    ("", None, False),
    (".,;", None, False),
    ("ISBN", None, False),
    ("COOKBOOK", None, False),
    ("CCOC", None, True),
    ("WXYZ", None, False),
    ("C.2", None, False),
    ("SS2.1", None, False),
    ("SC12", None, False),
    ("(IV)", None, False),
    ("VIII", None, False),
    ("NH3(g)", None, False),
    ("F/C", None, False),
    ("F/C=C/F", None, True),
    ("F/C=C\\F", None, True),
    ("C1CC", None, False),
    ("C1CC1", None, True),
    ("C12CC1C2", None, True),
    ("[13CH4]", None, True),
    ("c1ccccc1", None, True),
    ("ccc", None, False),
    ("1C1", None, False),
    ("C-3CC3", None, False),
    ("[Na-2]", None, True),
    ("C1-1", None, True),
    ("C-3CCCCCCC3", None, True),
    ("C-Abc", None, False),
    ("IF", "monofluoride", True),
    ("IF", "the", False),
    ("IF", None, False),
    ("CO", "(monoxide)", True),
    ("HF", "Acid,", True),
    ("Na", "sodium", True),
    ("Na", "Sodium,", True),
    ("Na", "the", False),
    ("Na", None, False),
    ("UFOs", None, False),
    ("Os", "osmium", True),
    ("Co", "cobalt", True),
    ("11", None, False),
    ("The", None, False),
    ("CCO", None, True),
    ("Cc", None, False),
    ("CCO.", None, True),
    ("H2SO4", None, False),
    ("C%12CCCC%12", None, True),
    ("C٣CC٣", None, True),
]


def test_is_smiles(spark):
    rows = [(i, t, p, v) for i, (t, p, v) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "i int, token string, prev string, verdict boolean")
    got = df.withColumn("got", S.is_smiles(F.col("token"), F.col("prev"))).filter("got <> verdict")
    assert [tuple(r) for r in got.collect()] == []


def test_element_names_can_be_switched_off(spark):
    df = spark.createDataFrame([("Na", "the")], "token string, prev string")
    verdict = S.is_smiles(F.col("token"), F.col("prev"), element_names=False)
    assert df.select(verdict).first()[0] is True


def test_peel(column):
    parts = A.peel(F.col("s"))
    words = ["(CC(=O)O),", "CC(=O)", "...", "[Na+].", "über!", "a_b;"]
    got = column(words, F.concat_ws("|", parts["prefix"], parts["core"], parts["suffix"]))
    assert got == ["(|CC(=O)O|),", "|CC(=O|)", "...||", "|[Na+]|.", "|über|!", "|a_b|;"]


def test_annotate(strings):
    texts = [
        "We saw (CCO), twice.\nThen C1CC1!",
        "[START_SMILES]CCO[END_SMILES] and Na sodium Na",
        "",
        None,
        "  plain   prose only ",
        "U.S. COOKBOOK NH3(g) SS2.1 (IV) U.S.",
    ]
    rows = sorted(A.annotate(strings(texts), "s").collect(), key=lambda r: r["doc_id"])
    assert [r["text_reannotated"] for r in rows] == [
        "We saw ([START_SMILES]CCO[END_SMILES]), twice. Then [START_SMILES]C1CC1[END_SMILES]!",
        "[START_SMILES]CCO[END_SMILES] and Na sodium [START_SMILES]Na[END_SMILES]",
        "",
        "",
        "plain prose only",
        "U.S. COOKBOOK NH3(g) SS2.1 (IV) U.S.",
    ]
    assert [r["reannotated_smiles_count"] for r in rows] == [2, 1, 0, 0, 0, 0]


def test_annotate_leaves_its_own_tags_alone(strings):
    once = A.annotate(strings(["CCO and (c1ccccc1)."]), "s", "once", "n1")
    twice = A.annotate(once, "once", "twice", "n2").first()
    assert twice["once"] == twice["twice"]
    assert (twice["n1"], twice["n2"]) == (2, 0)


def test_very_long_word(strings):
    row = A.annotate(strings(["C" * 50_000 + " x"]), "s").first()
    assert row["reannotated_smiles_count"] == 1


def test_review_answers_decide_before_later_rules(spark, strings):
    found = A.ambiguous_candidates(strings(["The IF is here"]), "doc_id", "s")
    assert {r["token"] for r in found.collect()} == {"The", "IF"}
    context = "The IF is here"
    verdicts = spark.createDataFrame(
        [("IF", context, "YES")], "token string, context string, answer string"
    )
    got = {r["token"]: r["is_smiles"] for r in A.apply_verdicts(found, verdicts).collect()}
    assert got == {"The": False, "IF": True}


def test_confusion(spark):
    df = spark.createDataFrame(
        [(1, "[START_SMILES]CCO[END_SMILES] [START_SMILES]N[END_SMILES]",
          "[START_SMILES] CCO [END_SMILES] [START_SMILES]O=C\n[END_SMILES] [START_SMILES]F[END_SMILES]")],
        "doc_id int, p string, t string",
    )
    row = A.confusion(df, "doc_id", "p", "t").first()
    assert (row["tp"], row["fp"], row["fn"]) == (1, 1, 1)
    assert (row["fp_set"], row["fn_set"]) == (["N"], ["F"])
