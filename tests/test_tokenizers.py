"""Golden rows for extraction and the rule tokenizers."""

from pyspark.sql import functions as F

from molcorpus.functions import tokenizers as T
from molcorpus.operators import extract as X

S = F.col("s")


def test_extract_segments(strings):
    texts = [
        "a [START_SMILES] CCO [END_SMILES] b [START_SMILES]N\n[END_SMILES]",
        "[START_SMILES]  [END_SMILES] [START_SMILES]open",
        "",
        None,
        "[START_SMILES] C [END_SMILES]",
    ]
    rows = X.extract_segments(strings(texts), "doc_id", "s").collect()
    assert [(r["doc_id"], r["seg"], r["smi"]) for r in rows] == [(0, 0, "CCO"), (0, 1, "N"), (4, 0, "C")]


def test_segment_set_is_for_one_line(column):
    texts = ["[START_SMILES]C[END_SMILES][START_SMILES] C [END_SMILES][START_SMILES]N\n[END_SMILES]", None]
    assert column(texts, X.segment_set(S)) == [["C"], []]


def test_character(column):
    assert column(["C\nl", "a\r\U0001f9ea", ""], T.tok_character(S)) == [
        ["C", "l"], ["a", "\r", "\U0001f9ea"], [],
    ]


def test_element(column):
    smiles = ["F/C=C\\F", "a\\\\b", "CSc1Cn1", "C%12Q[se]"]
    assert column(smiles, T.tok_element(S)) == [
        ["F", "/", "C", "=", "C", "F"],
        ["\\\\", "b"],
        ["C", "Sc", "1", "Cn", "1"],
        ["C", "%12", "[", "s", "]"],
    ]


def test_paren_groups(column):
    smiles = ["CC(=O)(N(C))Cl", "C(C", "C((C)", "C)C", "C(Cl[Na+]", "[Na](C)%12"]
    assert column(smiles, T.tok_paren_groups(S)) == [
        ["C", "C", "(=O)", "(N(C))", "C"],
        ["C", "(", "C"],
        ["C", "((C)"],
        ["C", ")", "C"],
        ["C", "(", "Cl", "[Na+]"],
        ["N", "(C)", "1", "2"],
    ]


def test_aromatic_runs(column):
    smiles = ["Oc1ccc[se]1C2", "[se]c1", "c%12nC%12", "C1CC1", "1[nH]c"]
    assert column(smiles, T.tok_aromatic_runs(S)) == [
        ["O", "AROM_RING:c1ccc[se]1", "C", "RING2"],
        ["[se]", "AROM_RING:c1"],
        ["AROM_RING:c%12n", "C", "RING12"],
        ["C", "RING1", "C", "C", "RING1"],
        ["RING1", "[nH]", "AROM_RING:c"],
    ]


def test_rings(column):
    smiles = ["C1[13C]C%12", "[C1", "1]2"]
    assert column(smiles, T.tok_rings(S)) == [
        ["C", "RING1", "[", "1", "3", "C", "]", "C", "RING12"],
        ["[", "C", "1"],
        ["RING1", "]", "RING2"],
    ]


def test_atomwise(column):
    assert column(["[Na+]BrCCl%11Si"], T.tok_atomwise(S)) == [
        ["[Na+]", "Br", "C", "Cl", "%11", "S"]
    ]


def test_kmer(column):
    smiles = ["CCOCN", "CCO", "", "Q"]
    assert column(smiles, T.tok_kmer(S)) == [["CCOC", "COCN"], ["C", "C", "O"], [""], [""]]
    assert column(["CCOCNF"], T.tok_kmer(S, 4, 2)) == [["CCOC", "OCNF"]]


def test_whitespace(column):
    assert column(["CC(=O)N1 é²"], T.tok_whitespace(S)) == [["CC", "(=", "O", ")", "N1", "é", "²"]]


def test_wrap_and_null_labels(spark):
    df = spark.createDataFrame([(1, 1.0), (2, None), (3, float("nan"))], "k int, label double")
    assert [r["k"] for r in X.drop_null_labels(df, "label").collect()] == [1]
    row = X.null_label_count(df, "label").first()
    assert (row["n_dropped"], row["n_kept"]) == (2, 1)


def test_elements_for_java_fail_at_once_and_find_the_same(spark):
    """Prose letters are not tried against every element."""
    from molcorpus.functions import patterns as P

    found = [P.ELEMENT_TOKEN_JAVA, P.BRACKET_ATOM_TOKEN_JAVA, P.DETECTION_WHOLE_JAVA, P.CANDIDATE_WORD_JAVA]
    assert all(P.ELEMENT_JAVA in p for p in found) and P.ELEMENT_JAVA.startswith("(?=[A-Z])")
    texts = ["CScCaXuUuoéÉ[Na+]C%12(=O)", "Sn1 Co Cof Ag AgQ q", "The ISBN of Brown", "", *P.ELEMENTS, *(e + "x" for e in P.ELEMENTS)]
    rows = spark.createDataFrame([(t,) for t in texts], "s string")
    pairs = [(P.ELEMENT_TOKEN_JAVA, P.ELEMENT_TOKEN), (P.BRACKET_ATOM_TOKEN_JAVA, P.BRACKET_ATOM_TOKEN)]
    for java, plain in pairs:
        both = rows.select(F.regexp_extract_all("s", F.lit(java), F.lit(0)), F.regexp_extract_all("s", F.lit(plain), F.lit(0)))
        assert all(a == b for a, b in both.collect())
