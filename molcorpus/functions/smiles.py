"""The rules that decide whether a word is a SMILES string, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from molcorpus.functions import patterns as P
from molcorpus.functions.text import bind

RULES_BEFORE_REVIEW = (
    "empty", "stop_word", "acronym", "dot_digit", "section_code", "roman",
    "state_suffix", "slash_without_double_bond", "odd_ring_digit",
    "no_capital_or_digit", "starts_with_digit",
)


def clean(token: Column) -> Column:
    return F.btrim(token, F.lit(P.TOKEN_PUNCTUATION))


def _previous(prev: Column) -> Column:
    return F.lower(F.btrim(prev, F.lit(P.PREVIOUS_PUNCTUATION)))


def _odd_ring_digit(c: Column) -> Column:
    outside = F.regexp_replace(c, r"\[.*?\]", "")
    digits = F.regexp_replace(outside, r"[^\p{Nd}]", "")
    ordered = F.array_join(F.array_sort(F.split(digits, "")), "")
    return F.regexp_replace(ordered, r"(.)\1", "") != ""


def _dash_digit(c: Column) -> Column:
    excused = (
        c.rlike(r"\[[^\]]*-\p{Nd}[^\]]*\]")
        | c.rlike(r"\p{Nd}-\p{Nd}")
        | (F.length(c) > 8)
    )
    return c.rlike(r"-\p{Nd}") & ~excused


def _formula_without_context(c: Column, prev: Column) -> Column:
    rejected = F.lit(False)
    for formula, endings in P.CONTEXT_SUFFIXES.items():
        fits = _previous(prev).rlike("(" + "|".join(endings) + ")$")
        rejected = F.when(c == formula, ~F.coalesce(fits, F.lit(False))).otherwise(rejected)
    return rejected


def _element_without_name(c: Column, prev: Column) -> Column:
    names = F.create_map(
        *[F.lit(x) for symbol, name in P.ELEMENT_NAMES.items() for x in (symbol, name.lower())]
    )
    name = F.when(F.length(c) <= 2, F.element_at(names, c))
    return F.coalesce(name.isNotNull() & ~F.coalesce(_previous(prev) == name, F.lit(False)), F.lit(False))


def _aromatic_letters_only(c: Column) -> Column:
    rest = F.regexp_replace(c, f"{P.BRACKET}|{P.ELEMENT_JAVA}", "")
    special = rest.rlike(P.DETECTION_SPECIAL) | c.rlike(P.BRACKET)
    return rest.rlike(f"[{P.AROMATICS}]") & ~special


def rejections(c: Column, prev: Column, element_names: bool = True) -> dict[str, Column]:
    """One boolean Column per rule, true where the rule rejects the clean token."""
    elements_in_s = [e for e in P.ELEMENTS if e.endswith("s")]
    return {
        "empty": c == "",
        "stop_word": c.isin(P.STOP_WORDS),
        "acronym": c.rlike("^[A-Z]{4,}$") & ~c.rlike("^[CNOPSFI]+$"),
        "dot_digit": c.rlike(r"\.\p{Nd}"),
        "section_code": c.rlike(r"^(SS|SC)\p{Nd}+(\.\p{Nd}+)*$"),
        "roman": c.rlike(r"^\(?(?:I{1,3}|IV|VI{0,3}|IX)\)?$"),
        "state_suffix": c.rlike(r"(\((s|l|g|aq)\)|\.s)$"),
        "slash_without_double_bond": c.rlike(r"[/\\]") & ~c.contains("="),
        "odd_ring_digit": _odd_ring_digit(c),
        "no_capital_or_digit": ~c.rlike(P.CAPITAL_OR_DIGIT),
        "starts_with_digit": c.rlike(r"^\p{Nd}"),
        "dash_digit": _dash_digit(c),
        "dash_word": c.rlike("-[A-Z][a-z]{2,}"),
        "formula_without_context": _formula_without_context(c, prev),
        "element_without_name": _element_without_name(c, prev) if element_names else F.lit(False),
        "plural_acronym": c.rlike(r"^[^\p{Ll}\p{Lt}]*\p{Lu}[^\p{Ll}\p{Lt}]*s$")
        & ~c.isin(elements_in_s)
        & ~c.rlike(r"[\p{Nd}=#\-+()\[\]]"),
        "no_letter": ~c.rlike("[a-zA-Z]"),
        "outside_grammar": ~c.rlike(P.DETECTION_WHOLE_JAVA),
        "aromatic_letters_only": _aromatic_letters_only(c),
    }


def _none_of(rules: dict[str, Column], first: tuple[str, ...] = ()) -> Column:
    verdict = F.when(F.lit(False), False)
    for name in (*first, *(n for n in rules if n not in first)):
        verdict = verdict.when(rules[name], False)
    return verdict.otherwise(True)


def is_clean_smiles(c: Column, prev: Column, element_names: bool = True) -> Column:
    """Verdict for a token already cleaned. The rules are independent of each
    other; the two that reject nearly all prose run first."""
    return _none_of(
        rejections(c, prev, element_names), ("no_capital_or_digit", "outside_grammar")
    )


def is_smiles(token: Column, prev: Column, element_names: bool = True) -> Column:
    return bind(clean(token), lambda c: is_clean_smiles(c, prev, element_names))


def passes_to_review(c: Column) -> Column:
    """Rules that come before an outside reviewer is asked."""
    rules = rejections(c, F.lit(None).cast("string"))
    return _none_of({n: rules[n] for n in RULES_BEFORE_REVIEW}, ("no_capital_or_digit",))


def passes_after_review(c: Column, prev: Column, element_names: bool = True) -> Column:
    """Rules for tokens on which the reviewer gave no answer."""
    rules = rejections(c, prev, element_names)
    return _none_of({n: r for n, r in rules.items() if n not in RULES_BEFORE_REVIEW})
