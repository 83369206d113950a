"""How many claims a text states at least, and whether an extraction covers them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Wording of open lists, and wording that needs a confirmation of its own.
OPEN_LIST = ("等", "etc.", "etc", "и т.д", "и т. д", "прочие", "другие", "其他")
INDIVIDUAL = ("整个系列", "所有型号", "适用于系列", "hardware revision", "firmware", "revision", "除非", "例外", "услови", "кроме", "исключ")
SET_ASIDE = ("non_knowledge", "marketing", "context")

LABELLED = r"(?:^|[;；\n])\s*[^;；\n:：]{1,80}[：:]\s*[^;；\n]+"
PARTS = r"[;；\n]+"
ENDS = r"[。！？!?]"


def _any(text: Column, words: tuple[str, ...]) -> Column:
    low, found = F.lower(F.coalesce(text, F.lit(""))), F.lit(False)
    for w in words:
        found = found | F.contains(low, F.lit(w))
    return found


def open_list(text: Column) -> Column:
    """Wording that says that a list goes on."""
    return _any(text, OPEN_LIST)


def needs_individual(text: Column, derived: Column | None = None) -> Column:
    """Derived facts, and those about revisions, whole families or exceptions, are confirmed one by one."""
    found = _any(text, INDIVIDUAL)
    return found if derived is None else F.coalesce(derived, F.lit(False)) | found


def least_claims(text: Column) -> Column:
    """A lower bound of the claims in a text, by its labelled fields, parts and ends of sentences; 0 for a blank text."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")
    labelled = F.size(F.regexp_extract_all(t, F.lit(LABELLED), F.lit(0)))
    parts = F.size(F.filter(F.split(t, PARTS), lambda p: F.trim(p) != ""))
    return F.when(t == "", 0).otherwise(F.greatest(F.lit(1), labelled, parts, F.size(F.regexp_extract_all(t, F.lit(ENDS), F.lit(0)))))


def coverage_error(source: Column, excerpts: Column, complete: Column, uncovered: Column, claims: Column) -> Column:
    """The first reason why an extraction does not cover its source, null if it does.

    excerpts: array of the facts' excerpts; complete: what the reply says; uncovered: array of claims it leaves out;
    claims: array of struct(text, units: array of places in excerpts, disposition). Each claim stands in the source and in the excerpt
    of one of its facts, or is set aside by its disposition; each fact is named by a claim; there are no fewer
    claims than the source shows."""
    text, n = F.coalesce(source, F.lit("")), F.size(excerpts)
    said = lambda c: F.trim(F.coalesce(c["text"], F.lit("")))
    aside = lambda c: F.lower(F.trim(F.coalesce(c["disposition"], F.lit("knowledge")))).isin(*SET_ASIDE) & (F.size(c["units"]) == 0)
    inside = lambda s: (F.trim(F.coalesce(s, F.lit(""))) != "") & F.contains(text, F.trim(s))
    named = F.array_distinct(F.flatten(F.transform(claims, lambda c: F.coalesce(c["units"], F.array().cast("array<int>")))))
    checks = [
        ("incomplete", ~F.coalesce(complete, F.lit(False))),
        ("uncovered", uncovered.isNull() | (F.size(uncovered) > 0)),
        ("too_few_claims", claims.isNull() | (F.size(claims) < least_claims(source))),
        ("excerpt_not_in_source", F.exists(excerpts, lambda e: ~F.coalesce(inside(e), F.lit(False)))),
        ("claim_not_in_source", F.exists(claims, lambda c: (said(c) == "") | ~F.contains(text, said(c)))),
        ("no_units", F.exists(claims, lambda c: ~aside(c) & (c["units"].isNull() | (F.size(c["units"]) == 0)))),
        ("unknown_unit", F.exists(named, lambda i: i.isNull() | (i < 0) | (i >= n))),
        ("claim_outside_units", F.exists(claims, lambda c: ~aside(c) & ~F.exists(c["units"], lambda i: F.contains(F.trim(F.get(excerpts, i)), said(c))))),
        ("unnamed_unit", F.size(named) != n),
    ]
    error = F.lit(None).cast("string")
    for name, wrong in reversed(checks):
        error = F.when(F.coalesce(wrong, F.lit(True)), name).otherwise(error)
    return error
