"""Relations between product scopes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions.text import scope_key


def _rank(user: Column, other: Column) -> Column:
    """0 exact, 1 family (one key begins the other), 2 conflict."""
    a, b = scope_key(user), scope_key(other)
    return F.when(a == b, 0).when(a.startswith(b) | b.startswith(a), 1).otherwise(2)


def relation(user: Column, other: Column) -> Column:
    return F.element_at(F.array(F.lit("exact"), F.lit("family"), F.lit("conflict")), _rank(user, other) + 1)


def _worst(outer: Column, inner: Column) -> Column:
    best = F.transform(outer, lambda o: F.array_min(F.transform(inner, lambda i: _rank(i, o))))
    return F.when(F.exists(best, lambda r: r == 2), "conflict").when(F.forall(best, lambda r: r == 0), "exact").otherwise("family")


def scope_match(user: Column, document: Column) -> Column:
    """Best relation of each document model; unspecified if either side names none."""
    return F.when((F.size(user) == 0) | (F.size(document) == 0), "unspecified").otherwise(_worst(document, user))


def verified_scope_match(user: Column, known: Column) -> Column:
    """Best relation of each user model; generic if the knowledge is not restricted."""
    return F.when(F.size(known) == 0, "generic").when(F.size(user) == 0, "unspecified").otherwise(_worst(user, known))


def applicable(stated: Column, asked: Column) -> Column:
    """Only stated values that miss all asked ones exclude."""
    return (F.size(stated) == 0) | (F.size(asked) == 0) | F.arrays_overlap(stated, asked)
