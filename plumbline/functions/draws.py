"""Repeatable draws from hashes instead of a random stream.

A draw is a function of the row's identity, so it does not depend on how rows are partitioned, on
the order tasks run in, or on a task being run twice after an executor is lost.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_column(part) -> Column:
    return part if isinstance(part, Column) else F.lit(str(part))


def draw(*parts) -> Column:
    """The hash of an identity, as 32 hex digits. Plain values are used as text."""
    return F.md5(F.concat_ws("|", *[as_column(p).cast("string") for p in parts]))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """The body over a value computed once; a column that is merely named may be computed again per element of a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _element_draws(n: Column, body: Callable[[Column, Column], Column], *identity) -> Column:
    """``body(draw, index)`` for the indexes 0 to n - 1; a draw is that of the identity and the index."""
    head = F.concat(F.concat_ws("|", *[as_column(p).cast("string") for p in identity]), F.lit("|"))
    places = F.sequence(F.lit(0), n - 1)
    return let(head, lambda h: F.transform(places, lambda i: body(F.md5(F.concat(h, i.cast("string"))), i)))


def shuffled(values: Column, *identity) -> Column:
    """An array in the order of its elements' draws; an element's draw uses its 0-based index."""

    def order(array: Column) -> Column:
        tagged = _element_draws(F.size(array), lambda d, i: F.struct(d.alias("rank"), i.alias("index")), *identity)
        return F.when(F.size(array) > 0, F.transform(F.sort_array(tagged), lambda s: F.get(array, s["index"]))).otherwise(array)

    return let(values, order)


def pick_indexes(n: Column, k: Column, *identity) -> Column:
    """k distinct 0-based indexes out of n, ascending, chosen by draw order."""

    def first(draws: Column) -> Column:
        last = F.get(F.sort_array(draws), F.least(k, n) - 1)
        return let(last, lambda top: F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.get(draws, i) <= top))

    chosen = let(_element_draws(n, lambda d, i: d, *identity), first)
    return F.when(n > 0, chosen).otherwise(F.array().cast("array<int>"))


def at_least_one(amount: Column) -> Column:
    """max(1, amount rounded half to even), as int."""
    return F.greatest(F.lit(1), F.bround(amount, 0).cast("int"))
