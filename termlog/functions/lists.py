"""The list library as functions on arrays; all run inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def length(xs: Column) -> Column:
    return F.size(xs).cast("bigint")


def singleton(x: Column) -> Column:
    return F.array(x)


def nth(xs: Column, n: Column | int) -> Column:
    """The element at place n from 0, or null past the end."""
    return F.get(xs, n if isinstance(n, Column) else F.lit(n))


def append(xs: Column, ys: Column) -> Column:
    """One list after the other."""
    return F.concat(xs, ys)


def push(xs: Column, x: Column) -> Column:
    return F.array_append(xs, x)


def reverse(xs: Column) -> Column:
    return F.reverse(xs)


def mapped(xs: Column, f: Callable[[Column], Column]) -> Column:
    return F.transform(xs, f)


def to_list_term(xs: Column, cons: str, nil: str) -> Column:
    """Canonical text of the array of texts as a term: cons(x, cons(y, nil))."""
    return F.aggregate(F.reverse(xs), F.lit(nil), lambda acc, x: F.concat(F.lit(f"{cons}("), x.cast("string"), F.lit(", "), acc, F.lit(")")))
