"""Relations arranged by key, and operations on the groups: joins, and aggregates combined map-side."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Grouped:
    """The rows of a relation by key columns. Rows are a set, so values count once for each row they stand in."""

    def __init__(self, df: DataFrame, keys: list[str]):
        self.df, self.keys = df, list(keys)

    def group_key(self) -> DataFrame:
        return self.df.select(*self.keys).distinct()

    def group_count(self, name: str = "n") -> DataFrame:
        return self.df.groupBy(*self.keys).agg(F.count(F.lit(1)).alias(name))

    def group_sum(self, value: str, name: str = "total") -> DataFrame:
        return self.df.groupBy(*self.keys).agg(F.sum(value).alias(name))

    def group_to_set(self, value: str, name: str = "values") -> DataFrame:
        """Each group's distinct values, sorted. A row holds its whole set, as the result asks for: where groups are
        unbounded, keep to map() and the aggregates."""
        return self.df.select(*self.keys, value).distinct().groupBy(*self.keys).agg(F.array_sort(F.collect_list(value)).alias(name))

    def map(self, f: Callable[[Column], Column], value: str) -> Grouped:
        """The groups with a value replaced, each row once."""
        return Grouped(self.df.withColumn(value, f(F.col(value))).distinct(), self.keys)


def group_by(df: DataFrame, *keys: str) -> Grouped:
    return Grouped(df, list(keys))


def join_core(left: DataFrame, right: DataFrame, keys: list[str], *columns: Column | str) -> DataFrame:
    """An equi-join on keys, projected, each row once; nulls join nothing."""
    return left.join(right, list(keys)).select(*columns).distinct()
