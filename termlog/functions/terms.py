"""Hash-consed terms: a table (id, cons, args) that holds each subterm of recursive terms once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lang.ast import Expr, Term
from ..types import canonical

SCHEMA = "id string, cons string, args array<string>"


def subterms(terms: list[Expr]) -> list[tuple[str, str, list[str]]]:
    """(id, constructor, ids of arguments) of all terms and subterms, each once, arguments before what holds them."""
    seen: dict[str, tuple[str, str, list[str]]] = {}

    def add(e: Expr) -> str:
        key = canonical(e)
        if key not in seen:
            args = [add(a) for a in e.args] if isinstance(e, Term) else []
            seen[key] = (key, e.name if isinstance(e, Term) else "", args)
        return key

    for t in terms:
        add(t)
    return list(seen.values())


def table(spark: SparkSession, terms: list[Expr]) -> DataFrame:
    return spark.createDataFrame(subterms(terms), SCHEMA)


def construct(cons: str, *args: Column) -> Column:
    """The id of a term of ids."""
    return F.concat(F.lit(f"{cons}("), F.concat_ws(", ", *args), F.lit(")")) if args else F.lit(cons)


def destructure(df: DataFrame, id_col: str, terms: DataFrame, cons: str, names: list[str]) -> DataFrame:
    """Rows whose term has the constructor, with its arguments as columns: a join by id."""
    own = terms.where(F.col("cons") == cons).select(F.col("id").alias(id_col), *(F.get("args", F.lit(i)).alias(n) for i, n in enumerate(names)))
    return df.join(own, id_col)


def rows_of(cons: str, df: DataFrame, args: list[str]) -> DataFrame:
    """Term-table rows of the constructed terms of a DataFrame of ids."""
    return df.select(construct(cons, *(F.col(a) for a in args)).alias("id"), F.lit(cons).alias("cons"), F.array(*args).alias("args")).distinct()
