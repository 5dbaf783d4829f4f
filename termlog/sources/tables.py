"""Relations from tables and generators. Only the mapped columns are read."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lang.ast import Expr, Lit, Term


def relation(table: DataFrame, columns: list[Column | str], where: Column | str | None = None) -> DataFrame:
    """A relation's rows from a table: one expression for each field, in order; repeats are dropped by the engine."""
    df = table.where(where) if where is not None else table
    return df.select(*((F.expr(c) if isinstance(c, str) else c).alias(f"_{i}") for i, c in enumerate(columns)))


def read(spark: SparkSession, path: str, columns: list[Column | str], where: Column | str | None = None, format: str = "parquet", **options) -> DataFrame:
    """As relation(), from any format that Spark reads; filters and columns reach the scan."""
    return relation(spark.read.format(format).options(**options).load(path), columns, where)


def random_graph(spark: SparkSession, nodes: int, edges: int, seed: int = 0) -> dict[str, DataFrame]:
    """Node(0 .. nodes-1) and `edges` distinct random edges, without a driver-side loop. More are drawn than asked, and
    the first that differ are kept."""
    if edges > nodes * nodes:
        raise ValueError(f"{nodes} nodes have {nodes * nodes} edges at most")
    drawn = edges
    while True:
        rolls = spark.range(drawn).select("id", F.pmod(F.xxhash64("id", F.lit(2 * seed)), F.lit(nodes)).alias("src"), F.pmod(F.xxhash64("id", F.lit(2 * seed + 1)), F.lit(nodes)).alias("dst"))
        own = rolls.groupBy("src", "dst").agg(F.min("id").alias("id"))
        if own.count() >= edges:
            return {"Node": spark.range(nodes).toDF("name"), "Edge": own.orderBy("id").limit(edges).select("src", "dst")}
        drawn *= 2


def record(value, name: str | None = None) -> Expr:
    """A Python value or mapping as a term: {"Edge": [1, 2]} or {"Edge": {"src": 1, "dst": 2}} or a scalar."""
    if isinstance(value, Mapping):
        if len(value) != 1:
            raise ValueError(f"a term has one constructor: {value}")
        (name, args), = value.items()
        args = list(args.values()) if isinstance(args, Mapping) else list(args) if isinstance(args, (list, tuple)) else [args]
        return Term(name, tuple(record(a) for a in args))
    if isinstance(value, (Term, Lit)):
        return value
    return Lit(value)
