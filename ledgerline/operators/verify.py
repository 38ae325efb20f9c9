"""Verification of results against expected figures and gold rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FIGURES = ["count", "income_count", "expense_count", "income_sum", "expense_sum", "net", "opening_balance", "closing_balance"]


def compare_expected(actual: DataFrame, expected: DataFrame, key: str = "name", figures=tuple(FIGURES)) -> DataFrame:
    """key, status (pass, fail, skip: no such result) and the figures that differ; figures without expectation don't count."""
    a = actual.select(key, *[F.col(f).cast("decimal(28,2)").alias(f"a_{f}") for f in figures], F.lit(True).alias("_there"))
    e = expected.select(key, *[F.col(f).cast("decimal(28,2)").alias(f"e_{f}") for f in figures])
    bad = F.array_compact(F.array(*[F.when(F.col(f"e_{f}").isNotNull() & ~F.col(f"e_{f}").eqNullSafe(F.col(f"a_{f}")), f) for f in figures]))
    out = e.join(a, key, "left").withColumn("differs", bad)
    return out.select(key, F.when(F.col("_there").isNull(), "skip").when(F.size("differs") > 0, "fail").otherwise("pass").alias("status"), F.when(F.col("_there").isNull(), "").otherwise(F.array_join("differs", ",")).alias("differs"))


def compare_positions(left: DataFrame, right: DataFrame, columns: list[str], order: list[str], keys=("account_no",)) -> DataFrame:
    """Rows that differ at the same position of each statement, by full outer join: keys, position, side (both, left, right), differs."""
    w = Window.partitionBy(*keys).orderBy(*order)
    a = left.withColumn("position", F.row_number().over(w)).select(*keys, "position", *[F.col(c).alias(f"l_{c}") for c in columns], F.lit(True).alias("_l"))
    b = right.withColumn("position", F.row_number().over(w)).select(*keys, "position", *[F.col(c).alias(f"r_{c}") for c in columns], F.lit(True).alias("_r"))
    differs = F.array_compact(F.array(*[F.when(~F.col(f"l_{c}").eqNullSafe(F.col(f"r_{c}")), c) for c in columns]))
    side = F.when(F.col("_r").isNull(), "left").when(F.col("_l").isNull(), "right").otherwise("both")
    out = a.join(b, [*keys, "position"], "full").withColumns({"side": side, "differs": F.array_join(differs, ",")})
    return out.filter("side <> 'both' OR differs <> ''").select(*keys, "position", "side", "differs")


def pass_counts(compared: DataFrame) -> DataFrame:
    return compared.groupBy("status").agg(F.count("*").alias("cases"))


def top_by(df: DataFrame, n: int, by: str, key: str) -> DataFrame:
    """The n largest; a top-k of Spark, not a sort."""
    return df.orderBy(F.desc(by), key).limit(n)
