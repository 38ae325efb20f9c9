"""Rows repeated in overlapping exports, and merging of partial statements."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SIGNATURE = ["bank_id", "account_no", "transaction_time", "income", "expense", "balance", "raw_amount", "raw_balance"]


def _first_of(rows: DataFrame, keys: list, order: list) -> DataFrame:
    """The first row of each key by ``order``. Spark keeps a key's first row of each task before it shuffles, so a frequent key is no hot spot, and sorts only columns that are used after."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def dedupe(ledger: DataFrame) -> DataFrame:
    """Keyed rows (``merge_key``) keep one row a key. Others keep every repeat from the first file that has the row, and lose those of other files.

    First files come from an aggregate that combines before it shuffles. Only signatures of several files go on; their
    rows of other files are taken out by an anti-join, so rows that no other file repeats aren't joined with anything of their own.
    """
    keyed = F.coalesce(F.col("merge_key"), F.lit("")) != ""
    account = [F.coalesce("bank_id", F.lit("")), F.coalesce("account_no", F.lit(""))]
    order = ["transaction_time", "source_file", "row_no", "ingest_seq"]
    one = _first_of(ledger.filter(keyed), [*account, F.col("merge_key")], order)
    sign = {f"_s{k}": c for k, c in enumerate([*account, *[F.col(c) for c in SIGNATURE[2:]]])}
    plain = ledger.filter(~keyed).withColumns(sign)
    name = F.coalesce("source_file", F.lit(""))
    first = plain.groupBy(*sign).agg(F.min_by(F.struct("source_file"), F.struct(*order))["source_file"].alias("_first"), F.min(name).alias("_least"), F.max(name).alias("_most"))
    first = first.filter("_least <> _most").select(*[F.col(c).alias(f"{c}_") for c in sign], "_first")
    same = F.col("_s0") == F.col("_s0_")
    for c in list(sign)[1:]:
        same = same & F.col(c).eqNullSafe(F.col(f"{c}_"))
    kept = plain.join(first, same & ~F.col("source_file").eqNullSafe(F.col("_first")), "left_anti").select(*[F.col(f"`{c}`") for c in ledger.columns])
    return one.unionByName(kept)


def dedupe_by(ledger: DataFrame, key: str, keys=("account_no",)) -> DataFrame:
    """One row a serial key; rows without one stay."""
    has = F.coalesce(F.col(key).cast("string"), F.lit("")) != ""
    one = _first_of(ledger.filter(has), [*[F.col(k) for k in keys], F.col(key)], ["transaction_time", "source_file", "row_no"])
    return one.unionByName(ledger.filter(~has))


def dedupe_by_serial(ledger: DataFrame, field: str) -> DataFrame:
    """Rows whose text starts with at least five digits: one for each serial, date, amounts and balance."""
    serial = F.nullif(F.regexp_extract(field, r"^\s*(\d{5,})", 1), F.lit(""))
    one = _first_of(ledger.filter(serial.isNotNull()), [serial, F.to_date("transaction_time"), F.col("income"), F.col("expense"), F.col("balance")], ["ingest_seq"])
    return one.unionByName(ledger.filter(serial.isNull()))


def distinct_accounts(ledger: DataFrame, most: int | None = 5) -> DataFrame:
    """Accounts of each flow with their first file; rows without an account go by file. At most so many a flow are listed."""
    key = F.coalesce(F.nullif(F.col("account_no"), F.lit("")), F.concat(F.lit("file:"), F.col("source_file")))
    found = ledger.groupBy("flow_type", key.alias("account")).agg(F.min("source_file").alias("first_file"), F.count("*").alias("rows"))
    if most is None:
        return found
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("flow_type").orderBy("account"))).filter(F.col("rank") <= most)


def merge_statements(ledger: DataFrame) -> DataFrame:
    """``statement_id``: the account where several files hold it, else the file; repeats of overlapping files are gone."""
    files = ledger.filter("account_no IS NOT NULL AND account_no <> ''").groupBy(F.col("account_no").alias("_no"), F.col("account_name").alias("_name")).agg(F.count_distinct("source_file").alias("_files"))
    joined = dedupe(ledger).join(files, (F.col("account_no") == F.col("_no")) & F.col("account_name").eqNullSafe(F.col("_name")), "left").drop("_no", "_name")
    return joined.withColumn("statement_id", F.when(F.col("_files") > 1, F.concat(F.lit("account:"), "account_no")).otherwise(F.concat(F.lit("file:"), F.coalesce("source_file", F.lit(""))))).drop("_files")


def later_wins(first: DataFrame, second: DataFrame, keys=("transaction_time", "income", "expense", "balance")) -> DataFrame:
    """Two extractions of the same statement; where both hold a row, the second one's stays. Null keys are equal."""
    known = second.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return second.unionByName(first.join(known, same, "left_anti"), allowMissingColumns=True)


def with_fallback(special: DataFrame, generic: DataFrame, key: str = "source_file", message: str | None = None) -> DataFrame:
    """Rows of the special reader, and the generic reader's for files of which the special one read nothing; these say so in a column ``message``, if one is given."""
    rest = generic.join(special.select(key).distinct(), key, "left_anti")
    if message is not None:
        special, rest = special.withColumn("message", F.lit(None).cast("string")), rest.withColumn("message", F.lit(message))
    return special.unionByName(rest, allowMissingColumns=True)
