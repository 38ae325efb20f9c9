"""Posting order of a statement's rows. Timestamps are never changed: order goes into ``posting_seq`` or ``statement_order``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.text import has_clock
from ledgerline.sources.ledgers import order_key

ACCOUNT = ["account_no"]


def mark_partial_days(ledger: DataFrame, keys=ACCOUNT) -> DataFrame:
    """``partial_day``: some row of the account's date has no clock."""
    day = Window.partitionBy(*keys, F.to_date("transaction_time"))
    return ledger.withColumn("partial_day", F.max(~has_clock(F.col("raw_time"))).over(day))


def posting_order(ledger: DataFrame, keys=ACCOUNT) -> DataFrame:
    """``order_key`` and ``posting_seq``, 1 for an account's first row."""
    keyed = mark_partial_days(ledger, keys).withColumn("order_key", order_key(F.col("partial_day")))
    return keyed.withColumn("posting_seq", F.row_number().over(Window.partitionBy(*keys).orderBy("order_key")))


def reverse_printed(ledger: DataFrame, keys=ACCOUNT) -> DataFrame:
    """Files printed newest first: by date, then from the last printed row to the first."""
    order = Window.partitionBy(*keys).orderBy(F.to_date("transaction_time"), F.desc("page_no"), F.desc("row_no"))
    return ledger.withColumn("statement_order", F.row_number().over(order).cast("bigint"))


def printed_order(ledger: DataFrame, keys=ACCOUNT, newest_first: bool = False) -> DataFrame:
    """Print order wins over clocks."""
    by = [F.desc("page_no"), F.desc("row_no")] if newest_first else ["page_no", "row_no"]
    return ledger.withColumn("statement_order", F.row_number().over(Window.partitionBy(*keys).orderBy(*by)).cast("bigint"))


def by_policy(ledger: DataFrame, keys=ACCOUNT, policy: str = "order_policy") -> DataFrame:
    """``statement_order`` by each row's policy column (one value a statement).

    source: as printed; reverse_all: from the last printed row to the first; reverse_day: by date, within it reversed;
    reverse_time: by timestamp, rows of one timestamp reversed. Timestamps are never changed.
    """
    p = F.col(policy)
    time = F.when(p == "reverse_day", F.date_trunc("day", "transaction_time")).when(p == "reverse_time", F.col("transaction_time"))
    sign = F.when(p.isin("reverse_day", "reverse_all", "reverse_time"), -1).otherwise(1)
    order = Window.partitionBy(*keys).orderBy(time, sign * F.col("page_no"), sign * F.col("row_no"))
    return ledger.withColumn("statement_order", F.row_number().over(order).cast("bigint"))


def _links(prev_balance):
    return (F.col("balance") == prev_balance + F.col("income") - F.col("expense")).cast("int")


def same_time_by_score(ledger: DataFrame, keys=ACCOUNT, tie: str = "forward") -> DataFrame:
    """Rows of one timestamp in the direction, forward or reverse, in which more balances link to the row before."""
    group = [*keys, "transaction_time"]
    up = Window.partitionBy(*group).orderBy("page_no", "row_no")
    down = Window.partitionBy(*group).orderBy(F.desc("page_no"), F.desc("row_no"))
    whole = Window.partitionBy(*group)
    df = ledger.withColumns({"_f": _links(F.lag("balance").over(up)), "_r": _links(F.lag("balance").over(down))})
    df = df.withColumns({"_f": F.coalesce(F.sum("_f").over(whole), F.lit(0)), "_r": F.coalesce(F.sum("_r").over(whole), F.lit(0))})
    reverse = F.col("_r") > F.col("_f") if tie == "forward" else F.col("_r") >= F.col("_f")
    df = df.withColumn("reversed", reverse)
    sign = F.when(F.col("reversed"), -1).otherwise(1)
    order = Window.partitionBy(*keys).orderBy("transaction_time", sign * F.col("page_no"), sign * F.col("row_no"))
    return df.withColumn("statement_order", F.row_number().over(order).cast("bigint")).drop("_f", "_r")


def same_time_if_proven(ledger: DataFrame, keys=ACCOUNT) -> DataFrame:
    """Rows of one timestamp are reversed only if every link of the reversed order holds; else the source order stays."""
    group = [*keys, "transaction_time"]
    down = Window.partitionBy(*group).orderBy(F.desc("page_no"), F.desc("row_no"))
    whole = Window.partitionBy(*group)
    link = F.coalesce(_links(F.lag("balance").over(down)) == 1, F.lit(False)) | (F.row_number().over(down) == 1)
    df = ledger.withColumn("_ok", link)
    df = df.withColumn("reversed", F.min("_ok").over(whole) & (F.count("*").over(whole) > 1)).drop("_ok")
    sign = F.when(F.col("reversed"), -1).otherwise(1)
    order = Window.partitionBy(*keys).orderBy("transaction_time", sign * F.col("page_no"), sign * F.col("row_no"))
    return df.withColumn("statement_order", F.row_number().over(order).cast("bigint"))
