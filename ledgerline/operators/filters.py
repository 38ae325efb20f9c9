"""Row filters of a ledger; all of them plain predicates that reach the scan where the column is stored."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.text import CORPORATE_WORDS, has_any, month_key


def between_dates(ledger: DataFrame, first: date, last: date, ts: str = "transaction_time") -> DataFrame:
    """Inclusive calendar dates; reversed bounds are swapped."""
    a, b = sorted((first, last))
    return ledger.filter(F.to_date(ts).between(F.lit(a), F.lit(b)))


def between_times(ledger: DataFrame, first: datetime | None = None, last: datetime | None = None, ts: str = "transaction_time") -> DataFrame:
    """Inclusive timestamps, either side open."""
    if first is not None:
        ledger = ledger.filter(F.col(ts) >= F.lit(first))
    return ledger if last is None else ledger.filter(F.col(ts) <= F.lit(last))


def between_keeping_undated(ledger: DataFrame, first: date, last: date, ts: str = "transaction_time") -> DataFrame:
    """Dates in range, and rows without a date."""
    return ledger.filter(F.col(ts).isNull() | F.to_date(ts).between(F.lit(first), F.lit(last)))


def without_words(rows: DataFrame, words: list[str], text: str = "raw_text") -> DataFrame:
    """Drops total and header rows."""
    return rows.filter(~F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(F.coalesce(text, F.lit("")), w)))


def shaped(rows: DataFrame, width: int, patterns: dict[int, str], cells: str = "cells") -> DataFrame:
    """Rows of at least so many cells, some of which look like their pattern (positions from 0)."""
    for k, rx in patterns.items():
        rows = rows.filter(F.regexp_like(F.coalesce(F.try_element_at(cells, F.lit(k + 1)), F.lit("")), F.lit(rx)))
    return rows.filter(F.size(cells) >= width)


def currency(ledger: DataFrame, name: str = "currency", own=("CNY", "人民币"), drop: bool = True) -> DataFrame:
    """Foreign currency rows are dropped, or kept as neutral."""
    home = F.coalesce(F.col(name).isin(*own), F.lit(True))
    return ledger.filter(home) if drop else ledger.withColumn("neutral", F.col("neutral") | ~home)


def months(ledger: DataFrame, first: str | None, last: str | None, ts: str = "transaction_time") -> DataFrame:
    key = month_key(F.col(ts))
    return ledger if first is None else ledger.filter(key.between(first, last))


def month_set(ledger: DataFrame, wanted: DataFrame, ts: str = "transaction_time") -> DataFrame:
    return ledger.withColumn("month", month_key(F.col(ts))).join(wanted.select("month"), "month", "left_semi")


def of_flow(ledger: DataFrame, flow: str) -> DataFrame:
    return ledger.filter(F.col("flow_type") == flow)


def confirmed_exclusions(ledger: DataFrame, confirmations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept rows, audit rows). A row goes only if a confirmation names its file's fingerprint, page, row, income and balance exactly."""
    key = ["sha256", "page_no", "row_no", "income", "balance"]
    wanted = confirmations.filter("action = 'exclude'").select("id", "sha256", F.col("page").alias("page_no"), F.col("row").alias("row_no"), "income", "balance", "basis")
    return ledger.join(wanted, key, "left_anti"), ledger.join(wanted, key)


def proven_exclusions(ledger: DataFrame, confirmations: DataFrame, order: str = "posting_seq") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(kept rows, audit rows, errors): as ``confirmed_exclusions``, but the rows around must be the confirmed ones, too.

    confirmations also hold previous_balance, next_expense and next_balance. A confirmation for a file that is there (by
    its fingerprint) but fits no row, several rows, or other neighbours is an error row (id, sha256, reason) and drops nothing.
    """
    w = Window.partitionBy("sha256", "account_no").orderBy(order)
    near = ledger.withColumns({"_pb": F.lag("balance").over(w), "_ne": F.lead("expense").over(w), "_nb": F.lead("balance").over(w)})
    c = confirmations.filter("action = 'exclude'").select(F.col("id").alias("_id"), "sha256", F.col("page").alias("page_no"), F.col("row").alias("row_no"), "income", "balance", "basis", F.col("previous_balance").alias("_wpb"), F.col("next_expense").alias("_wne"), F.col("next_balance").alias("_wnb"))
    key = ["sha256", "page_no", "row_no", "income", "balance"]
    met = near.join(c, key)
    fits = F.coalesce((F.col("_pb") == F.col("_wpb")) & (F.col("_ne") == F.col("_wne")) & (F.col("_nb") == F.col("_wnb")), F.lit(False))
    judged = met.groupBy("_id").agg(F.count("*").alias("_rows"), F.bool_and(fits).alias("_fits"))
    here = ledger.select("sha256").distinct()
    checked = c.join(here, "sha256", "left_semi").join(judged, "_id", "left")
    reason = F.when(F.col("_rows").isNull(), "no_such_row").when(F.col("_rows") > 1, "several_rows").when(~F.col("_fits"), "neighbours_differ")
    errors = checked.withColumn("reason", reason).filter("reason IS NOT NULL").select(F.col("_id").alias("id"), "sha256", "reason")
    good = checked.filter(reason.isNull()).select(*key, F.col("_id").alias("id"), "basis")
    return ledger.join(good, key, "left_anti"), ledger.join(good, key), errors


#: Layouts of corporate accounts, besides all that end in _corp.
CORPORATE_LAYOUTS = ["abc_corp", "boc_corp", "boc_corp_v2", "ccb_corp", "cmbc_corp", "hebei_corp_detail", "icbc_corp", "spdb_corp"]


def flow_of(layout: Column, name: Column, label: Column, own: Column | None = None, corporate_words: list[str] | None = None) -> Column:
    """Flow type: a row's own, else by layout (corporate, wechat); else a corporate name's; else by a spreadsheet's label; else personal."""
    words = corporate_words or CORPORATE_WORDS
    label = F.coalesce(label, F.lit(""))
    found = F.when(layout.isin(CORPORATE_LAYOUTS) | F.endswith(layout, F.lit("_corp")), "corporate").when(layout == "wechat", "wechat").when(has_any(F.trim(name), words), "corporate")
    found = found.when((layout == "excel") & F.contains(label, F.lit("微信")), "wechat").when((layout == "excel") & F.contains(label, F.lit("对公")), "corporate").otherwise("personal")
    return found if own is None else F.coalesce(F.when(own.isin("personal", "wechat", "corporate"), own), found)
