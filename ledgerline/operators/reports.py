"""Reports put together from the other operators: listings, batch and gold checks. Each is a table, or a dict of tables for sources.io.write_tables."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.money import MONEY
from ledgerline.functions.text import month_key
from ledgerline.operators.dedupe import dedupe
from ledgerline.operators.filters import between_dates
from ledgerline.operators.ordering import ACCOUNT, posting_order
from ledgerline.operators.summary import by_kind, counting, monthly
from ledgerline.operators.verify import compare_positions


def detail_listing(ledger: DataFrame, keys=ACCOUNT) -> DataFrame:
    """Rows of each statement in posting order, with their place."""
    ordered = posting_order(ledger, keys)
    return ordered.select(*keys, F.col("posting_seq").alias("place"), "transaction_time", "income", "expense", "balance", "source_file", "page_no", "row_no", "raw_text", "status")


def simple_report(ledger: DataFrame, kind: str, bank: str = "") -> dict[str, DataFrame]:
    """Detail, by month, by kind, and overall of one statement."""
    detail = ledger.select(F.to_date("transaction_time").alias("day"), F.col(kind).alias("kind"), (F.col("income") - F.col("expense")).cast(MONEY).alias("amount"), F.when(F.col("income") - F.col("expense") >= 0, "income").otherwise("expense").alias("direction"), "income", "expense")
    months = ledger.groupBy(month_key(F.col("transaction_time")).alias("month")).agg(F.count("*").alias("count"), F.sum("income").cast(MONEY).alias("income_sum"), F.sum("expense").cast(MONEY).alias("expense_sum"), F.sum(F.col("income") - F.col("expense")).cast(MONEY).alias("net"))
    total = ledger.agg(F.lit(bank).alias("bank"), F.min(F.to_date("transaction_time")).alias("first_day"), F.max(F.to_date("transaction_time")).alias("last_day"), *[c.alias(n) for n, c in counting().items()])
    return {"detail": detail, "monthly": months, "by_kind": by_kind(ledger, kind), "overall": total.withColumn("net", (F.col("income_sum") - F.col("expense_sum")).cast(MONEY))}


def batch_report(files: DataFrame, issues: DataFrame) -> dict[str, DataFrame]:
    """files(source_file, status, ...), issues(source_file, level, code, ...) -> overview (files by status, all files in a row without status), files, issues of files that aren't passed."""
    overview = files.rollup("status").agg(F.count("*").alias("files"))
    held = files.filter(~F.col("status").isin("PASS", "GENERIC_PASS")).select("source_file", "status")
    return {"overview": overview, "files": files, "issues": issues.join(held, "source_file")}


def layout_listing(summaries: DataFrame, issues: DataFrame, first: int = 3, key: str = "source_file", order: str = "posting_seq") -> DataFrame:
    """Files of a layout with their figures, status (passed or review), number of issues and the first few of them."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(order, "code"))
    top = issues.withColumn("_r", rank)
    found = top.groupBy(key).agg(F.count("*").alias("issues"), F.array_sort(F.collect_list(F.when(F.col("_r") <= first, F.struct(F.col("_r").alias("n"), "code", "raw_amount", "raw_balance")))).alias("x"))  # nulls aren't collected
    out = summaries.join(found, key, "left").withColumn("issues", F.coalesce("issues", F.lit(0)))
    shown = F.transform("x", lambda i: F.concat_ws(" ", i["code"], i["raw_amount"], i["raw_balance"]))
    return out.select(key, "count", "income_count", "income_sum", "expense_count", "expense_sum", "issues", F.when(F.col("issues") > 0, "review").otherwise("passed").alias("status"), F.coalesce(F.array_join(shown, "; "), F.lit("")).alias("first_issues"))


def _figures(rows: DataFrame, side: str, keys) -> DataFrame:
    spent, gained = F.col("expense") > 0, F.col("income") > 0
    return rows.groupBy(*keys).agg(F.lit(side).alias("side"), F.count("*").alias("count"), F.count_if(spent).alias("expense_count"), F.sum("expense").cast(MONEY).alias("expense_sum"), F.count_if(gained).alias("income_count"), F.sum("income").cast(MONEY).alias("income_sum"))


def gold_check(ledger: DataFrame, gold: DataFrame, first: date | None = None, last: date | None = None, columns=("income", "expense", "balance"), order=("transaction_time", "row_no"), keys=tuple(ACCOUNT)) -> tuple[DataFrame, DataFrame]:
    """(differences by position, figures of both sides) of rows in a range of dates against checked rows in the same one."""
    if first is not None:
        ledger, gold = between_dates(ledger, first, last), between_dates(gold, first, last)
    return compare_positions(ledger, gold, list(columns), list(order), keys), _figures(ledger, "ledger", keys).unionByName(_figures(gold, "gold", keys))


def merged_gold_check(ledger: DataFrame, gold: DataFrame, keys=tuple(ACCOUNT)) -> tuple[DataFrame, DataFrame]:
    """(differences, figures): several files of an account, without rows of the same ``merge_key``, against checked rows of some months.

    Months are those of the checked rows, whatever the year's order of files; rows go by time, then key.
    """
    months = gold.select(*keys, month_key(F.col("transaction_time")).alias("_month")).distinct()
    mine = ledger.withColumn("_month", month_key(F.col("transaction_time"))).join(months, [*keys, "_month"], "left_semi").drop("_month")
    merged = dedupe(mine)
    order = ["transaction_time", "merge_key", "row_no"]
    return compare_positions(merged, gold, ["income", "expense", "balance"], order, keys), _figures(merged, "ledger", keys).unionByName(_figures(gold, "gold", keys))


def monthly_with_total(ledger: DataFrame, keys=ACCOUNT) -> DataFrame:
    """Months of each statement, then its total in a row without a month."""
    from ledgerline.operators.summary import add_up

    parts = monthly(ledger, keys).drop("closure_exempt", "opening_balance", "closing_balance")
    return parts.unionByName(add_up(parts, keys).withColumn("month", F.lit(None).cast("string")))
