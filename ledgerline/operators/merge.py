"""Several files of one account as one statement: page parts, re-sequenced exports, segments with gaps between them."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.operators.dedupe import dedupe
from ledgerline.operators.ordering import posting_order
from ledgerline.operators.sequence import euler_order, greedy_order

#: Layouts whose files of one account are merged in time order, by balance trails, with segments, and by printed pages.
SORTED_LAYOUTS = ["abc_corp", "chengdu_corp", "mengshang_corp", "ccb_corp"]
TRAIL_LAYOUTS = ["mintai", "hengfeng"]
SEGMENT_LAYOUTS = ["chaoyang_corp"]
PART_LAYOUTS = ["rural_commercial"]

GROUP = ["bank_id", "account_no", "account_name"]


def _several(ledger: DataFrame, layouts: list[str], keys=tuple(GROUP)) -> DataFrame:
    """Groups of at least two files with an account, of some layouts: keys, files."""
    known = ledger.filter(F.col("bank_id").isin(layouts) & (F.coalesce("account_no", F.lit("")) != ""))
    return known.groupBy(*keys).agg(F.count_distinct("source_file").alias("files")).filter("files > 1")


def _split(ledger: DataFrame, groups: DataFrame, keys=tuple(GROUP)) -> tuple[DataFrame, DataFrame]:
    """(rows of the groups, all other rows); null keys are a value of their own."""
    on = [F.col(f"_g_{k}").eqNullSafe(F.col(k)) for k in keys]
    named = groups.select(*[F.col(k).alias(f"_g_{k}") for k in keys])
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return ledger.join(named, cond, "left_semi"), ledger.join(named, cond, "left_anti")


def merge_sequenced(ledger: DataFrame, by_time: list[str] = SORTED_LAYOUTS, by_trail: list[str] = TRAIL_LAYOUTS) -> DataFrame:
    """Files of one account become one statement, put in order anew: by time, or by balance trails.

    Adds ``statement_id``, ``source_page_no`` and ``source_row_no``; rows of merged statements get page 0, their place
    as row number and as ``statement_order``. Repeats stay, as the files of these layouts don't overlap.
    """
    ledger = ledger.withColumns({"source_page_no": F.col("page_no"), "source_row_no": F.col("row_no")})
    groups = _several(ledger, [*by_time, *by_trail])
    merged, rest = _split(ledger, groups)
    timed = posting_order(merged.filter(F.col("bank_id").isin(by_time)), GROUP).withColumn("statement_order", F.col("posting_seq").cast("bigint")).drop("posting_seq", "order_key", "partial_day")
    # row numbers repeat between files, so the rows' own order over all files tells them apart
    files = merged.filter(F.col("bank_id").isin(by_trail))
    files = files.withColumn("ingest_seq", F.row_number().over(Window.partitionBy(*GROUP).orderBy("transaction_time", "source_file", "page_no", "row_no", "ingest_seq")).cast("bigint"))
    trails = euler_order(files, GROUP)
    joined = timed.unionByName(trails.select(*timed.columns)).withColumns({"page_no": F.lit(0), "row_no": F.col("statement_order"), "statement_id": F.concat(F.lit("account:"), "account_no")})
    return joined.unionByName(rest.withColumn("statement_id", F.concat(F.lit("file:"), F.coalesce("source_file", F.lit("")))))


def merge_segments(ledger: DataFrame, layouts: list[str] = SEGMENT_LAYOUTS) -> DataFrame:
    """Files of one account without the rows that they repeat, ordered by balance links; where nothing links a new segment starts.

    Adds ``statement_id``; merged rows are ``segmented_statement`` and have their place as row number. Segments but one
    are gaps that no file covers.
    """
    groups = _several(ledger, layouts)
    merged, rest = _split(ledger, groups)
    one = dedupe(merged)
    one = one.withColumn("ingest_seq", F.row_number().over(Window.partitionBy(*GROUP).orderBy("transaction_time", "page_no", "row_no", "source_file", "ingest_seq")).cast("bigint"))
    ordered = greedy_order(one, GROUP, newest_first=False, segments=True)
    ordered = ordered.withColumns({"segmented_statement": F.lit(True), "page_no": F.lit(0), "row_no": F.col("statement_order"), "statement_id": F.concat(F.lit("account:"), "account_no")})
    rest = rest.withColumn("statement_id", F.concat(F.lit("file:"), F.coalesce("source_file", F.lit(""))))
    return ordered.select(*rest.columns).unionByName(rest)


def covered_parts(parts: DataFrame, ledger: DataFrame, start: datetime | None = None, layouts: list[str] = PART_LAYOUTS) -> DataFrame:
    """Files that together are one printed statement: source_file, statement_id, coverage (complete, or newest pages).

    parts(source_file, bank_id, account_no, first_page, last_page, total_pages, signature): what a file prints. Pages
    of a group are whole if no range leaves a gap after those before it; the newest pages (1 to some page) are enough
    where ``start`` isn't before the earliest row there.
    """
    keys = ["bank_id", "account_no", "total_pages", "signature"]
    known = parts.filter(F.col("bank_id").isin(layouts) & (F.coalesce("account_no", F.lit("")) != "") & F.col("first_page").isNotNull())
    w = Window.partitionBy(*keys).orderBy("first_page", "last_page").rowsBetween(Window.unboundedPreceding, -1)
    gap = F.col("first_page") > F.coalesce(F.max("last_page").over(w), F.lit(0)) + 1
    earliest = ledger.groupBy("source_file").agg(F.min("transaction_time").alias("_since"))
    per = known.withColumn("_gap", gap).join(earliest, "source_file")
    groups = per.groupBy(*keys).agg(F.count_distinct("source_file").alias("_files"), F.max("_gap").alias("_gap"), F.min("first_page").alias("_a"), F.max("last_page").alias("_z"), F.min("_since").alias("_since"))
    prefix = (F.col("_files") > 1) & ~F.col("_gap") & (F.col("_a") == 1)
    late = F.col("_since") <= F.lit(start) if start is not None else F.lit(False)
    how = F.when(prefix & (F.col("_z") == F.col("total_pages")), "complete").when(prefix & late, "newest_pages")
    good = groups.withColumn("coverage", how).filter("coverage IS NOT NULL").select(*keys, "coverage")
    named = F.concat(F.lit("pages:"), "account_no", F.lit(":"), F.coalesce("signature", F.lit("")))
    return known.join(good, keys).select("source_file", named.alias("statement_id"), "coverage")


def merge_page_parts(ledger: DataFrame, parts: DataFrame, start: datetime | None = None) -> DataFrame:
    """Rows with ``statement_id`` and ``coverage``; rows of merged parts carry optional balances and no issues, as only their printed order is sure."""
    merged = ledger.join(covered_parts(parts, ledger, start), "source_file", "left")
    hit = F.col("statement_id").isNotNull()
    return merged.withColumns({
        "balance_optional": F.col("balance_optional") | hit, "status": F.when(hit, "ok").otherwise(F.col("status")),
        "issue_codes": F.when(hit, F.array().cast("array<string>")).otherwise(F.col("issue_codes")),
        "statement_id": F.coalesce("statement_id", F.concat(F.lit("file:"), F.coalesce("source_file", F.lit("")))),
    })
