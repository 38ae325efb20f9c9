"""File status and confidence scores from summaries and issues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.operators.ordering import ACCOUNT


def issue_counts(issues: DataFrame, keys=ACCOUNT) -> DataFrame:
    review = F.col("level") == "review"
    return issues.groupBy(*keys).agg(F.count_if(review).alias("reviews"), F.count_if(~review).alias("low_risks"), F.max(review & (F.col("code") == "balance_break")).alias("has_break"))


def last_two_months(monthly: DataFrame, monthly_issues: DataFrame, keys=ACCOUNT, end: str | None = None) -> DataFrame:
    """Whether both of the last two months (of the range, else of the rows) have rows, and whether both close without a review issue."""
    months = monthly.join(monthly_issues, [*keys, "month"], "left")
    last = F.lit(end) if end else F.max("month").over(Window.partitionBy(*keys))
    prior = F.date_format(F.add_months(F.to_date(F.concat(last, F.lit("-01"))), -1), "yyyy-MM")
    closed = (F.col("closure_exempt") | F.coalesce(F.col("net") == F.col("closing_balance") - F.col("opening_balance"), F.lit(False))) & (F.coalesce("reviews", F.lit(0)) == 0)
    df = months.withColumns({"_last": last}).withColumn("_in", F.col("month").isin(F.col("_last")) | (F.col("month") == prior)).withColumn("_closed", closed)
    return df.filter("_in").groupBy(*keys).agg((F.count("*") == 2).alias("recent"), ((F.count("*") == 2) & F.min("_closed")).alias("recent_closed"))


def file_scores(summary: DataFrame, issues: DataFrame, recent: DataFrame, keys=ACCOUNT, base: Column | None = None, message: Column | None = None) -> DataFrame:
    """Score 0 to 100 of each statement: base by how it was read, minus issues, plus a closed balance and recent months, minus 8 for a review ``message``."""
    df = summary.join(issues, keys, "left").join(recent, keys, "left").fillna({"reviews": 0, "low_risks": 0})
    has = lambda c: F.coalesce(c, F.lit(False))
    known = F.col("opening_balance").isNotNull() & F.col("closing_balance").isNotNull()
    closes = has(F.col("net") == F.col("closing_balance") - F.col("opening_balance"))
    balance = F.when(F.col("closure_exempt"), 6).when(known & closes & ~has(F.col("has_break")), 26).when(known & closes, 10).when(known, -24).otherwise(-6)
    months = F.when(has(F.col("recent")), 8).otherwise(0) + F.when(has(F.col("recent")) & has(F.col("recent_closed")), 14).otherwise(0)
    start = base if base is not None else F.lit(80)
    raw = start - F.least(F.lit(22), F.col("reviews") * 6) - F.least(F.lit(8), F.col("low_risks") * 2) + balance + months - (F.when(message, 8).otherwise(0) if message is not None else F.lit(0))
    score = F.when(F.col("count") <= 0, 0).otherwise(F.greatest(F.lit(0), F.least(F.lit(100), raw))).cast("int")
    return df.withColumn("score", score).select(*keys, "count", "reviews", "low_risks", "score")


def base_score(bank_id: Column, confidence: Column, generic: Column) -> Column:
    return F.when(generic, 68).when(bank_id == "excel", 86).otherwise(F.least(F.lit(94), F.greatest(F.lit(78), F.coalesce(confidence, F.lit(80)))))


def overall_score(scores: DataFrame) -> DataFrame:
    """One row: scores weighted by rows (half to even), minus issues; level high from 90, medium from 70."""
    live = scores.filter("count > 0")
    agg = live.agg(F.bround(F.sum(F.col("score") * F.col("count")) / F.sum("count"), 0).cast("bigint").alias("s"), F.sum("reviews").alias("r"), F.sum("low_risks").alias("l"))
    score = F.greatest(F.lit(0), F.least(F.lit(100), F.coalesce("s", F.lit(0)) - F.least(F.lit(18), F.coalesce(F.col("r") * 4, F.lit(0))) - F.least(F.lit(6), F.coalesce("l", F.lit(0))))).cast("int")
    return agg.select(score.alias("score")).withColumn("level", F.when(F.col("score") >= 90, "high").when(F.col("score") >= 70, "medium").otherwise("low"))


def very_high(statements: DataFrame, keys=()) -> DataFrame:
    """For each batch (``keys``) true if every statement has rows and no issue, none is a spreadsheet, and generic ones close."""
    fine = (F.col("count") > 0) & (F.col("reviews") + F.col("low_risks") == 0) & (F.col("bank_id") != "excel") & (~F.col("generic") | F.col("closed"))
    return statements.groupBy(*keys).agg(F.coalesce(F.bool_and(fine), F.lit(False)).alias("very_high"))


def file_status(rows: Column, in_range: Column, reviews: Column, generic: Column) -> Column:
    return F.when(rows == 0, "no_rows").when(in_range == 0, "no_rows_in_range").when(reviews > 0, "review").when(generic, "generic").otherwise("normal")


def batch_status(df: DataFrame, overrides: DataFrame | None = None, key: str = "source_file") -> DataFrame:
    """Status codes of a batch from columns error, ignored, recognised, rows, reviews, generic; listed overrides pass."""
    status = (
        F.when(F.col("ignored").isNotNull(), F.concat(F.lit("IGNORE_"), F.upper("ignored"))).when(F.col("error").isNotNull(), "PARSE_ERROR").when(~F.col("recognised"), "UNRECOGNIZED")
        .when(F.col("rows") == 0, "NO_ROWS").when(F.col("generic") & (F.col("reviews") > 0), "GENERIC_REVIEW").when(F.col("reviews") > 0, "REVIEW").when(F.col("generic"), "GENERIC_PASS").otherwise("PASS")
    )
    out = df.withColumn("status", status)
    if overrides is None:
        return out
    passed = overrides.select(key).distinct().withColumn("_pass", F.lit(True))
    return out.join(passed, key, "left").withColumn("status", F.when(F.col("_pass") & F.col("status").isin("REVIEW", "GENERIC_REVIEW"), "MANUAL_PASS").otherwise(F.col("status"))).drop("_pass")


def counts_by(df: DataFrame, c: str) -> DataFrame:
    """Rows by value, most common first."""
    return df.groupBy(c).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), c)


def accounts(statements: DataFrame) -> DataFrame:
    """Account records with a review flag: confidence under 90, or no bank."""
    return statements.select("account_no", "account_name", "bank_id", ((F.coalesce("bank_confidence", F.lit(0)) < 90) | F.col("bank_id").isNull()).alias("needs_review"))
