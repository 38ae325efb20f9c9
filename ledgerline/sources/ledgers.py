"""The ledger's columns, and ledgers derived from the star-schema tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.functions.money import MONEY, zero

#: Every ledger column that operators read, and its type. Missing ones are added with their default.
COLUMNS = {
    "account_no": "string", "account_name": "string", "source_file": "string", "bank": "string", "bank_id": "string", "bank_label": "string", "flow_type": "string",
    "transaction_time": "timestamp", "income": MONEY, "expense": MONEY, "balance": MONEY, "page_no": "int", "row_no": "bigint", "ingest_seq": "bigint",
    "raw_time": "string", "raw_amount": "string", "raw_balance": "string", "raw_text": "string", "raw_fields": "array<string>", "status": "string", "issue_codes": "array<string>",
    "neutral": "boolean", "preserve_signed": "boolean", "balance_optional": "boolean", "balance_tolerance": MONEY, "balance_segment_start": "boolean", "segmented_statement": "boolean",
    "statement_order": "bigint", "merge_key": "string", "repaired": "string",
}


def with_defaults(df: DataFrame) -> DataFrame:
    """The frame with all ledger columns: flags false, money 0 (balance null), status ok, ingest_seq from row_no."""
    default = {"income": zero(), "expense": zero(), "balance_tolerance": zero(), "status": F.lit("ok"), "page_no": F.lit(0), "issue_codes": F.array().cast("array<string>"), "raw_fields": F.array().cast("array<string>")}
    default |= {c: F.lit(False) for c, t in COLUMNS.items() if t == "boolean"}
    have = set(df.columns)
    df = df.withColumns({c: default.get(c, F.lit(None)).cast(t) for c, t in COLUMNS.items() if c not in have})
    filled = {c: F.coalesce(F.col(c), default[c]) for c in default if c in have}
    df = df.withColumns(filled) if filled else df
    return df.withColumn("ingest_seq", F.coalesce("ingest_seq", "row_no"))


def order_key(partial_day: Column) -> Column:
    """Posting order within an account. If any row of a date lacks a clock (``partial_day``) the whole date goes by page
    and row; a proven statement order overrides."""
    proven = F.col("statement_order").isNotNull()
    clock = F.when(proven | partial_day, F.lit(0)).otherwise(F.unix_micros("transaction_time") - F.unix_micros(F.date_trunc("day", "transaction_time")))
    return F.struct(
        F.to_date("transaction_time").alias("day"), clock.cast("bigint").alias("clock"), F.when(proven, 0).otherwise(F.col("page_no")).alias("page"),
        F.coalesce("statement_order", "row_no").alias("row"), F.col("ingest_seq").alias("seq"),
    )


def _running_balance(rows: DataFrame) -> DataFrame:
    running = Window.partitionBy("account_no").orderBy("transaction_time", "row_no").rowsBetween(Window.unboundedPreceding, 0)
    proven = (F.lit(10000) + F.sum(F.col("income") - F.col("expense")).over(running)).cast(MONEY)
    broken = F.when(F.col("row_no") % 97 == 0, None).when(F.col("row_no") % 53 == 0, proven + 1).otherwise(proven)
    return rows.withColumn("balance", broken.cast(MONEY))


def events_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a ledger: signup and click are income, purchase expense, error a reversed expense, view neutral."""
    amount = F.col("value").cast(MONEY)
    kind = F.col("event_type")
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.col("user_id").cast("string").alias("account_no"), F.col("ts").cast("timestamp").alias("transaction_time"), F.col("event_id").alias("row_no"), kind.alias("raw_text"),
        F.when(kind.isin("signup", "click"), amount).otherwise(zero()).cast(MONEY).alias("income"),
        F.when(kind == "purchase", amount).when(kind == "error", -amount).otherwise(zero()).cast(MONEY).alias("expense"),
        (kind == "view").alias("neutral"), F.lit(True).alias("preserve_signed"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("raw_time"),
        amount.cast("string").alias("raw_amount"), F.lit("events").alias("source_file"), F.lit("personal").alias("flow_type"),
    )
    return with_defaults(_running_balance(rows))


def orders_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as a ledger of dates without a clock: F is income, O expense, P neutral."""
    amount = F.col("o_totalprice").cast(MONEY)
    kind = F.col("o_orderstatus")
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        F.col("o_custkey").cast("string").alias("account_no"), F.col("o_orderdate").cast("timestamp").alias("transaction_time"), F.col("o_orderkey").alias("row_no"), F.col("o_orderpriority").alias("raw_text"),
        F.when(kind == "F", amount).otherwise(zero()).cast(MONEY).alias("income"), F.when(kind == "O", amount).otherwise(zero()).cast(MONEY).alias("expense"),
        (kind == "P").alias("neutral"), F.date_format("o_orderdate", "yyyyMMdd").alias("raw_time"), amount.cast("string").alias("raw_amount"),
        F.lit("orders").alias("source_file"), F.when(F.col("o_custkey") % 4 == 0, "corporate").when(F.col("o_custkey") % 4 == 1, "wechat").otherwise("personal").alias("flow_type"),
    )
    return with_defaults(_running_balance(rows))


def overlapping_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders ledger as two exports that overlap."""
    rows = orders_ledger(spark, sf_dir)
    a = rows.filter(F.col("row_no") % 3 != 0).withColumn("source_file", F.lit("a"))
    return a.unionByName(rows.filter(F.col("row_no") % 3 != 1).withColumn("source_file", F.lit("b")))


#: The same ledgers in SQL, for the oracles.
EVENTS_SQL = """
ev0 AS (SELECT event_id AS row_no, CAST(user_id AS VARCHAR) AS account_no, CAST(ts AS TIMESTAMP) AS ts, CAST(value AS DECIMAL(18,2)) AS amt, event_type AS et FROM events),
ev1 AS (SELECT *, CASE WHEN et IN ('signup','click') THEN amt ELSE CAST(0 AS DECIMAL(18,2)) END AS income,
          CASE WHEN et = 'purchase' THEN amt WHEN et = 'error' THEN -amt ELSE CAST(0 AS DECIMAL(18,2)) END AS expense, et = 'view' AS neutral FROM ev0),
ev2 AS (SELECT *, CAST(10000 + SUM(income - expense) OVER (PARTITION BY account_no ORDER BY ts, row_no ROWS UNBOUNDED PRECEDING) AS DECIMAL(18,2)) AS bal0 FROM ev1),
ledger AS (SELECT *, CAST(CASE WHEN row_no % 97 = 0 THEN NULL WHEN row_no % 53 = 0 THEN bal0 + 1 ELSE bal0 END AS DECIMAL(18,2)) AS balance, true AS preserve_signed,
          'events' AS source_file, 'personal' AS flow_type, CAST(amt AS VARCHAR) AS raw_amount, et AS raw_text,
          row_number() OVER (PARTITION BY account_no ORDER BY ts, row_no) AS seq FROM ev2)"""
ORDERS_SQL = """
or0 AS (SELECT o_orderkey AS row_no, CAST(o_custkey AS VARCHAR) AS account_no, o_custkey AS ck, CAST(o_orderdate AS TIMESTAMP) AS ts, CAST(o_totalprice AS DECIMAL(18,2)) AS amt, o_orderstatus AS st, o_orderpriority AS raw_text FROM orders),
or1 AS (SELECT *, CASE WHEN st = 'F' THEN amt ELSE CAST(0 AS DECIMAL(18,2)) END AS income, CASE WHEN st = 'O' THEN amt ELSE CAST(0 AS DECIMAL(18,2)) END AS expense, st = 'P' AS neutral FROM or0),
or2 AS (SELECT *, CAST(10000 + SUM(income - expense) OVER (PARTITION BY account_no ORDER BY ts, row_no ROWS UNBOUNDED PRECEDING) AS DECIMAL(18,2)) AS bal0 FROM or1),
ledger AS (SELECT *, CAST(CASE WHEN row_no % 97 = 0 THEN NULL WHEN row_no % 53 = 0 THEN bal0 + 1 ELSE bal0 END AS DECIMAL(18,2)) AS balance, false AS preserve_signed, 'orders' AS source_file,
          CASE WHEN ck % 4 = 0 THEN 'corporate' WHEN ck % 4 = 1 THEN 'wechat' ELSE 'personal' END AS flow_type, CAST(amt AS VARCHAR) AS raw_amount,
          row_number() OVER (PARTITION BY account_no ORDER BY ts, row_no) AS seq FROM or2)"""
FILES_SQL = ORDERS_SQL + """,
files AS (SELECT * REPLACE ('a' AS source_file) FROM ledger WHERE row_no % 3 <> 0 UNION ALL SELECT * REPLACE ('b' AS source_file) FROM ledger WHERE row_no % 3 <> 1)"""
