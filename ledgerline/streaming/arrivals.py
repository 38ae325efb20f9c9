"""Statement rows that arrive as a stream: repeats dropped, monthly totals, and the balance chain by account."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ledgerline.functions.money import MONEY
from ledgerline.operators.dedupe import SIGNATURE

BREAKS = "account_no string, row_no bigint, expected bigint, balance bigint"


def ledger_stream(spark: SparkSession, path: str, schema, files_at_once: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(path)


def without_repeats(rows: DataFrame, late: str = "30 days") -> DataFrame:
    """Rows of overlapping exports once, as long as they arrive within the watermark."""
    return rows.withWatermark("transaction_time", late).dropDuplicatesWithinWatermark([c for c in SIGNATURE if c in rows.columns])


def period_totals(rows: DataFrame, window: str = "30 days", late: str = "30 days") -> DataFrame:
    """Totals of each account by window; state is dropped behind the watermark."""
    w = F.window("transaction_time", window)
    return rows.withWatermark("transaction_time", late).groupBy("account_no", w).agg(F.count("*").alias("rows"), F.sum("income").cast(MONEY).alias("income_sum"), F.sum("expense").cast(MONEY).alias("expense_sum"))


def chain_breaks(rows: DataFrame) -> DataFrame:
    """Breaks of the balance across micro-batches; the state is one balance (in cents) an account.

    Rows are put in order within a batch only: a row that arrives in a later batch than the rows after it is taken as the
    next one, and shows as a break there. Sources that deliver late must be ordered before.
    """

    def check(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        held = pd.concat(list(batches)).sort_values(["transaction_time", "row_no"])
        out = []
        for r in held.itertuples():
            if r.balance_cents is None or pd.isna(r.balance_cents):
                last = None
                continue
            if last is not None and last + r.net_cents != r.balance_cents:
                out.append((key[0], r.row_no, last + r.net_cents, int(r.balance_cents)))
            last = int(r.balance_cents)
        state.update((last,))
        yield pd.DataFrame(out, columns=["account_no", "row_no", "expected", "balance"])

    cents = rows.select("account_no", "transaction_time", "row_no", (F.col("balance") * 100).cast("bigint").alias("balance_cents"), ((F.col("income") - F.col("expense")) * 100).cast("bigint").alias("net_cents"))
    return cents.groupBy("account_no").applyInPandasWithState(check, BREAKS, "last bigint", "append", GroupStateTimeout.NoTimeout)
