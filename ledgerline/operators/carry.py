"""Numbering and looking back along statements of any length: one account may fill many tasks.

A window over an account is one task, however long the account is. Here rows are dealt by ranges of (account, order), so
a huge account lies in many neighbouring partitions. Each row is numbered, and looks back, inside its own partition;
what a partition begins with (how many rows came before, what the last of them held) is reduced to one row for each account
and partition, and joined back. Results equal the windows'; for accounts of ordinary size the windows move less.
The repairs of ``chain`` take ``look=carry.beside`` for such accounts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.operators import chain, ordering
from ledgerline.sources import io


def beside(rows: DataFrame, keys: list[str], order=("posting_seq",), back=(), ahead=(), known=(), number: str | None = None, partitions: int | None = None) -> DataFrame:
    """As ``chain.beside``, over many tasks: ``_prev_<c>`` and ``_next_<c>`` are the row before's and after's values,
    ``_known_<c>`` the last value before the row that isn't null, ``number`` names a column that counts a key's rows from 1.

    ``order`` must tell a key's rows apart, else rows that are equal in it come in any order. Null keys are one key.
    """
    n = partitions or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # written once: the ranges are drawn from a sample, and all that follows must see the same ones
    dealt = io.written(rows.repartitionByRange(n, *keys, *order).withColumn("_part", F.spark_partition_id()), "carry")
    own = Window.partitionBy(*keys, "_part").orderBy(*order)
    earlier = own.rowsBetween(Window.unboundedPreceding, -1)
    state = lambda names: F.struct(F.lit(True).alias("_"), *names)
    at = F.struct(*order)
    local = dealt.withColumns({"_i": F.row_number().over(own), "_p": F.lag(state(back)).over(own), "_f": F.lead(state(ahead)).over(own)} | {f"_known_{c}": F.last(c, ignorenulls=True).over(earlier) for c in known})
    ends = dealt.groupBy(*keys, "_part").agg(F.count("*").alias("_n"), F.max_by(state(back), at).alias("_last"), F.min_by(state(ahead), at).alias("_first"), *[F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(f"_end_{c}") for c in known])
    parts = Window.partitionBy(*keys).orderBy("_part")
    upto = parts.rowsBetween(Window.unboundedPreceding, -1)
    carried = {"_before": F.coalesce(F.sum("_n").over(upto), F.lit(0)), "_carry": F.lag("_last").over(parts), "_follow": F.lead("_first").over(parts)}
    ends = ends.withColumns(carried | {f"_end_{c}": F.last(f"_end_{c}", ignorenulls=True).over(upto) for c in known})
    ends = ends.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_part").alias("_k_part"), *carried, *[f"_end_{c}" for c in known])
    same = F.col("_part") == F.col("_k_part")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    out, p, f = local.join(ends, same), F.coalesce("_p", "_carry"), F.coalesce("_f", "_follow")
    numbered = [(F.col("_before") + F.col("_i")).cast("bigint").alias(number)] if number else []
    return out.select(*rows.columns, *numbered, *[p[c].alias(f"_prev_{c}") for c in back], *[f[c].alias(f"_next_{c}") for c in ahead], *[F.coalesce(f"_known_{c}", f"_end_{c}").alias(f"_known_{c}") for c in known])


def in_sequence(rows: DataFrame, keys: list[str], order: list[str], carried: list[str], partitions: int | None = None) -> DataFrame:
    """``posting_seq``, 1 for a key's first row, and ``prev_<c>`` for each column of ``carried``: its value on the row before; ``order`` as in ``beside``."""
    return beside(rows, keys, order, carried, number="posting_seq", partitions=partitions).withColumnsRenamed({f"_prev_{c}": f"prev_{c}" for c in carried})


def posting_order(ledger: DataFrame, keys=ordering.ACCOUNT, partitions: int | None = None) -> DataFrame:
    """As ``ordering.posting_order``, and the balance of the row before (``prev_balance``, ``prev_balance_optional``); only a day's rows must fit a task."""
    from ledgerline.sources.ledgers import order_key

    keyed = ordering.mark_partial_days(ledger, keys).withColumn("order_key", order_key(F.col("partial_day")))
    return in_sequence(keyed, list(keys), ["order_key"], ["balance", "balance_optional"], partitions)


def balance_breaks(ledger: DataFrame, keys=ordering.ACCOUNT, partitions: int | None = None) -> DataFrame:
    """As ``chain.balance_breaks``, of a ledger that needs no order yet."""
    return chain.broken(posting_order(ledger, keys, partitions).withColumnRenamed("prev_balance_optional", "prev_optional"))
