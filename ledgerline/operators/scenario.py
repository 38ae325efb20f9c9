"""What-if scenarios. They live in tables of their own (``is_observed`` false) and never replace observed figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.money import MONEY, half_even, half_up, zero


def split_evenly(months: DataFrame, total: Column, keys=()) -> DataFrame:
    """``share`` of each month; the last month takes the remainder."""
    w = Window.partitionBy(*keys)
    n = F.count("*").over(w)
    even = half_even(total / n)
    last = F.row_number().over(w.orderBy("month")) == n
    return months.withColumn("share", F.when(last, total - even * (n - 1)).otherwise(even).cast(MONEY))


def split_by_weight(rows: DataFrame, total: Column, weight: str, order: str, keys=()) -> DataFrame:
    """``share`` in proportion to the weight; the last row takes the remainder, equal shares where all weights are 0."""
    w = Window.partitionBy(*keys)
    n, whole = F.count("*").over(w), F.sum(weight).over(w)
    ratio = F.when(whole == 0, 1.0 / n).otherwise(F.col(weight).cast("double") / whole.cast("double"))
    df = rows.withColumn("_part", half_even((total * ratio).cast("decimal(28,6)"))).withColumn("_last", F.row_number().over(w.orderBy(order)) == n)
    others = F.sum(F.when(~F.col("_last"), F.col("_part")).otherwise(zero())).over(w)
    return df.withColumn("share", F.when(F.col("_last"), total - others).otherwise(F.col("_part")).cast(MONEY)).drop("_part", "_last")


def scenario_months(observed: DataFrame, deltas: DataFrame, scenario_id: str, keys=("account_no",)) -> DataFrame:
    """observed(keys, month, income_sum, expense_sum, opening_balance), deltas(keys, month, income_delta, expense_delta)
    -> the scenario's months with running opening and closing; a negative closing is for review."""
    df = observed.join(deltas, [*keys, "month"], "left").fillna(0, ["income_delta", "expense_delta"])
    w = Window.partitionBy(*keys).orderBy("month")
    net = F.col("income_sum") + F.col("income_delta") - F.col("expense_sum") - F.col("expense_delta")
    closing = F.first("opening_balance", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.sum(net).over(w.rowsBetween(Window.unboundedPreceding, 0))
    df = df.withColumn("closing", closing.cast(MONEY)).withColumn("opening", (F.col("closing") - net).cast(MONEY))
    return df.select(F.lit(scenario_id).alias("scenario_id"), *keys, "month", F.col("income_sum").alias("observed_income"), F.col("expense_sum").alias("observed_expense"), F.col("income_delta").cast(MONEY).alias("income_delta"), F.col("expense_delta").cast(MONEY).alias("expense_delta"), "opening", "closing", F.when(F.col("closing") < 0, "review").otherwise("ok").alias("status"), F.when((F.col("income_delta") == 0) & (F.col("expense_delta") == 0), "no_change").alias("note"), F.lit(False).alias("is_observed"))


def with_totals(scenario: DataFrame, keys=("account_no",)) -> DataFrame:
    """The scenario's months and, in a row without a month, its total: sums, first opening, last closing, review if any month is."""
    sums = [F.sum(c).cast(MONEY).alias(c) for c in ("observed_income", "observed_expense", "income_delta", "expense_delta")]
    total = scenario.groupBy("scenario_id", *keys).agg(*sums, F.min_by("opening", "month").alias("opening"), F.max_by("closing", "month").alias("closing"), F.when(F.bool_or(F.col("status") == "review"), "review").otherwise("ok").alias("status"))
    total = total.withColumns({"month": F.lit(None).cast("string"), "note": F.lit("total"), "is_observed": F.lit(False)})
    return scenario.unionByName(total.select(*scenario.columns))


def parameter_rows(scenarios: DataFrame, months: DataFrame) -> DataFrame:
    """scenarios(scenario_id, label, amount, first_month, last_month, enabled), months(month) -> scenario_id, parameter, value.

    Enabled scenarios without an amount give a warning and no other row.
    """
    on = scenarios.filter("enabled")
    span = months.select("month").distinct().join(on, (F.col("month") >= F.col("first_month")) & (F.col("month") <= F.col("last_month")))  # months of a calendar by a few scenarios
    n = span.groupBy("scenario_id").agg(F.count("*").alias("n"))
    df = on.join(n, "scenario_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    each = F.when(F.col("n") > 0, half_even((F.col("amount") / F.col("n")).cast("decimal(28,6)"))).otherwise(zero())
    pairs = [("label", F.col("label")), ("amount", F.col("amount").cast(MONEY).cast("string")), ("months", F.concat("first_month", F.lit(" to "), "last_month")), ("month_count", F.col("n").cast("string")), ("by_month", each.cast("string"))]
    rows = F.array(*[F.struct(F.lit(k).alias("parameter"), v.alias("value")) for k, v in pairs])
    warned = F.array(F.struct(F.lit("warning").alias("parameter"), F.concat("label", F.lit(" has no amount")).alias("value")))
    return df.select("scenario_id", F.explode(F.when(F.coalesce("amount", F.lit(0)) == 0, warned).otherwise(rows)).alias("x")).select("scenario_id", "x.*")


def allocate_by_flow(observed: DataFrame, amounts: DataFrame) -> DataFrame:
    """A month's amount over its flows: by observed income, else by observed expense, else equally; remainder to the last flow."""
    w = Window.partitionBy("month")
    weight = F.when(F.sum("income_sum").over(w) > 0, F.col("income_sum")).otherwise(F.col("expense_sum"))
    df = observed.withColumn("_w", weight).join(amounts, "month")
    return split_by_weight(df, F.col("amount"), "_w", "flow_type", ["month"]).drop("_w")


def balance_check(df: DataFrame) -> DataFrame:
    """Difference of observed and scenario closing, and its label."""
    delta = (F.col("closing") - F.col("observed_closing")).cast(MONEY)
    return df.withColumn("delta", delta).withColumn("label", F.when(delta.isNull(), "unknown").when(delta == 0, "unchanged").when(delta > 0, "higher").otherwise("lower"))


def earnings_check(observed_total: Column, share_percent: Column, margin_percent: Column, declared: Column) -> dict[str, Column]:
    """Observed income by six months times share and margin against the declared figure."""
    earned = half_up((observed_total / 6 * share_percent / 100 * margin_percent / 100).cast("decimal(28,6)"))
    return {"earned": earned, "surplus": F.greatest(earned - declared, zero()).cast(MONEY), "shortfall": F.greatest(declared - earned, zero()).cast(MONEY)}
