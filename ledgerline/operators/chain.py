"""Checks and repairs along the running balance. All need ``posting_seq`` (ordering.posting_order)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.money import MONEY, supported_by, zero
from ledgerline.operators.ordering import ACCOUNT

ISSUE = ["account_no", "level", "code", "posting_seq", "time", "raw_amount", "raw_balance"]


def beside(rows: DataFrame, keys=ACCOUNT, order=("posting_seq",), back=(), ahead=(), known=(), number: str | None = None) -> DataFrame:
    """``_prev_<c>`` and ``_next_<c>``: values on the row before and after; ``_known_<c>``: the last one before that isn't null; ``number`` counts rows.

    An account is one task here. What looks beside its rows takes another ``look``: ``carry.beside`` deals an account to many tasks.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    cols = {number: F.row_number().over(w).cast("bigint")} if number else {}
    cols |= {f"_prev_{c}": F.lag(c).over(w) for c in back} | {f"_next_{c}": F.lead(c).over(w) for c in ahead}
    return rows.withColumns(cols | {f"_known_{c}": F.last(c, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)) for c in known})


def net() -> Column:
    return F.col("income") - F.col("expense")


def balance_breaks(ordered: DataFrame, keys=ACCOUNT, look=beside) -> DataFrame:
    """Rows whose balance doesn't follow from the row before, with expected balance and level (low_risk within tolerance)."""
    found = look(ordered.drop("prev_balance", "prev_optional"), keys, back=["balance", "balance_optional"])
    return broken(found.withColumnsRenamed({"_prev_balance": "prev_balance", "_prev_balance_optional": "prev_optional"}))


def broken(df: DataFrame) -> DataFrame:
    """Of rows that know the balance before (``prev_balance``, ``prev_optional``) those that don't follow from it."""
    df = df.withColumn("expected", (F.col("prev_balance") + net()).cast(MONEY))
    off = ~F.col("prev_optional") & ~F.col("balance_optional") & ~F.col("balance_segment_start") & (F.col("expected") != F.col("balance"))
    level = F.when(F.abs(F.col("expected") - F.col("balance")) <= F.col("balance_tolerance"), "low_risk").otherwise("review")
    return df.filter(off).withColumn("level", level)


def row_issues(ordered: DataFrame, keys=ACCOUNT, look=beside) -> DataFrame:
    """Issues of single rows in long form: parse codes (or ``parse_status``), missing balances, breaks of the balance."""
    at = [*keys, "posting_seq", F.date_format("transaction_time", "yyyy-MM-dd HH:mm:ss").alias("time"), "raw_amount", "raw_balance"]
    bad = (F.col("status") != "ok") | (F.size("issue_codes") > 0)
    codes = F.when(F.size("issue_codes") > 0, F.col("issue_codes")).otherwise(F.array(F.lit("parse_status")))
    missing = F.col("balance").isNull() & ~F.col("balance_optional")
    own = F.concat(F.when(bad, codes).otherwise(F.array().cast("array<string>")), F.when(missing, F.array(F.lit("balance_missing"))).otherwise(F.array().cast("array<string>")))
    long = ordered.select(*at, F.lit("review").alias("level"), F.explode(own).alias("code"))
    return long.unionByName(balance_breaks(ordered, keys, look).select(*at, "level", F.lit("balance_break").alias("code")))


def total_closure(summary: DataFrame) -> DataFrame:
    """Accounts whose net differs from the change of their balance, unless exempt (all rows optional, segmented or wallet)."""
    change = (F.col("closing_balance") - F.col("opening_balance")).cast(MONEY)
    return summary.withColumn("balance_change", change).filter(~F.col("closure_exempt") & (F.col("net") != change))


def mark_optional_dates(ordered: DataFrame, words=("利息", "结息"), keys=ACCOUNT, look=beside) -> DataFrame:
    """Dates with an interest row, or with a row after 23:00 whose balance links to one just past midnight, carry optional balances."""
    interest = F.regexp_like(F.coalesce("raw_text", F.lit("")), F.lit("|".join(words)))
    late = (F.hour("transaction_time") == 23) & (F.hour("_next_transaction_time") == 0) & (F.col("_next_balance") == F.col("balance") + F.col("_next_income") - F.col("_next_expense"))
    day = Window.partitionBy(*keys, F.to_date("transaction_time"))
    ahead = ["transaction_time", "balance", "income", "expense"]
    df = look(ordered, keys, ahead=ahead).withColumn("_mark", interest | F.coalesce(late, F.lit(False)))
    return df.withColumn("balance_optional", F.col("balance_optional") | F.max("_mark").over(day)).drop("_mark", *[f"_next_{c}" for c in ahead])


def amounts_from_balance(ordered: DataFrame, keep_side: bool = False, keys=ACCOUNT, look=beside) -> DataFrame:
    """The amount becomes the change of the balance wherever both balances are known; ``keep_side`` leaves a reversal, as a
    negative amount, on the side that the row was printed on. Raw columns stay, ``repaired`` tells what changed."""
    delta = (F.col("balance") - F.col("_prev_balance")).cast(MONEY)
    differs = delta.isNotNull() & (delta != net())
    income = F.when((F.col("income") != 0) | (F.col("expense") == 0), delta).otherwise(zero()) if keep_side else F.greatest(delta, zero())
    expense = F.when((F.col("income") != 0) | (F.col("expense") == 0), zero()).otherwise(-delta) if keep_side else F.greatest(-delta, zero())
    df = look(ordered, keys, back=["balance"]).withColumns({"_d": differs, "_i": income.cast(MONEY), "_e": expense.cast(MONEY)})
    out = {"income": F.when(F.col("_d"), F.col("_i")).otherwise(F.col("income")), "expense": F.when(F.col("_d"), F.col("_e")).otherwise(F.col("expense")), "repaired": F.when(F.col("_d"), "amount_from_balance").otherwise(F.col("repaired"))}
    return df.withColumns(out).drop("_d", "_i", "_e", "_prev_balance")


def direction_from_balance(ordered: DataFrame, amount: str, words: dict[str, str] | None = None, keys=ACCOUNT, look=beside) -> DataFrame:
    """Income or expense for unsigned amounts: from the balance's change, else from words in the text, else an issue."""
    moved = F.col("balance") - F.col("_prev_balance")
    x = F.abs(F.col(amount))
    side = F.when(moved == x, "in").when(moved == -x, "out")
    for rx, to in (words or {}).items():
        side = side.when(F.regexp_like(F.coalesce("raw_text", F.lit("")), F.lit(rx)), to)
    df = look(ordered, keys, back=["balance"]).withColumn("_side", side).withColumn("_amount", x)
    codes = F.when(F.col("_side").isNull(), F.array_append("issue_codes", F.lit("direction_unknown"))).otherwise(F.col("issue_codes"))
    return df.withColumns({"income": F.when(F.col("_side") == "in", F.col("_amount")).otherwise(zero()).cast(MONEY), "expense": F.when(F.col("_side") == "out", F.col("_amount")).otherwise(zero()).cast(MONEY), "issue_codes": codes}).drop("_side", "_amount", "_prev_balance")


def without_reversal_pairs(ordered: DataFrame, keys=ACCOUNT, look=beside) -> DataFrame:
    """Drops adjacent rows that cancel out exactly and bring the balance back."""
    df = look(ordered, keys, ahead=["income", "expense", "balance"], number="_at")
    back = (F.col("_next_income") - F.col("_next_expense") == -net()) & (net() != 0) & (F.col("_next_balance") == F.col("balance") - net())
    df = df.withColumn("_opens", F.coalesce(back, F.lit(False))).withColumn("_stop", F.when(~F.col("_opens"), F.col("_at")))
    df = look(df, keys, back=["_opens"], known=["_stop"])
    # of a run of such links every second one counts, so that no row is in two pairs
    k = F.col("_at") - F.coalesce("_known__stop", F.lit(0))
    paired = (F.col("_opens") & (k % 2 == 1)) | (F.coalesce("_prev__opens", F.lit(False)) & (k % 2 == 0))
    return df.filter(~paired).drop("_at", "_opens", "_stop", "_prev__opens", "_known__stop", "_next_income", "_next_expense", "_next_balance")


def reversals_to_expense(ordered: DataFrame, words=("冲正", "退回")) -> DataFrame:
    """Income of reversal rows moves to the expense side as a negative amount; counts then keep both rows."""
    hit = F.regexp_like(F.coalesce("raw_text", F.lit("")), F.lit("|".join(words))) & (F.col("income") > 0)
    df = ordered.withColumn("_hit", hit)
    return df.withColumns({"expense": F.when(F.col("_hit"), -F.col("income")).otherwise(F.col("expense")).cast(MONEY), "income": F.when(F.col("_hit"), zero()).otherwise(F.col("income")).cast(MONEY), "preserve_signed": F.col("preserve_signed") | F.col("_hit"), "repaired": F.when(F.col("_hit"), "signed_reversal").otherwise(F.col("repaired"))}).drop("_hit")


def flipped_by_balance(ordered: DataFrame, keys=ACCOUNT, look=beside) -> DataFrame:
    """Rows printed with the wrong sign: if only the opposite amount links the balances, the sides are swapped."""
    flip = F.coalesce((F.col("balance") - F.col("_prev_balance") == -net()) & (net() != 0), F.lit(False))
    df = look(ordered, keys, back=["balance"]).withColumns({"_flip": flip, "_i": F.col("income"), "_e": F.col("expense")})
    return df.withColumns({"income": F.when(F.col("_flip"), F.col("_e")).otherwise(F.col("_i")), "expense": F.when(F.col("_flip"), F.col("_i")).otherwise(F.col("_e")), "repaired": F.when(F.col("_flip"), "sides_swapped").otherwise(F.col("repaired"))}).drop("_flip", "_i", "_e", "_prev_balance")


def without_unmoved(ordered: DataFrame, keys=ACCOUNT, look=beside) -> DataFrame:
    """Drops rows with an amount whose balance didn't move (the dropped row's balance equals the last kept one's, so ``lag`` suffices)."""
    still = F.coalesce((F.col("_prev_balance") == F.col("balance")) & (net() != 0), F.lit(False))
    return look(ordered, keys, back=["balance"]).withColumn("_still", still).filter(~F.col("_still")).drop("_still", "_prev_balance")


def plausible_amounts(ordered: DataFrame, reliable: str, keys=ACCOUNT, look=beside) -> DataFrame:
    """The amount is replaced by the balance's change if one balance is reliable, the gap at least 0.02 and the ratio in 0.05 to 20."""
    change = F.col("balance") - F.col("_prev_balance")
    trusted = F.col(reliable) | F.coalesce(f"_prev_{reliable}", F.lit(False))
    ratio = F.abs(change) / F.when(net() != 0, F.abs(net()))
    swap = F.coalesce(trusted & (F.abs(change - net()) >= 0.02) & ratio.between(0.05, 20), F.lit(False))
    df = look(ordered, keys, back=["balance", reliable]).withColumns({"_swap": swap, "_c": change})
    return df.withColumns({"income": F.when(F.col("_swap"), F.greatest(F.col("_c"), zero())).otherwise(F.col("income")).cast(MONEY), "expense": F.when(F.col("_swap"), F.greatest(-F.col("_c"), zero())).otherwise(F.col("expense")).cast(MONEY), "repaired": F.when(F.col("_swap"), "plausible_amount").otherwise(F.col("repaired"))}).drop("_swap", "_c", "_prev_balance", f"_prev_{reliable}")


def page_totals(rows: DataFrame, total: str, keys=("source_file",), look=beside) -> DataFrame:
    """As-of: each row gets the last printed page total at or before it, ``page_total``."""
    return look(rows, list(keys), order=["row_no"], known=[total]).withColumn("page_total", F.coalesce(total, f"_known_{total}")).drop(f"_known_{total}")


def page_total_repair(rows: DataFrame, page: str, keys=("source_file",)) -> DataFrame:
    """Where a page's income misses its printed total, the one row whose raw digits allow the difference is put right; not if several do."""
    whole = Window.partitionBy(*keys, page)
    missing = F.col("page_total") - F.sum("income").over(whole)
    df = rows.withColumn("_want", (F.col("income") + missing).cast(MONEY)).withColumn("_miss", missing)
    fits = F.coalesce((F.col("_miss") != 0) & (F.col("_want") > 0) & supported_by(F.col("_want"), F.concat(F.lit("+"), F.col("raw_amount"))), F.lit(False))
    df = df.withColumn("_fits", fits)
    df = df.withColumn("_one", F.col("_fits") & (F.sum(F.col("_fits").cast("int")).over(whole) == 1))
    return df.withColumns({"income": F.when(F.col("_one"), F.col("_want")).otherwise(F.col("income")), "repaired": F.when(F.col("_one"), "page_total").otherwise(F.col("repaired"))}).drop("_want", "_miss", "_fits", "_one")
