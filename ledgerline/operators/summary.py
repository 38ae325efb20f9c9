"""Summaries of a ledger by any keys; two-phase aggregates, no windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.money import MONEY, half_up, zero
from ledgerline.functions.text import has_clock, month_key
from ledgerline.operators.ordering import ACCOUNT
from ledgerline.operators.parse import with_layout
from ledgerline.sources.ledgers import order_key

MONTHS = 6  # monthly averages divide by this, however many months there are


def counting() -> dict[str, Column]:
    """Counts and sums of a ledger. Signed rows count a side that isn't 0; others count as income when
    income - expense >= 0 (a zero row does), and as expense when expense > 0. Neutral rows don't count."""
    live = ~F.col("neutral")
    signed = F.col("preserve_signed")
    gets = live & F.when(signed, F.col("income") != 0).otherwise(F.col("income") - F.col("expense") >= 0)
    pays = live & F.when(signed, F.col("expense") != 0).otherwise(F.col("expense") > 0)
    total = lambda c, cond: F.coalesce(F.sum(F.when(cond, F.col(c))), F.lit(0)).cast(MONEY)
    return {
        "count": F.count_if(live), "income_count": F.count_if(gets), "income_sum": total("income", gets),
        "expense_count": F.count_if(pays), "expense_sum": total("expense", pays),
    }


def summarize(ledger: DataFrame, keys=ACCOUNT) -> DataFrame:
    """One row for each value of ``keys``: counts, sums, net, opening and closing balance (null if that row has none).

    Rows are aggregated by day first: a day knows whether all its rows have a clock, and so which of its two orders
    holds, and its first and last row in both. Both steps combine before they shuffle; no row is sorted across tasks.
    """
    ends = F.struct("balance", "income", "expense")
    by_clock, by_page = order_key(F.lit(False)), order_key(F.lit(True))
    exempt = {"_optional": "balance_optional", "_segmented": "segmented_statement"}
    days = ledger.groupBy(*keys, F.to_date("transaction_time").alias("_day")).agg(
        *[c.alias(n) for n, c in counting().items()], *[F.bool_and(c).alias(n) for n, c in exempt.items()], F.bool_and(F.coalesce("bank_id", F.lit("")) == "wechat").alias("_wallet"),
        F.bool_or(~has_clock(F.col("raw_time"))).alias("_partial"), F.min_by(ends, by_clock).alias("_fc"), F.min_by(ends, by_page).alias("_fp"), F.max_by(ends, by_clock).alias("_lc"), F.max_by(ends, by_page).alias("_lp"),
    )
    first, last = (F.when(F.col("_partial"), F.col(p)).otherwise(F.col(c)) for p, c in (("_fp", "_fc"), ("_lp", "_lc")))
    sums = [F.sum(c).alias(c) for c in ("count", "income_count", "expense_count")] + [F.sum(c).cast(MONEY).alias(c) for c in ("income_sum", "expense_sum")]
    agg = days.groupBy(*keys).agg(*sums, F.min_by(first, "_day").alias("_first"), F.max_by(last, "_day").alias("_last"), (F.bool_and("_optional") | F.bool_and("_segmented") | F.bool_and("_wallet")).alias("closure_exempt"))
    opening = (F.col("_first.balance") - F.col("_first.income") + F.col("_first.expense")).cast(MONEY)
    return agg.withColumns({"net": (F.col("income_sum") - F.col("expense_sum")).cast(MONEY), "opening_balance": opening, "closing_balance": F.col("_last.balance")}).drop("_first", "_last")


def monthly(ledger: DataFrame, keys=ACCOUNT) -> DataFrame:
    return summarize(ledger.withColumn("month", month_key(F.col("transaction_time"))), [*keys, "month"])


def add_up(parts: DataFrame, keys) -> DataFrame:
    """Sum of partial summaries; balances are dropped."""
    sums = [F.sum(c).alias(c) for c in ("count", "income_count", "expense_count")] + [F.sum(c).cast(MONEY).alias(c) for c in ("income_sum", "expense_sum", "net")]
    return parts.groupBy(*keys).agg(*sums)


def flow_month_rollup(ledger: DataFrame) -> DataFrame:
    """Flow by month, totals by flow and by month, grand total; averages divide totals by six. ``grouping`` tells the level."""
    rows = ledger.withColumn("month", month_key(F.col("transaction_time")))
    sets = rows.groupingSets([["flow_type", "month"], ["flow_type"], ["month"], []], "flow_type", "month")
    out = sets.agg(*[c.alias(n) for n, c in counting().items()], F.grouping_id().cast("int").alias("grouping"))
    average = lambda c: F.when(F.col("grouping").isin(1, 3), half_up(F.col(c) / MONTHS))
    return out.withColumns({"net": (F.col("income_sum") - F.col("expense_sum")).cast(MONEY), "income_average": average("income_sum"), "expense_average": average("expense_sum")})


def overview(ledger: DataFrame) -> DataFrame:
    """By file, by file and month, and in total."""
    rows = ledger.withColumn("month", month_key(F.col("transaction_time")))
    sets = rows.groupingSets([["source_file", "month"], ["source_file"], []], "source_file", "month")
    return sets.agg(*[c.alias(n) for n, c in counting().items()], F.grouping_id().cast("int").alias("grouping"))


def by_kind(ledger: DataFrame, kind: str) -> DataFrame:
    """Rows and amounts by kind, most frequent first."""
    return ledger.groupBy(kind).agg(F.count("*").alias("count"), F.sum("income").cast(MONEY).alias("income_sum"), F.sum("expense").cast(MONEY).alias("expense_sum")).orderBy(F.desc("count"), kind)


def printed_summary(ledger: DataFrame, index: str = "row_no", keys=("source_file",)) -> DataFrame:
    """Summary in print order of files whose first row is the newest."""
    first, last = F.max_by(F.struct("balance", "income", "expense"), index), F.min_by("balance", index)
    agg = ledger.groupBy(*keys).agg(*[c.alias(n) for n, c in counting().items()], first.alias("_first"), last.alias("closing_balance"))
    return agg.withColumn("opening_balance", (F.col("_first.balance") - F.col("_first.income") + F.col("_first.expense")).cast(MONEY)).drop("_first")


def reconcile(summary: DataFrame, printed: DataFrame, key: str) -> DataFrame:
    """Differences between sums and the printed totals of the same file, one row each: key, figure, printed, found."""
    pairs = {"count": "cnt", "income_count": "income_cnt", "expense_count": "expense_cnt", "income_sum": "income", "expense_sum": "expense"}
    cells = F.array(*[F.struct(F.lit(a).alias("figure"), F.col(b).cast(MONEY).alias("printed"), F.col(a).cast(MONEY).alias("found")) for a, b in pairs.items()])
    return summary.join(printed, key).select(key, F.explode(cells).alias("x")).select(key, "x.*").filter("printed IS NOT NULL AND printed <> found")


FIGURES = ["cnt", "income_cnt", "expense_cnt", "income", "expense"]


def printed_figures(lines: DataFrame, patterns: DataFrame, key: str = "file") -> DataFrame:
    """Totals that statements print, out of their text: one row a file, in the columns that ``reconcile`` takes; null for a figure that isn't printed.

    lines(file, bank_id, page_no, line_no, text), patterns(bank_id, figure, rx). A pattern is held against each line and
    the one below it, without blanks; of a figure's matches the first counts. Signs are dropped; files without any figure are left out.
    """
    compact = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"[\s　]+", "")
    below = F.lead("text").over(Window.partitionBy(key).orderBy("page_no", "line_no"))
    two = lines.select(key, "bank_id", "page_no", "line_no", F.concat(compact(F.col("text")), compact(below)).alias("_t"))
    met = with_layout(two, patterns).filter(F.regexp_like("_t", F.col("rx")))
    value = F.replace(F.call_function("regexp_extract", F.col("_t"), F.col("rx"), F.lit(1)), F.lit(","), F.lit(""))
    met = met.select(key, "figure", "page_no", "line_no", F.inline(F.array(F.struct(value.alias("_v")))))  # generated, so that texts and patterns aren't sorted with it
    first = met.groupBy(key, "figure").agg(F.min_by("_v", F.struct("page_no", "line_no")).alias("v"))
    wide = first.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("figure", F.abs(F.col("v").try_cast(MONEY)).alias("v")))).alias("m"))
    kinds = {f: "bigint" if f.endswith("cnt") else MONEY for f in FIGURES}
    return wide.select(key, *[F.try_element_at("m", F.lit(f)).cast(t).alias(f) for f, t in kinds.items()])


def total_issues(differences: DataFrame, key: str) -> DataFrame:
    """Differences of ``reconcile`` as review issues of a statement's first row."""
    shown = lambda c: F.format_number(c, 2)
    return differences.select(key, F.lit(1).cast("bigint").alias("posting_seq"), F.lit("review").alias("level"), F.concat(F.lit("printed_"), "figure").alias("code"), shown("found").alias("raw_amount"), shown("printed").alias("raw_balance"))


def page_completeness(rows: DataFrame, total_pages: str = "total_pages", keys=("source_file",)) -> DataFrame:
    """``complete``: the printed pages are exactly 1 to the printed number of pages; ``prefix``: 1 to the last one there, without a gap."""
    agg = rows.groupBy(*keys).agg(F.count_distinct("page_no").cast("int").alias("pages"), F.min("page_no").alias("_a"), F.max("page_no").alias("_z"), F.max(total_pages).alias("_n"))
    whole = (F.col("_a") == 1) & (F.col("_z") == F.col("pages"))
    return agg.select(*keys, "pages", F.coalesce(whole & (F.col("_z") == F.col("_n")), F.lit(False)).alias("complete"), F.coalesce(whole, F.lit(False)).alias("prefix"))


def latest_balance(ledger: DataFrame) -> DataFrame:
    """Sum over a flow's accounts of the balance of their latest row; rows without an account go by file."""
    account = F.coalesce(F.nullif(F.col("account_no"), F.lit("")), F.concat(F.lit("file:"), F.col("source_file")))
    last = ledger.filter("balance IS NOT NULL").groupBy("flow_type", account.alias("account")).agg(F.max_by("balance", F.struct("transaction_time", "row_no", "source_file")).alias("balance"))
    return last.groupBy("flow_type").agg(F.sum("balance").cast(MONEY).alias("latest_balance"), F.count("*").alias("accounts"))


def last_months(ledger: DataFrame, n: int = MONTHS, keys=()) -> DataFrame:
    """The last n months with rows (of each key)."""
    months = ledger.select(*keys, month_key(F.col("transaction_time")).alias("month")).distinct()
    if not keys:
        return months.orderBy(F.desc("month")).limit(n)
    return months.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("month")))).filter(F.col("_r") <= n).drop("_r")


def with_flow(ledger: DataFrame) -> DataFrame:
    """Rows without a flow type are personal."""
    return ledger.withColumn("flow_type", F.coalesce("flow_type", F.lit("personal")))


def income_block(ledger: DataFrame, n: int = MONTHS) -> DataFrame:
    """Observed income by flow over its last six months: totals and averages, in tens of thousands, and latest balance."""
    ledger = with_flow(ledger)
    recent = last_months(ledger, n, ["flow_type"])
    rows = ledger.withColumn("month", month_key(F.col("transaction_time"))).join(recent, ["flow_type", "month"], "left_semi")
    totals = rows.groupBy("flow_type").agg(*[c.alias(k) for k, c in counting().items()], F.count_distinct("month").alias("months"))
    wan = lambda c: half_up(F.col(c).cast("decimal(28,6)") / 10000)
    out = totals.join(latest_balance(ledger), "flow_type", "left")
    average = lambda c: half_up(F.col(c).cast("decimal(28,6)") / (10000 * n))
    return out.select("flow_type", "months", "income_count", "expense_count", wan("income_sum").alias("income_wan"), wan("expense_sum").alias("expense_wan"), average("income_sum").alias("income_average_wan"), average("expense_sum").alias("expense_average_wan"), wan("latest_balance").alias("latest_balance_wan"), "accounts")


def salary_block(ledger: DataFrame, salary: Column, n: int = MONTHS) -> DataFrame:
    """Income from salary rows, expense from all rows, over the last six months of salary (else of any rows)."""
    rows = ledger.withColumns({"month": month_key(F.col("transaction_time")), "_salary": salary})
    months = rows.groupBy("account_no", "month").agg(F.max("_salary").alias("paid"))
    any_paid = F.max("paid").over(Window.partitionBy("account_no"))
    months = months.withColumn("_any", any_paid).filter(~F.col("_any") | F.col("paid")).withColumn("_r", F.row_number().over(Window.partitionBy("account_no").orderBy(F.desc("month")))).filter(F.col("_r") <= n).select("account_no", "month")
    kept = rows.join(months, ["account_no", "month"], "left_semi").filter(~F.col("neutral"))
    return kept.groupBy("account_no").agg(F.count_if("_salary").alias("salary_rows"), F.coalesce(F.sum(F.when(F.col("_salary"), F.col("income"))), F.lit(0)).cast(MONEY).alias("salary_income"), F.sum("expense").cast(MONEY).alias("expense_sum"), F.count_distinct("month").alias("months")).withColumn("monthly_average", half_up(F.col("salary_income") / n))


def salary_detail(ledger: DataFrame, salary: Column) -> DataFrame:
    """Salary rows by account and month; the mean by month seen is income over rows of this table."""
    rows = ledger.filter(salary).withColumn("month", month_key(F.col("transaction_time")))
    return rows.groupBy("account_no", "month").agg(F.sum("income").cast(MONEY).alias("income"), F.count("*").alias("rows"))


#: Headers of the amount column of a salary listing, the first one that fits counts.
SALARY_AMOUNT_HEADERS = ["交易金额", "收入金额", "贷方发生额", "贷方", "金额"]


def salary_listing(ledger: DataFrame, salary: Column, keys=ACCOUNT) -> DataFrame:
    """Salary rows of each account in order, then its total, number of months seen and mean by month seen.

    Columns: keys, kind (row, total, months, mean), position, fields (a row's cells, or its text), amount_col (from 0: by
    header, else the fourth cell or the last), value.
    """
    if "raw_headers" not in ledger.columns:
        ledger = ledger.withColumn("raw_headers", F.lit(None).cast("array<string>"))
    text = F.array(F.coalesce("raw_text", F.lit("")))
    fields = F.when(F.size("raw_fields") > 0, F.col("raw_fields")).otherwise(F.when(F.contains("raw_text", F.lit(" | ")), F.split("raw_text", " \\| ")).otherwise(text))
    rows = ledger.filter(salary).withColumns({"fields": fields, "_key": order_key(F.lit(False))})
    heads = rows.groupBy(*keys).agg(F.min_by(F.when(F.size("raw_headers") > 0, F.col("raw_headers")), F.when(F.size("raw_headers") > 0, F.col("_key"))).alias("_h"), F.max(F.size("fields")).alias("_w"))
    fits = lambda w: F.array_position(F.transform("_h", lambda h: F.contains(h, F.lit(w))), True)
    at = F.coalesce(*[F.when(fits(w) > 0, fits(w) - 1) for w in SALARY_AMOUNT_HEADERS], F.least(F.lit(3), F.greatest(F.col("_w"), F.coalesce(F.size("_h"), F.lit(0))) - 1))
    heads = heads.select(*keys, at.cast("int").alias("amount_col"))
    position = F.row_number().over(Window.partitionBy(*keys).orderBy("_key"))
    listed = rows.select(*keys, F.lit("row").alias("kind"), position.alias("position"), "fields", F.col("income").cast(MONEY).alias("value"))
    sums = rows.groupBy(*keys).agg(F.sum("income").cast(MONEY).alias("total"), F.count_distinct(month_key(F.col("transaction_time"))).cast(MONEY).alias("months"), F.count("*").cast("int").alias("_n"))
    sums = sums.withColumn("mean", half_up(F.col("total").cast("decimal(28,6)") / F.col("months")))
    ends = F.array(*[F.struct(F.lit(k).alias("kind"), (F.col("_n") + i + 1).alias("position"), F.col(k).alias("value")) for i, k in enumerate(("total", "months", "mean"))])
    tail = sums.select(*keys, F.explode(ends).alias("x")).select(*keys, "x.kind", "x.position", F.lit(None).cast("array<string>").alias("fields"), "x.value")
    return listed.unionByName(tail).join(heads, list(keys)).select(*keys, "kind", "position", "fields", "amount_col", "value")


def combined_months(ledger: DataFrame, months: DataFrame | None = None, keys=()) -> DataFrame:
    """Months over all files and flows, zero where a month of ``months`` (month) has no rows: counts, sums, net."""
    rows = ledger.withColumn("month", month_key(F.col("transaction_time")))
    sums = rows.groupBy(*keys, "month").agg(*[c.alias(n) for n, c in counting().items()])
    if months is not None:
        wanted = months.select(*keys, "month").distinct()
        sums = wanted.join(sums, [*keys, "month"], "left").fillna(0, list(counting()))
    return sums.withColumn("net", (F.col("income_sum") - F.col("expense_sum")).cast(MONEY))


def _beside(one: DataFrame, other: DataFrame) -> DataFrame:
    """Two frames of one row each as one row."""
    return one.withColumn("_one", F.lit(1)).join(other.withColumn("_one", F.lit(1)), "_one").drop("_one")


def overall(ledger: DataFrame) -> DataFrame:
    """One row over all files without the rows that they repeat: the summary, files, accounts, first and last day."""
    from ledgerline.operators.dedupe import dedupe

    rows = dedupe(ledger)
    more = rows.agg(F.count_distinct("source_file").alias("files"), F.count_distinct("account_no").alias("accounts"), F.min(F.to_date("transaction_time")).alias("first_day"), F.max(F.to_date("transaction_time")).alias("last_day"))
    return _beside(summarize(rows, []), more)


def with_document_flow(ledger: DataFrame) -> DataFrame:
    """``flow``: corporate, or personal for all else (wallets included), as documents show them."""
    return with_flow(ledger).withColumn("flow", F.when(F.col("flow_type") == "corporate", "corporate").otherwise("personal"))


def _figures(months: DataFrame, keys) -> DataFrame:
    """Totals, averages by six and the list of months (month, counts, sums in tens of thousands) of a flow's months."""
    wan = lambda c: half_up(F.col(c).cast("decimal(28,6)") / 10000)
    month = F.struct(F.regexp_replace("month", "-", ".").alias("month"), "income_count", wan("income_sum").alias("income_wan"), "expense_count", wan("expense_sum").alias("expense_wan"))
    agg = months.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("income_count", "expense_count", "income_sum", "expense_sum")], F.array_sort(F.collect_list(month)).alias("months"))  # six a flow
    average = lambda c: half_up(F.col(c).cast("decimal(28,6)") / (10000 * MONTHS))
    return agg.select(*keys, F.struct("income_count", wan("income_sum").alias("income_wan"), "expense_count", wan("expense_sum").alias("expense_wan"), average("income_sum").alias("income_average_wan"), average("expense_sum").alias("expense_average_wan")).alias("summary"), "months")


def flow_figures(ledger: DataFrame, salary: Column | None = None, most: int = 5) -> DataFrame:
    """One row a document flow: summary, months, latest_balance_wan, accounts (the first ``most`` by number), n_accounts, salary_rows.

    The last six months with rows count (with ``salary``: with salary rows, if there are any); a month without rows of a
    kind is zero. With ``salary``, income is that of salary rows and expense that of all rows.
    """
    from ledgerline.operators.dedupe import distinct_accounts

    rows = with_document_flow(ledger).withColumn("month", month_key(F.col("transaction_time")))
    every = combined_months(rows, keys=["flow"])
    if salary is None:
        recent = last_months(rows, MONTHS, ["flow"])
        chosen = every.join(recent, ["flow", "month"], "left_semi")
    else:
        paid = combined_months(rows.filter(salary), keys=["flow"]).select("flow", "month", F.col("income_count").alias("_c"), F.col("income_sum").alias("_s"))
        both = every.join(paid, ["flow", "month"], "left")
        any_paid = F.max(F.col("_c").isNotNull()).over(Window.partitionBy("flow"))
        both = both.withColumn("_any", any_paid).filter(~F.col("_any") | F.col("_c").isNotNull()).withColumn("_r", F.row_number().over(Window.partitionBy("flow").orderBy(F.desc("month")))).filter(F.col("_r") <= MONTHS)
        chosen = both.withColumns({"income_count": F.coalesce("_c", F.lit(0)), "income_sum": F.coalesce("_s", zero()).cast(MONEY)})
    out = _figures(chosen, ["flow"])
    flowed = rows.withColumn("flow_type", F.col("flow"))
    balance = latest_balance(flowed).select(F.col("flow_type").alias("flow"), half_up(F.col("latest_balance").cast("decimal(28,6)") / 10000).alias("latest_balance_wan"), F.col("accounts").alias("n_accounts"))
    listed = distinct_accounts(flowed, most).groupBy(F.col("flow_type").alias("flow")).agg(F.array_sort(F.collect_list(F.struct("rank", "account", "first_file"))).alias("x"))  # at most ``most`` a flow
    accounts = listed.select("flow", F.transform("x", lambda a: F.struct(F.when(~F.startswith(a["account"], F.lit("file:")), a["account"]).alias("account_no"), a["first_file"].alias("source_file"))).alias("accounts"))
    return out.join(balance, "flow", "left").join(accounts, "flow", "left").select("flow", "summary", "months", "latest_balance_wan", "accounts", "n_accounts")


def income_document(ledger: DataFrame, confirmations: DataFrame | None = None, salary: Column | None = None) -> DataFrame:
    """One JSON text with the figures of personal and corporate flow, observed rows only; fields of persons and firms stay blank for the clerk.

    confirmations(id, ...): audited exclusions, noted in the document. With ``salary`` it is a salary document: a salary
    block over personal rows besides the personal flow, no corporate flow. Pass rows without repeats (dedupe.dedupe).
    """
    blocks = flow_figures(ledger)
    if salary is not None:
        blocks = blocks.filter("flow = 'personal'").unionByName(flow_figures(with_document_flow(ledger).filter("flow = 'personal'"), salary).withColumn("flow", F.lit("salary")))
    body = [c for c in blocks.columns if c != "flow"]
    block = lambda flow: F.max(F.when(F.col("flow") == flow, F.struct(*body)))
    names = ["personal", "salary"] if salary is not None else ["personal", "corporate"]
    doc = blocks.groupBy().agg(*[block(n).alias(f"{n}_flow") for n in names])
    noted = confirmations.agg(F.array_sort(F.collect_list("id")).alias("confirmed")) if confirmations is not None else None  # one a manual decision
    if noted is not None:
        doc = _beside(doc, noted)
    notes = F.struct(F.lit("").alias("supplement"), (F.col("confirmed") if noted is not None else F.array().cast("array<string>")).alias("source_confirmations"))
    head = [F.lit("1.0").alias("schema_version"), F.lit("salary" if salary is not None else "self_employed").alias("proof_type"), F.struct(F.lit("").alias("name"), F.lit("").alias("city")).alias("customer"), F.lit("").alias("applicant")]
    return doc.select(F.to_json(F.struct(*head, *[f"{n}_flow" for n in names], notes.alias("notes"))).alias("document"))
