"""Registered queries of merged statements, documents, reports and gold checks, and their SQL."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerline.functions import text
from ledgerline.functions.money import MONEY
from ledgerline.operators import chain, filters, merge, ordering, quality, reports, scenario, summary
from ledgerline.plans.queries import _COUNTS, _MONTHS, _PREV, _shuffled_days, _summary_sql, _up, query, table
from ledgerline.sources.ledgers import EVENTS_SQL, FILES_SQL, ORDERS_SQL, events_ledger, orders_ledger, overlapping_files

_DEDUPED = FILES_SQL + """,
dd AS (SELECT *, first_value(source_file) OVER (PARTITION BY account_no, ts, income, expense, balance, raw_amount ORDER BY source_file, row_no) AS first_file FROM files),
kept AS (SELECT * FROM dd WHERE source_file = first_file)"""


# -- merged statements ------------------------------------------------------------------------------------------------


def _named_files(spark, sf_dir):
    """The orders ledger in two files of an account each, without overlap; layouts by account."""
    rows = _shuffled_days(spark, sf_dir)
    k = F.col("account_no").cast("bigint") % 4
    rows = rows.withColumn("row_no", F.when(k == 2, F.col("true_seq")).otherwise(F.col("row_no"))).drop("true_seq")  # printed in order where gaps are to be found
    bank = F.when(k == 0, "ccb_corp").when(k == 1, "mintai").when(k == 2, "chaoyang_corp").otherwise("other")
    return rows.withColumns({"bank_id": bank, "account_name": F.lit("n"), "source_file": F.concat("account_no", F.when(F.col("transaction_time") < F.lit(datetime(1995, 6, 1)), "a").otherwise("b"))})


_PARTS = f"""WITH {ORDERS_SQL}, t AS (SELECT *, CAST(account_no AS BIGINT) % 4 AS k, date_trunc('month', ts) AS mt, CASE WHEN date_trunc('month', ts) < TIMESTAMP '1995-06-01' THEN 'a' ELSE 'b' END AS part FROM ledger WHERE NOT neutral),
n AS (SELECT account_no, count(DISTINCT part) AS parts FROM t GROUP BY account_no)"""


@query(_PARTS + """ SELECT account_no, CASE WHEN k < 2 AND parts > 1 THEN 'account:' || account_no ELSE 'file:' || account_no || part END AS statement_id, count(*) AS "rows", CASE WHEN k = 1 AND parts > 1 THEN true END AS linked,
  CASE WHEN k < 2 AND parts > 1 THEN count(*) END AS last_row FROM t JOIN n USING (account_no) GROUP BY account_no, k, parts, CASE WHEN k < 2 AND parts > 1 THEN 'account:' || account_no ELSE 'file:' || account_no || part END""")
def merged_sequenced(spark, sf_dir):
    got = merge.merge_sequenced(_named_files(spark, sf_dir))
    merged = F.startswith("statement_id", F.lit("account:"))
    w = Window.partitionBy("statement_id").orderBy("statement_order")
    follows = F.lag("balance").over(w) + F.col("income") - F.col("expense") == F.col("balance")
    checked = got.withColumn("_ok", F.coalesce(follows, F.lit(True)))
    trail = F.col("bank_id") == "mintai"
    return checked.groupBy("account_no", "statement_id").agg(F.count("*").alias("rows"), F.when(F.bool_and(merged & trail), F.bool_and("_ok")).alias("linked"), F.when(F.bool_and(merged), F.max("row_no")).alias("last_row"))


@query(_PARTS + " SELECT account_no, row_number() OVER (PARTITION BY account_no ORDER BY seq) AS statement_order, bal0 AS balance FROM t JOIN n USING (account_no) WHERE k = 1 AND parts > 1")
def merged_trails(spark, sf_dir):
    """Which row stands where in statements that are merged and ordered by their balances."""
    got = merge.merge_sequenced(_named_files(spark, sf_dir)).filter("bank_id = 'mintai' AND startswith(statement_id, 'account:')")
    return got.select("account_no", F.col("statement_order").cast("bigint").alias("statement_order"), "balance")


@query(_PARTS + """, s AS (SELECT * FROM t JOIN n USING (account_no) WHERE k = 2)
SELECT account_no, CASE WHEN parts > 1 THEN 'account:' || account_no ELSE 'file:' || account_no || part END AS statement_id, count(*) AS "rows", CASE WHEN parts > 1 THEN 2 ELSE 0 END AS segments FROM s WHERE parts = 1 OR mt < TIMESTAMP '1995-06-01' OR mt >= TIMESTAMP '1996-01-01' GROUP BY account_no, parts, CASE WHEN parts > 1 THEN 'account:' || account_no ELSE 'file:' || account_no || part END
HAVING parts = 1 OR (count(*) FILTER (part = 'a') > 0 AND count(*) FILTER (part = 'b') > 0 AND (SELECT count(*) FROM s y WHERE y.account_no = s.account_no AND y.mt >= TIMESTAMP '1995-06-01' AND y.mt < TIMESTAMP '1996-01-01') > 0)""")
def merged_segments(spark, sf_dir):
    """Months between the two files are left out of accounts with rows there, so that a gap stays; one file overlaps the other."""
    rows = _named_files(spark, sf_dir).filter("bank_id = 'chaoyang_corp'")
    between = (F.col("transaction_time") >= F.lit(datetime(1995, 6, 1))) & (F.col("transaction_time") < F.lit(datetime(1996, 1, 1)))
    parts = rows.groupBy("account_no").agg(F.count_distinct("source_file").alias("_parts"), F.count_if(between).alias("_gone"), F.count_if(F.col("transaction_time") >= F.lit(datetime(1996, 1, 1))).alias("_late"))
    rows = rows.join(parts, "account_no").filter((F.col("_parts") == 1) | ((F.col("_gone") > 0) & (F.col("_late") > 0) & ~between)).drop("_parts", "_gone", "_late")
    repeated = rows.filter(F.endswith("source_file", F.lit("b"))).withColumn("source_file", F.concat("account_no", F.lit("c")))
    several = rows.groupBy("account_no").agg(F.count_distinct("source_file").alias("_n")).filter("_n > 1")
    both = rows.unionByName(repeated.join(several, "account_no", "left_semi"))
    got = merge.merge_segments(both)
    return got.groupBy("account_no", "statement_id").agg(F.count("*").alias("rows"), F.count_if("balance_segment_start").cast("int").alias("segments"))


@query(f"""WITH {ORDERS_SQL}, p AS (SELECT account_no, CAST(account_no AS BIGINT) AS k, row_no % 3 AS part FROM ledger), c AS (SELECT account_no, k, count(DISTINCT part) AS parts, bool_or(part = 0) AS a, bool_or(part = 1) AS b, bool_or(part = 2) AS z FROM p GROUP BY ALL),
m AS (SELECT l.account_no, l.row_no, CASE WHEN k % 2 = 0 AND parts > 1 AND a AND b AND (z OR k % 4 = 0) THEN CASE WHEN z THEN 'complete' ELSE 'newest_pages' END END AS coverage FROM ledger l JOIN c USING (account_no))
SELECT account_no, row_no, CASE WHEN coverage IS NULL THEN 'file' ELSE 'pages' END AS statement, coverage, coverage IS NOT NULL AS balance_optional FROM m""")
def merged_page_parts(spark, sf_dir):
    """Accounts in up to three files: pages 1 to 2, 3 to 4 and 5. Accounts that 4 divides are asked for late dates only."""
    rows = orders_ledger(spark, sf_dir)
    rows = rows.withColumns({"bank_id": F.when(F.col("account_no").cast("bigint") % 2 == 0, "rural_commercial").otherwise("x"), "source_file": F.concat("account_no", F.lit("-"), (F.col("row_no") % 3).cast("string"))})
    part = F.split("source_file", "-")[1].cast("int")
    pages = rows.select("source_file", "bank_id", "account_no").distinct().withColumns({"first_page": part * 2 + 1, "last_page": F.least(part * 2 + 2, F.lit(5)), "total_pages": F.lit(5), "signature": F.lit("s")})
    late = F.col("account_no").cast("bigint") % 4 == 0
    one = merge.merge_page_parts(rows.filter(late), pages.filter(late), datetime(2030, 1, 1))
    two = merge.merge_page_parts(rows.filter(~late), pages.filter(~late))
    return one.unionByName(two).select("account_no", "row_no", F.split("statement_id", ":")[0].alias("statement"), "coverage", "balance_optional")


@query(f"""WITH {ORDERS_SQL}, w AS (SELECT *, lag(balance) OVER o AS pb, lead(expense) OVER o AS ne, lead(balance) OVER o AS nb FROM ledger WINDOW o AS (PARTITION BY account_no ORDER BY seq))
SELECT account_no, row_no, CASE WHEN row_no % 101 = 0 AND balance IS NOT NULL AND pb IS NOT NULL AND ne IS NOT NULL AND nb IS NOT NULL THEN (CASE WHEN row_no % 202 = 0 THEN 'neighbours_differ' ELSE 'excluded' END) ELSE 'kept' END AS state FROM w""")
def proven_exclusions(spark, sf_dir):
    rows = ordering.posting_order(orders_ledger(spark, sf_dir)).withColumn("sha256", F.sha2("account_no", 256))
    w = Window.partitionBy("account_no").orderBy("posting_seq")
    near = rows.withColumns({"previous_balance": F.lag("balance").over(w), "next_expense": F.lead("expense").over(w), "next_balance": F.lead("balance").over(w)})
    wanted = near.filter("row_no % 101 = 0 AND balance IS NOT NULL AND previous_balance IS NOT NULL AND next_expense IS NOT NULL AND next_balance IS NOT NULL")
    off = F.when(F.col("row_no") % 202 == 0, 1).otherwise(0)
    wanted = wanted.select(F.col("row_no").cast("string").alias("id"), "sha256", F.col("page_no").alias("page"), F.col("row_no").alias("row"), "income", "balance", "previous_balance", "next_expense", (F.col("next_balance") + off).cast(MONEY).alias("next_balance"), F.lit("exclude").alias("action"), F.lit("checked").alias("basis"))
    kept, audit, errors = filters.proven_exclusions(rows, wanted)
    bad = errors.select(F.col("id").cast("bigint").alias("row_no"), "sha256", F.col("reason").alias("state"))
    kept = kept.join(bad, ["row_no", "sha256"], "left").select("account_no", "row_no", F.coalesce("state", F.lit("kept")).alias("state"))
    return kept.unionByName(audit.select("account_no", "row_no", F.lit("excluded").alias("state")))


# -- documents --------------------------------------------------------------------------------------------------------


@query(f"""WITH {FILES_SQL}, m AS (SELECT strftime(ts, '%Y-%m') AS month, * FROM files), w AS (SELECT DISTINCT month FROM m WHERE substr(month, 6) <> '03' UNION ALL SELECT '1901-01'),
s AS (SELECT month, {_COUNTS} FROM m GROUP BY month)
SELECT w.month, coalesce("count", 0) AS "count", coalesce(income_count, 0) AS income_count, CAST(coalesce(income_sum, 0) AS DECIMAL(18,2)) AS income_sum, coalesce(expense_count, 0) AS expense_count, CAST(coalesce(expense_sum, 0) AS DECIMAL(18,2)) AS expense_sum, CAST(coalesce(income_sum - expense_sum, 0) AS DECIMAL(18,2)) AS net FROM w LEFT JOIN s USING (month)""")
def combined_months(spark, sf_dir):
    rows = overlapping_files(spark, sf_dir)
    months = rows.select(text.month_key(F.col("transaction_time")).alias("month")).distinct().filter("substr(month, 6) <> '03'")
    months = months.unionByName(spark.createDataFrame([("1901-01",)], "month string"))
    return summary.combined_months(rows, months)


_FLOWS = _DEDUPED + f""",
fm AS (SELECT *, CASE WHEN flow_type = 'corporate' THEN 'corporate' ELSE 'personal' END AS flow, strftime(ts, '%Y-%m') AS month, raw_text LIKE '1-%' AND income > 0 AS salary FROM kept),
lm AS (SELECT flow, month, row_number() OVER (PARTITION BY flow ORDER BY month DESC) AS r FROM (SELECT DISTINCT flow, month FROM fm)),
fs AS (SELECT flow, {_COUNTS}, count(DISTINCT month) AS months FROM fm JOIN lm USING (flow, month) WHERE r <= 6 GROUP BY flow),
lb AS (SELECT flow, sum(b) AS latest, count(*) AS accounts FROM (SELECT flow, account_no, arg_max(balance, (ts, row_no, source_file)) AS b FROM fm WHERE balance IS NOT NULL GROUP BY ALL) GROUP BY flow),
ac AS (SELECT flow, string_agg(account_no, ',' ORDER BY account_no) AS listed FROM (SELECT *, row_number() OVER (PARTITION BY flow ORDER BY account_no) AS n FROM (SELECT DISTINCT flow, account_no FROM fm)) WHERE n <= 5 GROUP BY flow)"""
_SHOWN = ["income_count", "income_wan", "expense_count", "expense_wan", "income_average_wan", "expense_average_wan"]


def _document_rows(doc, flows):
    """One row a flow of a document, its figures read back from the JSON text."""
    one = []
    for f in flows:
        at = lambda x, f=f: F.get_json_object("document", f"$.{f}_flow.{x}")
        accounts = F.from_json(at("accounts"), "array<struct<account_no:string,source_file:string>>")
        figures = [at(f"summary.{c}").cast("bigint" if c.endswith("count") else MONEY).alias(c) for c in _SHOWN]
        one.append(F.struct(F.lit(f).alias("flow"), *figures, F.size(F.from_json(at("months"), "array<struct<month:string>>")).cast("bigint").alias("months"), at("latest_balance_wan").cast(MONEY).alias("latest_balance_wan"), at("n_accounts").cast("bigint").alias("n_accounts"), F.array_join(F.transform(accounts, lambda a: a["account_no"]), ",").alias("listed")))
    blank = (F.get_json_object("document", "$.customer.name") == "") & (F.get_json_object("document", "$.applicant") == "")
    return doc.select(F.explode(F.array(*one)).alias("x"), blank.alias("blank")).select("x.*", "blank")


def _wans(income: str, expense: str) -> str:
    return f"{_up(income, 10000)} AS income_wan, {_up(expense, 10000)} AS expense_wan, {_up(income, 60000)} AS income_average_wan, {_up(expense, 60000)} AS expense_average_wan"


@query(f"WITH {_FLOWS} SELECT flow, income_count, expense_count, {_wans('income_sum', 'expense_sum')}, months, {_up('latest', 10000)} AS latest_balance_wan, accounts AS n_accounts, listed, true AS blank FROM fs JOIN lb USING (flow) JOIN ac USING (flow)")
def income_documents(spark, sf_dir):
    from ledgerline.operators.dedupe import dedupe

    return _document_rows(summary.income_document(dedupe(overlapping_files(spark, sf_dir))), ["personal", "corporate"])


@query(f"""WITH {_FLOWS}, pm AS (SELECT month, bool_or(salary) AS paid FROM fm WHERE flow = 'personal' GROUP BY month), pr AS (SELECT month, row_number() OVER (ORDER BY month DESC) AS r FROM pm WHERE paid OR NOT (SELECT bool_or(paid) FROM pm)),
ss AS (SELECT count(*) FILTER (salary AND NOT neutral) AS income_count, CAST(coalesce(sum(income) FILTER (salary AND NOT neutral), 0) AS DECIMAL(18,2)) AS income_sum, count(*) FILTER (NOT neutral AND expense > 0) AS expense_count, CAST(sum(expense) FILTER (NOT neutral AND expense > 0) AS DECIMAL(18,2)) AS expense_sum, count(DISTINCT month) AS months FROM fm JOIN pr USING (month) WHERE r <= 6 AND flow = 'personal')
SELECT 'salary' AS flow, income_count, expense_count, {_wans('income_sum', 'expense_sum')}, months, {_up('latest', 10000)} AS latest_balance_wan, accounts AS n_accounts, listed, true AS blank FROM ss, lb, ac WHERE lb.flow = 'personal' AND ac.flow = 'personal'""")
def salary_documents(spark, sf_dir):
    from ledgerline.operators.dedupe import dedupe

    salary = F.startswith("raw_text", F.lit("1-")) & (F.col("income") > 0)
    return _document_rows(summary.income_document(dedupe(overlapping_files(spark, sf_dir)), salary=salary), ["salary"])


@query(f"""WITH {ORDERS_SQL}, s AS (SELECT *, strftime(ts, '%Y-%m') AS month, row_number() OVER (PARTITION BY account_no ORDER BY seq) AS n FROM ledger WHERE raw_text LIKE '1-%' AND income > 0),
t AS (SELECT account_no, CAST(sum(income) AS DECIMAL(18,2)) AS total, count(DISTINCT month) AS months, count(*) AS n FROM s GROUP BY account_no)
SELECT account_no, 'row' AS kind, n AS position, raw_text AS shown, 2 AS amount_col, income AS value FROM s
UNION ALL SELECT account_no, 'total', n + 1, NULL, 2, total FROM t UNION ALL SELECT account_no, 'months', n + 2, NULL, 2, CAST(months AS DECIMAL(18,2)) FROM t
UNION ALL SELECT account_no, 'mean', n + 3, NULL, 2, CAST(sign(total) * ((CAST(abs(total) * 100 AS BIGINT) * 2 + months) // (2 * months)) / 100 AS DECIMAL(18,2)) FROM t""")
def salary_listings(spark, sf_dir):
    rows = orders_ledger(spark, sf_dir).withColumns({"raw_headers": F.array(*map(F.lit, ["日期", "摘要", "收入金额", "余额"])), "raw_fields": F.array(F.col("raw_text"), F.lit("x"), F.col("raw_amount"), F.lit("y"))})
    got = summary.salary_listing(rows, F.startswith("raw_text", F.lit("1-")) & (F.col("income") > 0))
    return got.select("account_no", "kind", F.col("position").cast("bigint").alias("position"), F.get("fields", F.lit(0)).alias("shown"), "amount_col", "value")


@query(f"WITH {_DEDUPED} SELECT {_COUNTS}, CAST(coalesce(sum(income) FILTER (NOT neutral AND income - expense >= 0), 0) - coalesce(sum(expense) FILTER (NOT neutral AND expense > 0), 0) AS DECIMAL(18,2)) AS net, count(DISTINCT source_file) AS files, count(DISTINCT account_no) AS accounts, CAST(min(ts) AS DATE) AS first_day, CAST(max(ts) AS DATE) AS last_day FROM kept")
def overall_summary(spark, sf_dir):
    return summary.overall(overlapping_files(spark, sf_dir)).select("count", "income_count", "income_sum", "expense_count", "expense_sum", "net", "files", "accounts", "first_day", "last_day")


# -- reports and checks -----------------------------------------------------------------------------------------------


@query(f"WITH {ORDERS_SQL} SELECT account_no, seq AS place, CAST(ts AS DATE) AS day, income, expense, balance, row_no FROM ledger")
def detail_listings(spark, sf_dir):
    got = reports.detail_listing(orders_ledger(spark, sf_dir))
    return got.select("account_no", F.col("place").cast("bigint").alias("place"), F.to_date("transaction_time").alias("day"), "income", "expense", "balance", "row_no")


@query(f"""WITH {ORDERS_SQL}, m AS (SELECT 'monthly' AS part, strftime(ts, '%Y-%m') AS item, count(*) AS n, CAST(sum(income) AS DECIMAL(18,2)) AS income_sum, CAST(sum(expense) AS DECIMAL(18,2)) AS expense_sum FROM ledger GROUP BY 2),
k AS (SELECT 'by_kind', raw_text, count(*), CAST(sum(income) AS DECIMAL(18,2)), CAST(sum(expense) AS DECIMAL(18,2)) FROM ledger GROUP BY 2), d AS (SELECT 'detail', CASE WHEN income - expense >= 0 THEN 'income' ELSE 'expense' END, count(*), CAST(sum(income) AS DECIMAL(18,2)), CAST(sum(expense) AS DECIMAL(18,2)) FROM ledger GROUP BY 2),
o AS (SELECT 'overall', CAST(CAST(min(ts) AS DATE) AS VARCHAR) || ' ' || CAST(CAST(max(ts) AS DATE) AS VARCHAR), count(*) FILTER (NOT neutral), CAST(sum(income) FILTER (NOT neutral) AS DECIMAL(18,2)), CAST(sum(expense) FILTER (NOT neutral) AS DECIMAL(18,2)) FROM ledger)
SELECT * FROM m UNION ALL SELECT * FROM k UNION ALL SELECT * FROM d UNION ALL SELECT * FROM o""")
def simple_report(spark, sf_dir):
    r = reports.simple_report(orders_ledger(spark, sf_dir), "raw_text", "bank")
    sums = ["income_sum", "expense_sum"]
    detail = r["detail"].groupBy("direction").agg(F.count("*").alias("n"), F.sum("income").cast(MONEY).alias("income_sum"), F.sum("expense").cast(MONEY).alias("expense_sum"))
    out = r["monthly"].select(F.lit("monthly").alias("part"), F.col("month").alias("item"), F.col("count").alias("n"), *sums)
    out = out.unionByName(r["by_kind"].select(F.lit("by_kind").alias("part"), F.col("raw_text").alias("item"), F.col("count").alias("n"), *sums))
    out = out.unionByName(detail.select(F.lit("detail").alias("part"), F.col("direction").alias("item"), "n", *sums))
    return out.unionByName(r["overall"].select(F.lit("overall").alias("part"), F.concat_ws(" ", "first_day", "last_day").alias("item"), F.col("count").alias("n"), *sums))


def _files(spark, sf_dir):
    ordered = ordering.posting_order(events_ledger(spark, sf_dir))
    issues = chain.row_issues(ordered).withColumnRenamed("account_no", "source_file")
    return summary.summarize(events_ledger(spark, sf_dir)).withColumnRenamed("account_no", "source_file"), issues


_ISSUES = f"""WITH {EVENTS_SQL}, p AS (SELECT *, {_PREV} + income - expense AS expected FROM ledger),
i AS (SELECT account_no, seq, 'balance_missing' AS code, raw_amount, balance FROM p WHERE balance IS NULL UNION ALL SELECT account_no, seq, 'balance_break', raw_amount, balance FROM p WHERE expected <> balance)"""


@query(_ISSUES + f""", s AS ({_summary_sql('account_no')}), f AS (SELECT account_no, count(*) AS n FROM i GROUP BY account_no), t AS (SELECT account_no, string_agg(code || ' ' || raw_amount, '; ' ORDER BY seq, code) AS x FROM (SELECT *, row_number() OVER (PARTITION BY account_no ORDER BY seq, code) AS r FROM i) WHERE r <= 3 GROUP BY account_no)
SELECT account_no AS source_file, "count", income_count, income_sum, expense_count, expense_sum, coalesce(n, 0) AS issues, CASE WHEN coalesce(n, 0) > 0 THEN 'review' ELSE 'passed' END AS status, coalesce(x, '') AS first_issues FROM s LEFT JOIN f USING (account_no) LEFT JOIN t USING (account_no)""")
def layout_listings(spark, sf_dir):
    return reports.layout_listing(*_files(spark, sf_dir))


@query(_ISSUES + """, f AS (SELECT l.account_no, coalesce(n, 0) AS n, CASE WHEN coalesce(n, 0) > 0 THEN 'REVIEW' ELSE 'PASS' END AS status FROM (SELECT DISTINCT account_no FROM ledger) l LEFT JOIN (SELECT account_no, count(*) AS n FROM i GROUP BY account_no) USING (account_no))
SELECT 'overview' AS part, status AS item, count(*) AS n FROM f GROUP BY status UNION ALL SELECT 'overview', NULL, count(*) FROM f UNION ALL SELECT 'files', account_no, n FROM f UNION ALL SELECT 'issues', code, count(*) FROM i GROUP BY code""")
def batch_report(spark, sf_dir):
    sums, issues = _files(spark, sf_dir)
    counts = quality.issue_counts(issues, ["source_file"]).select("source_file", "reviews")
    files = sums.select("source_file", F.col("count").alias("rows")).join(counts, "source_file", "left").fillna(0, ["reviews"])
    files = quality.batch_status(files.withColumns({"ignored": F.lit(None).cast("string"), "error": F.lit(None).cast("string"), "recognised": F.lit(True), "generic": F.lit(False)}))
    r = reports.batch_report(files, issues)
    out = r["overview"].select(F.lit("overview").alias("part"), F.col("status").alias("item"), F.col("files").alias("n"))
    out = out.unionByName(r["files"].select(F.lit("files").alias("part"), F.col("source_file").alias("item"), F.col("reviews").alias("n")))
    return out.unionByName(r["issues"].groupBy(F.col("code").alias("item")).agg(F.count("*").alias("n")).select(F.lit("issues").alias("part"), "item", "n"))


_SIDE = 'count(*) AS "count", count(*) FILTER (expense > 0) AS expense_count, CAST(sum(expense) AS DECIMAL(18,2)) AS expense_sum, count(*) FILTER (income > 0) AS income_count, CAST(sum(income) AS DECIMAL(18,2)) AS income_sum'


@query(f"""WITH {ORDERS_SQL}, r AS (SELECT * FROM ledger WHERE CAST(ts AS DATE) BETWEEN DATE '1995-01-01' AND DATE '1996-12-31'), a AS (SELECT account_no, 'ledger' AS side, {_SIDE} FROM r GROUP BY account_no), b AS (SELECT account_no, 'gold' AS side, {_SIDE} FROM r WHERE row_no % 10 <> 0 GROUP BY account_no),
l AS (SELECT account_no, income, expense, balance, row_number() OVER (PARTITION BY account_no ORDER BY seq) AS n FROM r), g AS (SELECT account_no, income, expense, balance, row_number() OVER (PARTITION BY account_no ORDER BY seq) AS n FROM r WHERE row_no % 10 <> 0),
d AS (SELECT coalesce(l.account_no, g.account_no) AS account_no, count(*) AS n FROM l FULL JOIN g ON l.account_no = g.account_no AND l.n = g.n WHERE l.n IS NULL OR g.n IS NULL OR l.income <> g.income OR l.expense <> g.expense OR l.balance IS DISTINCT FROM g.balance GROUP BY 1)
SELECT x.*, coalesce(d.n, 0) AS differences FROM (SELECT * FROM a UNION ALL SELECT * FROM b) x LEFT JOIN d USING (account_no)""")
def gold_checks(spark, sf_dir):
    rows = orders_ledger(spark, sf_dir)
    differences, figures = reports.gold_check(rows, rows.filter("row_no % 10 <> 0"), date(1995, 1, 1), date(1996, 12, 31))
    n = differences.groupBy("account_no").agg(F.count("*").alias("differences"))
    return figures.join(n, "account_no", "left").fillna(0, ["differences"])


@query(f"""WITH {ORDERS_SQL}, m AS (SELECT * FROM ledger WHERE month(ts) IN (3, 4)), a AS (SELECT account_no, 'ledger' AS side, {_SIDE} FROM m GROUP BY account_no), h AS (SELECT * REPLACE (CASE WHEN row_no % 10 = 0 THEN income + 1 ELSE income END AS income) FROM m), b AS (SELECT account_no, 'gold' AS side, {_SIDE} FROM h GROUP BY account_no),
d AS (SELECT account_no, CAST(count(*) FILTER (row_no % 10 = 0) AS INTEGER) AS differences FROM m GROUP BY account_no) SELECT x.*, d.differences FROM (SELECT * FROM a UNION ALL SELECT * FROM b) x JOIN d USING (account_no)""")
def merged_gold_checks(spark, sf_dir):
    """Two files that overlap, against checked rows of two months of each year, of which every tenth says another income."""
    rows = orders_ledger(spark, sf_dir)
    a = rows.filter("row_no % 3 <> 0").withColumn("source_file", F.lit("a"))
    both = a.unionByName(rows.filter("row_no % 3 <> 1").withColumn("source_file", F.lit("b"))).withColumn("merge_key", F.lpad(F.col("row_no").cast("string"), 12, "0"))
    gold = rows.filter("month(transaction_time) IN (3, 4)").withColumn("merge_key", F.lpad(F.col("row_no").cast("string"), 12, "0"))
    gold = gold.withColumn("income", F.when(F.col("row_no") % 10 == 0, F.col("income") + 1).otherwise(F.col("income")).cast(MONEY))
    differences, figures = reports.merged_gold_check(both, gold)
    n = differences.groupBy("account_no").agg(F.count("*").alias("differences"))
    return figures.join(n, "account_no", "left").fillna(0, ["differences"]).withColumn("differences", F.col("differences").cast("int"))


@query(_MONTHS + """, p AS (SELECT account_no, month, "count", income_sum, expense_sum, net FROM ms) SELECT * FROM p UNION ALL SELECT account_no, NULL, CAST(sum("count") AS BIGINT), CAST(sum(income_sum) AS DECIMAL(18,2)), CAST(sum(expense_sum) AS DECIMAL(18,2)), CAST(sum(net) AS DECIMAL(18,2)) FROM p GROUP BY account_no""")
def monthly_totals(spark, sf_dir):
    return reports.monthly_with_total(orders_ledger(spark, sf_dir)).select("account_no", "month", "count", "income_sum", "expense_sum", "net")


# -- scenarios --------------------------------------------------------------------------------------------------------


@query(_MONTHS + """, b AS (SELECT *, CASE WHEN CAST(substr(month, 6) AS INTEGER) % 2 = 0 THEN 250 ELSE 0 END AS up, first_value(opening_balance IGNORE NULLS) OVER (PARTITION BY account_no ORDER BY month ROWS UNBOUNDED PRECEDING) AS start FROM ms),
c AS (SELECT account_no, month, income_sum, up, CAST(start + sum(income_sum + up - expense_sum) OVER (PARTITION BY account_no ORDER BY month) AS DECIMAL(18,2)) AS closing FROM b)
SELECT account_no, CAST(sum(income_sum) AS DECIMAL(18,2)) AS observed_income, CAST(sum(up) AS DECIMAL(18,2)) AS income_delta, arg_max(closing, month) AS closing, CASE WHEN bool_or(closing < 0) THEN 'review' ELSE 'ok' END AS status FROM c GROUP BY account_no""")
def scenario_totals(spark, sf_dir):
    months = summary.monthly(orders_ledger(spark, sf_dir))
    deltas = months.select("account_no", "month", F.when(F.substring("month", 6, 2).cast("int") % 2 == 0, 250).otherwise(0).cast(MONEY).alias("income_delta"), F.lit(0).cast(MONEY).alias("expense_delta"))
    got = scenario.with_totals(scenario.scenario_months(months, deltas, "s1")).filter("month IS NULL")
    return got.select("account_no", "observed_income", "income_delta", "closing", "status")


@query(f"""WITH {ORDERS_SQL}, n AS (SELECT count(DISTINCT strftime(ts, '%Y-%m')) AS n FROM ledger WHERE strftime(ts, '%Y-%m') BETWEEN '1995-01' AND '1995-06')
SELECT 'a' AS scenario_id, unnest(['label', 'amount', 'months', 'month_count', 'by_month']) AS parameter, unnest(['first', '1000.00', '1995-01 to 1995-06', CAST(n AS VARCHAR), CAST(CAST(CASE WHEN n = 0 THEN 0 ELSE round_even(1000 / n, 2) END AS DECIMAL(18,2)) AS VARCHAR)]) AS value FROM n UNION ALL SELECT 'b', 'warning', 'second has no amount'""")
def scenario_parameters(spark, sf_dir):
    months = orders_ledger(spark, sf_dir).select(text.month_key(F.col("transaction_time")).alias("month"))
    asked = spark.createDataFrame([("a", "first", 1000, "1995-01", "1995-06", True), ("b", "second", 0, "1995-01", "1995-06", True), ("c", "off", 5, "1995-01", "1995-06", False)], "scenario_id string, label string, amount int, first_month string, last_month string, enabled boolean")
    return scenario.parameter_rows(asked.withColumn("amount", F.col("amount").cast(MONEY)), months)


@query(_MONTHS + """ SELECT account_no, month, CAST(CASE WHEN CAST(substr(month, 6) AS INTEGER) % 3 = 0 THEN 0 WHEN CAST(substr(month, 6) AS INTEGER) % 3 = 1 THEN 5 ELSE -5 END AS DECIMAL(18,2)) AS delta, CASE WHEN CAST(substr(month, 6) AS INTEGER) % 3 = 0 THEN 'unchanged' WHEN CAST(substr(month, 6) AS INTEGER) % 3 = 1 THEN 'higher' ELSE 'lower' END AS label FROM ms WHERE closing_balance IS NOT NULL
UNION ALL SELECT account_no, month, NULL, 'unknown' FROM ms WHERE closing_balance IS NULL""")
def balance_labels(spark, sf_dir):
    months = summary.monthly(orders_ledger(spark, sf_dir)).select("account_no", "month", F.col("closing_balance").alias("observed_closing"))
    k = F.substring("month", 6, 2).cast("int") % 3
    got = scenario.balance_check(months.withColumn("closing", (F.col("observed_closing") + F.when(k == 0, 0).when(k == 1, 5).otherwise(-5)).cast(MONEY)))
    return got.select("account_no", "month", "delta", "label")
