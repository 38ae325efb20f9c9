"""Fixed values, header rows, merged statements, documents, reports and readers on small cases."""

import json
from datetime import date, datetime
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F
from test_ledger import ledger

from ledgerline.functions import money, text
from ledgerline.operators import chain, filters, merge, ordering, parse, quality, reports, scenario, sequence, summary
from ledgerline.sources import io
from ledgerline.sources.layouts import layouts

CELLS = "file string, page_no int, table_no int, row_no int, cells array<string>"


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def test_account_numbers_of_headers(spark):
    rows = [("对方账号：11112222333344\n账号：6222-0212 3456 7890", "6222021234567890"), ("微信号: some_one\n卡号 6222000011112222", "some_one"), ("账号 20240101\n卡号：6222****2222", "6222****2222"), ("账号 20240101", None), ("卡号：62220000＊＊＊＊2222", "62220000****2222"), ("x\n" * 80 + "卡号：6222000011112222", None), (None, None)]
    df = spark.createDataFrame(rows, "t string, want string")
    assert all(r.got == r.want for r in df.select("want", text.account_number(F.col("t")).alias("got")).collect())


def test_bank_names(spark):
    rows = [("中国邮政储蓄银行个人流水", "x", "邮政"), (None, "spdb_corp", "浦发"), ("??", "x", ""), ("某银行", "excel", ""), ("中国银行导入", "excel", "中国"), ("Excel导入", "x", ""), ("工商银行", "icbc", "工商")]
    df = spark.createDataFrame(rows, "label string, layout string, want string")
    assert all(r.got == r.want for r in df.select("want", text.bank_name(F.col("label"), F.col("layout")).alias("got")).collect())


def test_salary_rows_need_income(spark):
    def says(income, raw, fields, amount="", **how):
        return one(spark, text.is_salary(F.lit(income), F.lit(raw), F.array(*map(F.lit, fields)), F.lit(amount), **how))

    assert says(5, "x", ["奖"]) and says(5, "x", ["y"], "薪酬 5.00") and not says(0, "工资", ["y"]) and not says(5, "工资", ["报销"])
    assert says(5, "代发", ["退款"], words=text.SALARY_LISTING_WORDS, excluded=None) and not says(5, "奖", ["y"], words=text.SALARY_LISTING_WORDS, excluded=None)


def test_flow_types(spark):
    flow = lambda *a: one(spark, filters.flow_of(*map(F.lit, a)))
    assert [flow("boc_corp_v2", "n", ""), flow("new_corp", "n", ""), flow("wechat", "某店", ""), flow("alipay", "n", ""), flow("icbc", "某工作室", ""), flow("excel", "n", "微信"), flow("excel", "n", "x对公"), flow("icbc", "n", "对公")] == ["corporate", "corporate", "wechat", "personal", "corporate", "wechat", "corporate", "personal"]
    assert flow("icbc", "某公司", "", "personal") == "personal"


def test_header_rows(spark):
    rows = [("a", 1, 0, 1, ["交易", "收入", "支出"]), ("a", 1, 0, 2, ["日期", "金额", "金额"]), ("a", 1, 0, 3, ["20240101", "5.00", ""]), ("a", 2, 0, 1, ["20240102", "", "6.00"]), ("b", 1, 0, 1, ["no", "header"]), ("c", 1, 0, 1, ["交易时间", "借方发生额", "贷方发生额"]), ("c", 1, 0, 2, ["2024/01/03 10:20:30", "7.00", ""])]
    got = parse.sheet_ledger(spark.createDataFrame(rows, CELLS)).orderBy("source_file", "page_no").collect()
    assert [(r.source_file, r.income, r.expense, r.transaction_time) for r in got] == [("a", D(5), 0, datetime(2024, 1, 1)), ("a", 0, D(6), datetime(2024, 1, 2)), ("c", 0, D(7), datetime(2024, 1, 3, 10, 20, 30))]
    with pytest.raises(ValueError):
        parse.role_words(spark.range(parse.MAX_WORDS + 1).select(F.lit("r").alias("role"), F.col("id").alias("ord"), F.col("id").cast("string").alias("keyword")))


def test_sub_layouts_and_filtered_exports(spark):
    rows = [("a", 1, 0, 1, ["x"]), ("a", 1, 0, 2, ["交易时间", "借/贷"]), ("a", 1, 0, 3, ["r1"]), ("a", 1, 0, 4, ["转入金额", "交易时间", "转出金额"]), ("a", 2, 0, 1, ["r2"])]
    got = parse.sub_layout(spark.createDataFrame(rows, CELLS), [("b", ["交易时间", "借/贷"]), ("d", ["转入金额", "转出金额"])])
    assert sorted((r.cells[0], r.layout) for r in got.collect()) == [("r1", "b"), ("r2", "d")]
    says = spark.createDataFrame([("a", 1, 0, 1, ["按收支筛选：", "收入"]), ("b", 1, 0, 1, ["按收支筛选: 支出"]), ("c", 1, 0, 1, ["按收支筛选: 全部"]), ("d", 1, 0, 1, ["x"]), ("a", 1, 0, 130, ["按收支筛选：支出"])], CELLS)
    assert {r.file: r.direction for r in parse.filter_direction(says).collect()} == {"a": "income", "b": "expense", "c": None}


def test_candidate_variants(spark):
    d = lambda t, s="": [float(x) for x in one(spark, money.directed_candidates(F.lit(t), F.lit(s)))]
    assert d("1,234.50") == [1234.5, 234.5, 34.5, 4.5] and d("12.30", "支") == [-12.3, -2.3] and d("x") == [] and d("-5.00") == [-5.0]
    p = lambda t, **how: [float(x) for x in one(spark, money.parted_candidates(F.lit(t), **how))]
    assert p("") == [0.0] and p("-5.25|6.50", signed=True)[:1] == [-5.25] and 6.5 in p("-5.25|6.50", signed=True) and len(p("1234567.89|7654321.98")) == 24
    o = lambda t: [float(x) for x in one(spark, money.ocr_candidates(F.lit(t)))]
    assert o("IO0.5S")[0] == 100.55 and o("l23456")[-1] == 1234.56


def test_joint_reading(spark):
    df = ledger(spark, [(0, 100), (0, 0), (0, 0), (0, 0)]).withColumn("posting_seq", F.col("row_no"))
    raw = spark.createDataFrame([(1, "+10.00", "100.00"), (2, "+95.00", "105.00"), (3, "-1,20.00", "9\n85.00"), (4, "x", "1.00")], "row_no bigint, raw_amount string, raw_balance string")
    got = sequence.pick_amount_and_balance(df.drop("raw_amount", "raw_balance").join(raw, "row_no")).orderBy("row_no").collect()
    assert [(r.fixed_income, r.fixed_expense, r.fixed_balance, r.fixed_by) for r in got] == [(10, 0, 100, None), (5, 0, 105, None), (0, 20, 85, None), (None, None, 1, "amount_unreadable")]


def test_proven_exclusions(spark):
    rows = ordering.posting_order(ledger(spark, [(-2, 5329.42), (39.82, 15967.17), (-25, 5304.42)]).withColumn("sha256", F.lit("f")))
    made = lambda sha, after, row=2: spark.createDataFrame([("c", sha, 0, row, D("39.82"), D("15967.17"), D("5329.42"), D("25"), D(after), "exclude", "seen")], "id string, sha256 string, page int, row bigint, income decimal(18,2), balance decimal(18,2), previous_balance decimal(18,2), next_expense decimal(18,2), next_balance decimal(18,2), action string, basis string")
    for c, left, audited, reasons in ((made("f", "5304.42"), 2, 1, []), (made("f", "1"), 3, 0, ["neighbours_differ"]), (made("f", "5304.42", 3), 3, 0, ["no_such_row"]), (made("g", "1"), 3, 0, [])):
        kept, audit, errors = filters.proven_exclusions(rows, c)
        assert (kept.count(), audit.count(), [r.reason for r in errors.collect()]) == (left, audited, reasons)


def two_files(spark, bank, a, b):
    f = lambda rows, name: ledger(spark, rows).withColumns({"bank_id": F.lit(bank), "source_file": F.lit(name), "account_name": F.lit(None).cast("string")})
    return f(a, "a").unionByName(f(b, "b"))


def test_merged_files(spark):
    day = lambda k: datetime(2026, 1, k)
    trail = merge.merge_sequenced(two_files(spark, "mintai", [(-5, 115, day(1)), (10, 110, day(1))], [(10, 120, day(1))]))
    assert [int(r.balance) for r in trail.orderBy("row_no").collect()] == [110, 120, 115] and {r.statement_id for r in trail.collect()} == {"account:1"}
    timed = merge.merge_sequenced(two_files(spark, "ccb_corp", [(1, 4, day(4))], [(1, 2, day(2)), (1, 3, day(3))])).orderBy("row_no").collect()
    assert [(r.row_no, int(r.balance), r.source_row_no) for r in timed] == [(1, 2, 1), (2, 3, 2), (3, 4, 1)]
    parts = merge.merge_segments(two_files(spark, "chaoyang_corp", [(1, 101, day(1)), (1, 102, day(2))], [(1, 102, day(2)), (1, 103, day(3)), (9, 500, day(9))]))
    got = parts.orderBy("row_no").collect()
    assert [(int(r.balance), r.balance_segment_start) for r in got] == [(101, True), (102, False), (103, False), (500, True)]
    assert chain.row_issues(ordering.posting_order(parts)).count() == 0
    alone = merge.merge_segments(two_files(spark, "other", [(1, 1)], [(1, 2)]))
    assert {r.statement_id for r in alone.collect()} == {"file:a", "file:b"}


def test_page_parts(spark):
    df = two_files(spark, "rural_commercial", [(1, 5, datetime(2026, 2, 1))], [(1, 4, datetime(2026, 1, 1))])
    pages = lambda b, total: spark.createDataFrame([("a", "rural_commercial", "1", 1, 2, total, "s"), ("b", "rural_commercial", "1", *b, total, "s")], "source_file string, bank_id string, account_no string, first_page int, last_page int, total_pages int, signature string")
    how = lambda *a: {r.coverage for r in merge.merge_page_parts(df, *a).collect()}
    assert how(pages((3, 4), 4)) == {"complete"} and how(pages((2, 4), 4)) == {"complete"} and how(pages((4, 4), 4)) == {None} and how(pages((3, 3), 4)) == {None}
    assert how(pages((3, 3), 4), datetime(2026, 1, 1)) == {"newest_pages"} and how(pages((3, 3), 4), datetime(2025, 1, 1)) == {None}


def test_documents(spark):
    rows = [(10000, 11000, datetime(2026, 1, 5)), (-500, 10500, datetime(2026, 2, 5))]
    own = ledger(spark, rows, flow_type="personal", source_file="a")
    firm = ledger(spark, [(70000, 70000, datetime(2026, 3, 1))], account="2", flow_type="corporate", source_file="b")
    wallet = ledger(spark, [(100, None, datetime(2026, 1, 9))], account="3", flow_type="wechat", source_file="c")
    both = own.unionByName(firm).unionByName(wallet).withColumn("raw_text", F.when(F.col("income") == 10000, "工资"))
    doc = json.loads(summary.income_document(both, spark.createDataFrame([("c1",)], "id string")).first().document)
    assert doc["personal_flow"]["summary"]["income_count"] == 2 and doc["personal_flow"]["summary"]["income_wan"] == 1.01 and [m["month"] for m in doc["personal_flow"]["months"]] == ["2026.01", "2026.02"]
    assert doc["corporate_flow"]["latest_balance_wan"] == 7.0 and [a["account_no"] for a in doc["personal_flow"]["accounts"]] == ["1", "3"] and doc["notes"]["source_confirmations"] == ["c1"] and doc["customer"]["name"] == ""
    salary = text.is_salary(F.col("income"), F.col("raw_text"), F.col("raw_fields"))
    paid = json.loads(summary.income_document(both, salary=salary).first().document)
    assert paid["proof_type"] == "salary" and paid["salary_flow"]["summary"]["income_count"] == 1 and paid["salary_flow"]["summary"]["income_wan"] == 1.0 and "corporate_flow" not in paid
    listed = summary.salary_listing(own.withColumn("raw_text", F.lit("a | b")), F.col("income") > 0).orderBy("position").collect()
    assert [(r.kind, r.value, r.amount_col) for r in listed] == [("row", 10000, 1), ("total", 10000, 1), ("months", 1, 1), ("mean", 10000, 1)] and listed[0].fields == ["a", "b"]


def test_combined_months_and_totals(spark):
    df = ledger(spark, [(5, 5, datetime(2026, 1, 5)), (-2, 3, datetime(2026, 3, 5))]).withColumn("source_file", F.lit("a"))
    months = spark.createDataFrame([("2026-01",), ("2026-02",)], "month string")
    assert {r.month: (r["count"], r.net) for r in summary.combined_months(df, months).collect()} == {"2026-01": (1, 5), "2026-02": (0, 0)}
    assert summary.overall(df.unionByName(df.withColumn("source_file", F.lit("b")))).first()["count"] == 2


def test_checks_and_reports(spark):
    df = ledger(spark, [(5, 5, datetime(2026, 1, 5)), (5, 11, datetime(2026, 2, 5)), (5, 15, datetime(2026, 3, 5))]).withColumn("source_file", F.lit("a"))
    gold = df.withColumn("balance", F.when(F.col("row_no") == 2, D("10.00")).otherwise(F.col("balance")))
    differences, figures = reports.gold_check(df, gold, date(2026, 2, 1), date(2026, 3, 31))
    assert [(r.position, r.differs) for r in differences.collect()] == [(1, "balance")] and {(r.side, r["count"]) for r in figures.collect()} == {("ledger", 2), ("gold", 2)}
    keyed = df.withColumn("merge_key", F.col("row_no").cast("string"))
    differences, _ = reports.merged_gold_check(keyed.unionByName(keyed.withColumn("source_file", F.lit("b"))), keyed.filter("row_no < 3"))
    assert differences.count() == 0
    issues = chain.row_issues(ordering.posting_order(df)).withColumnRenamed("account_no", "source_file")
    listing = reports.layout_listing(summary.summarize(df).withColumnRenamed("account_no", "source_file"), issues).first()
    assert (listing.status, listing.issues, listing.first_issues[:13]) == ("review", 2, "balance_break")
    r = reports.batch_report(spark.createDataFrame([("1", "REVIEW"), ("2", "PASS")], "source_file string, status string"), issues)
    assert {(x.status, x.files) for x in r["overview"].collect()} == {("REVIEW", 1), ("PASS", 1), (None, 2)} and r["issues"].count() == 2
    assert [x["count"] for x in reports.simple_report(df.withColumn("raw_text", F.lit("k")), "raw_text")["by_kind"].collect()] == [3]
    assert [x.place for x in reports.detail_listing(df).orderBy("place").collect()] == [1, 2, 3]
    scores = quality.file_scores(summary.summarize(df), quality.issue_counts(chain.row_issues(ordering.posting_order(df))), df.select("account_no", F.lit(False).alias("recent"), F.lit(False).alias("recent_closed")).distinct(), message=F.lit(True))
    assert scores.first().score == 80 - 12 + 10 - 8  # closed in total, with breaks


def test_scenario_totals(spark):
    months = spark.createDataFrame([("1", "2026-01", D(5), D(1), D(10)), ("1", "2026-02", D(0), D(30), None)], "account_no string, month string, income_sum decimal(18,2), expense_sum decimal(18,2), opening_balance decimal(18,2)")
    deltas = spark.createDataFrame([("1", "2026-01", D(2), D(0))], "account_no string, month string, income_delta decimal(18,2), expense_delta decimal(18,2)")
    total = scenario.with_totals(scenario.scenario_months(months, deltas, "s")).filter("month IS NULL").first()
    assert (total.observed_income, total.income_delta, total.opening, total.closing, total.status, total.is_observed) == (5, 2, 10, -14, "review", False)


def test_wide_rows_are_not_cut(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("\n".join([",".join(f"c{k}" for k in range(70)), "x,y", '"p, q",r', ",".join([""] * 99 + ["end"])]))
    rows = io.sheet_cells(spark, str(tmp_path / "in")).orderBy("row_no").collect()
    assert [(r.row_no, len(r.cells)) for r in rows] == [(1, 70), (2, 2), (3, 2), (4, 100)] and rows[0].cells[-1] == "c69" and rows[3].cells[-1] == "end"
    with pytest.raises(Exception, match="more than 64 cells"):
        io.sheet_cells(spark, str(tmp_path / "in"), width=64).collect()
    with pytest.raises(ValueError):
        io.sheet_cells(spark, str(tmp_path / "in"), widest=80)


def test_layout_registry(spark):
    known = layouts(spark)
    shapes = {r.shape: r.n for r in known.groupBy("shape").agg(F.count("*").alias("n")).collect()}
    assert shapes["L"] >= 8 and shapes["C"] >= 8 and shapes["P"] >= 8 and shapes["M"] >= 3 and known.select("bank_id", "shape", "amount_mode").distinct().count() == known.count()  # some banks print several shapes
    lines = spark.createDataFrame([("f", "everbright_corp", 1, 1, "1 20260102 101112 贷方 1,000.00 2,000.00 货款"), ("f", "everbright_corp", 1, 2, "2 20260103 101112 借方 5.00 1,995.00"), ("g", "hebei_personal", 1, 1, "20260104 借 7.00 3.00 x"), ("h", "rural_commercial", 1, 1, " 3 转账 人民币元 钞 20260105 -8.00 9.00"), ("h", "rural_commercial", 1, 2, "合计 8.00")], "file string, bank_id string, page_no int, line_no int, text string")
    got = parse.line_ledger(lines, known).orderBy("transaction_time").collect()
    assert [(r.bank_id, r.income, r.expense, r.balance, r.transaction_time) for r in got] == [
        ("everbright_corp", 1000, 0, 2000, datetime(2026, 1, 2, 10, 11, 12)), ("everbright_corp", 0, 5, 1995, datetime(2026, 1, 3, 10, 11, 12)), ("hebei_personal", 0, 7, 3, datetime(2026, 1, 4)), ("rural_commercial", 0, 8, 9, datetime(2026, 1, 5))]


def test_many_rows_of_one_timestamp(spark):
    rows = [(1, 100 + k) for k in range(1, 4001)]
    got = sequence.greedy_order(ledger(spark, rows[::-1]), newest_first=False)
    assert [int(r.balance) for r in got.orderBy("statement_order").collect()] == [100 + k for k in range(1, 4001)]
