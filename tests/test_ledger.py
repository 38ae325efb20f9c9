"""Operators on the rows that the reference's own tests use, and on properties."""

import random
from datetime import date, datetime
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from ledgerline.functions import money, text
from ledgerline.operators import chain, dedupe, detect, filters, ordering, parse, quality, scenario, sequence, summary, verify
from ledgerline.sources.ledgers import with_defaults

T = "account_no string, transaction_time timestamp, income decimal(18,2), expense decimal(18,2), balance decimal(18,2), row_no bigint, raw_time string"


def ledger(spark, rows, clock=False, account="1", **more):
    """rows: (amount, balance[, time])"""
    out = []
    for k, (amount, balance, *at) in enumerate(rows):
        t = at[0] if at else datetime(2026, 1, 1)
        a = D(str(amount))
        out.append((account, t, max(a, D(0)), max(-a, D(0)), None if balance is None else D(str(balance)), k + 1, t.strftime("%Y-%m-%d %H:%M:%S") if clock else t.strftime("%Y%m%d")))
    df = spark.createDataFrame(out, T)
    for c, v in more.items():
        df = df.withColumn(c, F.lit(v))
    return with_defaults(df)


def issues(df):
    ordered = ordering.posting_order(df)
    return [r.code for r in chain.row_issues(ordered).orderBy("posting_seq").collect()]


def balances(df):
    return [int(r.balance) for r in df.orderBy("statement_order").collect()]


def test_greedy_order_of_one_day(spark):
    got = sequence.greedy_order(ledger(spark, [(-5, 115), (10, 110), (10, 120)]))
    assert balances(got) == [110, 120, 115] and issues(got) == []
    assert summary.summarize(got).first().opening_balance == 100


def test_gap_is_not_hidden(spark):
    got = sequence.greedy_order(ledger(spark, [(10, 110), (10, 150, datetime(2026, 1, 2))]))
    assert issues(got) == ["balance_break"]


def test_balance_cycle(spark):
    got = sequence.euler_order(ledger(spark, [(-10, 90), (-5, 85), (10, 100), (-10, 90)]))
    s = summary.summarize(got).first()
    assert got.count() == 4 and issues(got) == [] and s.expense_sum == 25


def test_clock_not_monotone(spark):
    got = sequence.euler_order(ledger(spark, [(10, 110, datetime(2026, 1, 1, 23)), (-5, 105, datetime(2026, 1, 1, 7))], clock=True))
    assert issues(got) == [] and sorted(r.transaction_time.hour for r in got.collect()) == [7, 23]


def test_disconnected_rows_stay(spark):
    got = sequence.euler_order(ledger(spark, [(10, 110), (-5, 300)]))
    assert balances(got) == [110, 300] and issues(got) == ["balance_break"]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_euler_order_is_a_linked_permutation(spark, seed):
    rng = random.Random(seed)
    rows, b = [], 100
    for day in range(1, 6):
        for _ in range(rng.randint(1, 8) if day > 1 else 1):  # a closed circle on the first day could start anywhere
            a = rng.choice([-10, -5, 5, 10])
            b += a
            rows.append((a, b, datetime(2026, 1, day)))
    rng.shuffle(rows)
    for order in (sequence.euler_order, lambda d: sequence.euler_order(d.repartition(3), newest_first=True)):
        got = order(ledger(spark, rows))
        assert issues(got) == [] and sorted(balances(got)) == sorted(r[1] for r in rows)


def test_signed_reversal_columns(spark):
    df = ledger(spark, [(-10, 90), (0, 100)], preserve_signed=True).withColumn("expense", F.when(F.col("row_no") == 2, -10).otherwise(F.col("expense")).cast("decimal(18,2)"))
    s = summary.summarize(df).first()
    assert (s.expense_sum, s.expense_count, s.income_count) == (0, 2, 0) and issues(df) == []


def test_counting_of_zero_and_neutral_rows(spark):
    df = ledger(spark, [(0, 100), (5, 105), (-5, 100), (7, 107)]).withColumn("neutral", F.col("row_no") == 4)
    s = summary.summarize(df).first()
    assert (s["count"], s.income_count, s.expense_count, s.income_sum, s.closing_balance) == (3, 2, 1, 5, 107)


def test_confirmed_exclusion(spark):
    df = ledger(spark, [(-2, 5329.42), (39.82, 15967.17), (-25, 5304.42)]).withColumn("sha256", F.lit("f"))
    confirm = lambda sha: spark.createDataFrame([("c", sha, 0, 2, D("39.82"), D("15967.17"), "exclude", "seen")], "id string, sha256 string, page int, row bigint, income decimal(18,2), balance decimal(18,2), action string, basis string")
    kept, audit = filters.confirmed_exclusions(df, confirm("f"))
    assert kept.count() == 2 and audit.count() == 1
    assert filters.confirmed_exclusions(df, confirm("g"))[0].count() == 3


def test_newest_first_ties_over_pages(spark):
    rows = [(305.06, 468754.70), (-637.22, 468449.64), (-637.22, 469086.86), (100, 469724.08)]
    got = ordering.same_time_if_proven(ledger(spark, rows))
    s = summary.summarize(got).first()
    assert issues(got) == [] and (s.income_sum, s.expense_sum) == (D("405.06"), D("1274.44"))
    unproven = ordering.same_time_if_proven(ledger(spark, [(-10, 90), (-10, 80), (-10, 90), (-10, 71)]))
    assert not unproven.filter("reversed").count()


def test_same_second_fee(spark):
    t = datetime(2026, 3, 1, 10, 0, 0)
    got = ordering.same_time_by_score(ledger(spark, [(-15, 8071.24, t), (-110000, 8086.24, t)], clock=True))
    s = summary.summarize(got).first()
    assert (s.opening_balance, s.closing_balance) == (D("118086.24"), D("8071.24")) and issues(got) == []


def test_midnight_rollover(spark):
    rows = [(10, 110, datetime(2026, 7, 15, 23, 59)), (5, 115, datetime(2026, 7, 16, 0, 7)), (5, 300, datetime(2026, 7, 15, 8))]
    got = chain.mark_optional_dates(ordering.posting_order(ledger(spark, rows, clock=True)))
    assert {r.row_no: r.balance_optional for r in got.collect()} == {1: True, 2: False, 3: True}


def test_greedy_variants(spark):
    rows = [(10, 110), (10, 130), (10, 120), (5, 500)]
    seg = sequence.greedy_order(ledger(spark, rows), newest_first=False, segments=True)
    assert balances(seg) == [110, 120, 130, 500] and [r.balance_segment_start for r in seg.orderBy("statement_order").collect()] == [True, False, False, True]
    stop = sequence.greedy_order(ledger(spark, [(1, 50), *rows]), newest_first=False, stop_at_miss=True)
    assert balances(stop) == [50, 110, 130, 120, 500]


def test_flags_and_signs(spark):
    df = spark.createDataFrame([("C&#x9;", "10", "0.00", "-200.00"), ("D\t", "10", "0.00", "-200.00")], "f string, a string, c string, d string")
    flag = parse.flag_mode(money.to_money(F.col("a")), F.col("f"))
    cols = parse.separate_mode(money.to_money(F.col("c")), money.to_money(F.col("d")))
    got = df.select(flag["income"].alias("i"), flag["expense"].alias("e"), cols["income"].alias("ci"), cols["expense"].alias("ce")).collect()
    assert [tuple(r) for r in got] == [(10, 0, 200, 0), (0, 10, 200, 0)]


def test_proven_reversal_pair(spark):
    got = chain.without_reversal_pairs(ordering.posting_order(ledger(spark, [(-100, 10), (100, 110), (10, 120)])))
    assert [(r.income, r.balance) for r in got.collect()] == [(10, 120)]


def test_amounts_from_balance(spark):
    df = ledger(spark, [(100, 1100), (0, 1300), (-50, 1250)])
    got = chain.amounts_from_balance(ordering.posting_order(df)).orderBy("posting_seq").collect()
    assert [(r.income, r.expense, r.repaired) for r in got] == [(100, 0, None), (200, 0, "amount_from_balance"), (0, 50, None)]
    unmoved = chain.without_unmoved(ordering.posting_order(ledger(spark, [(5, 100), (-10, 100), (-10, 90)])))
    assert unmoved.count() == 2


def test_strict_money(spark):
    df = spark.createDataFrame([("",), ("100.00J",), ("100.00 200.00",), ("￥-1,000.00",), ("1,00.00",)], "t string")
    got = [tuple(r.m) for r in df.select(money.strict_money(F.col("t")).alias("m")).collect()]
    assert got == [(None, "money_blank"), (None, "money_invalid"), (None, "money_invalid"), (D("-1000.00"), None), (None, "money_invalid")]


def test_noisy_money(spark):
    df = spark.createDataFrame([("5\n4\n1,627.28", "-6828.00"), ("BC37A0,244.26", "+1,2345.00"), ("", "-12.345")], "b string, a string")
    got = df.select(money.balance_candidates(F.col("b")).alias("b"), money.amount_candidates(F.col("a")).alias("a")).collect()
    assert got[0].b[:3] == [D("541627.28"), D("41627.28"), D("1627.28")] and D("-88.00") not in got[0].a and D("-828.00") in got[0].a
    assert {D("370244.26"), D("70244.26"), D("244.26")} <= set(got[1].b) and got[1].a[0] == D("1345.00") or D("1234.00") in got[1].a
    assert got[2].b == [] and got[2].a[:3] == [D("-12.34"), D("-2.34"), D("-1.34")] or D("-12.35") in got[2].a
    half = spark.createDataFrame([(D("0.125000"),)], "x decimal(20,6)").select(money.half_even(F.col("x")).alias("e"), money.half_up(F.col("x")).alias("u")).first()
    assert (half.e, half.u) == (D("0.12"), D("0.13"))


def test_beam_prefers_the_whole_statement(spark):
    rows = [("a", 1, "+1.00", "1,512.00"), ("a", 2, "-937.00", "71,475.00"), ("a", 3, "+25.00", "1,500.00")]
    df = spark.createDataFrame(rows, "account_no string, ingest_seq bigint, raw_amount string, raw_balance string")
    got = sequence.beam_readings(df, ["account_no"], ["ingest_seq"]).orderBy("ingest_seq").collect()
    assert [(r.amount, r.balance, r.issue) for r in got] == [(D(1), D(1512), None), (D(-37), D(1475), None), (D(25), D(1500), None)]


def test_long_statement_settles_in_parts(spark):
    rows, b = [], D(1000)
    for k in range(300):
        b += D(10 + k)
        rows.append(("a", k, f"+{10 + k}.00", f"{b:,.2f}"))
    df = spark.createDataFrame(rows, "account_no string, ingest_seq bigint, raw_amount string, raw_balance string")
    got = sequence.beam_readings(df, ["account_no"], ["ingest_seq"]).orderBy("ingest_seq").collect()
    assert len(got) == 300 and all(r.issue is None for r in got) and got[-1].balance == b


def test_scaled_and_backward(spark):
    scaled = sequence.scale_repair(ordering.posting_order(ledger(spark, [(10, 110), (-2000, 9000), (5, 95)]))).orderBy("posting_seq").collect()
    assert [(r.fixed_expense, r.fixed_balance) for r in scaled][1] == (20, 90)
    back = sequence.backward_chain(ordering.posting_order(ledger(spark, [(10, 110), (-20, None), (5, 100), (1, 7)]))).orderBy("posting_seq").collect()
    assert [(r.fixed_balance, r.fixed_by) for r in back] == [(110, None), (90, "balance_filled"), (100, "amount_derived"), (101, "balance_filled")]
    assert back[2].fixed_income == 10


def test_dates_from_digits(spark):
    df = spark.createDataFrame([("a", 1, "2024/01/05"), ("a", 2, "20x24-01-0399"), ("a", 3, "?"), ("a", 4, "2024-01-09")], "account_no string, ingest_seq bigint, raw_time string")
    got = [r.read_date for r in sequence.dates_in_sequence(df, ["account_no"], ["ingest_seq"]).orderBy("ingest_seq").collect()]
    assert got[0] == date(2024, 1, 5) and got[0] <= got[1] == got[2] <= got[3]


def test_overlapping_exports(spark):
    one = ledger(spark, [(10, 110)]).withColumn("source_file", F.lit("a"))
    other = one.withColumn("source_file", F.lit("b"))
    assert dedupe.dedupe(one.unionByName(other)).count() == 1
    assert dedupe.dedupe(one.unionByName(other.withColumn("account_no", F.lit("2")))).count() == 2
    assert dedupe.dedupe(one.unionByName(one)).count() == 2
    twice = dedupe.dedupe(one.unionByName(other).unionByName(one))
    assert dedupe.dedupe(twice).count() == twice.count() == 2
    assert dedupe.dedupe_by_serial(one.unionByName(other).withColumn("raw_text", F.lit("0012345 x")), "raw_text").count() == 1
    assert dedupe.later_wins(one, other).first().source_file == "b"


def test_account_merge(spark):
    a = ledger(spark, [(10, 110)]).withColumns({"source_file": F.lit("a"), "account_name": F.lit("n")})
    b = ledger(spark, [(10, 120, datetime(2026, 2, 1))]).withColumns({"source_file": F.lit("b"), "account_name": F.lit("n")})
    got = dedupe.merge_statements(a.unionByName(b)).collect()
    assert {r.statement_id for r in got} == {"account:1"} and len(got) == 2


def test_income_block_of_overlapping_files(spark):
    rows = [(10000, 11000, datetime(2026, 1, 5)), (5000, 16000, datetime(2026, 2, 5))]
    late = [(5000, 16000, datetime(2026, 2, 5)), (-2000, 14000, datetime(2026, 3, 5))]
    two = ledger(spark, rows, flow_type="personal").withColumn("source_file", F.lit("a")).unionByName(ledger(spark, late, flow_type="personal").withColumn("source_file", F.lit("b")))
    r = summary.income_block(dedupe.dedupe(two)).first()
    assert (r.income_count, r.income_wan, r.expense_wan, r.latest_balance_wan) == (2, D("1.50"), D("0.20"), D("1.40"))
    assert '"latest_balance_wan":1.40' in summary.income_document(dedupe.dedupe(two)).first().document


def test_fixed_divisor(spark):
    rows = [(60000, 60000 * k, datetime(2026, k, 1)) for k in range(1, 6)]
    assert summary.income_block(ledger(spark, rows, flow_type="x")).first().income_average_wan == D("5.00")


def test_spreadsheet_rows(spark):
    from ledgerline.plans.queries import role_keywords

    cells = [("f", 1, 0, 1, ["凭证号", "交易日期", "借方发生额", "贷方发生额", "余额"]), ("f", 1, 0, 2, ["08929691", "20260301", "0.00", "31900.00", "1389830.20"]), ("f", 2, 0, 1, ["x", "2026年3月2日", "5.00", "", "1,389,825.20"])]
    df = spark.createDataFrame(cells, "file string, page_no int, table_no int, row_no int, cells array<string>")
    got = parse.sheet_ledger(df, role_keywords(spark)).orderBy("page_no").collect()
    assert [(r.income, r.expense, r.balance, r.transaction_time) for r in got] == [(D("31900.00"), 0, D("1389830.20"), datetime(2026, 3, 1)), (0, 5, D("1389825.20"), datetime(2026, 3, 2))]


def test_detection_precedence(spark):
    rules = spark.createDataFrame([(1, "own", "header", ["own bank", "detail"], "Own", 95, "a"), (2, "other", "body", ["otherbank"], "Other", 80, "b")], "ord int, bank_id string, scope string, markers array<string>, label string, confidence int, reason string")
    docs = spark.createDataFrame([("1", "own bank detail", "own bank detail otherbank"), ("2", "", "otherbank"), ("3", "", "x")], "file string, header string, body string")
    assert {r.file: (r.bank_id, r.confidence) for r in detect.first_match(docs, rules).collect()} == {"1": ("own", 95), "2": ("other", 80), "3": ("unknown", 0)}
    with pytest.raises(ValueError):
        detect.first_match(docs, rules, max_rules=1)


def test_fuzzy_characters(spark):
    df = spark.createDataFrame([("a..b..c",), ("a" + "." * 100 + "bc",), ("acb",)], "t string")
    assert [r[0] for r in df.select(text.ordered_chars(F.col("t"), "abc")).collect()] == [True, False, False]


def test_owner_and_number(spark):
    df = spark.createDataFrame([("账号：6222-0212 3456 7890 户名：某人\n",), ("账号 20240101",)], "t string")
    got = df.select(text.account_number(F.col("t")).alias("n"), text.first_label(F.col("t"), [r"户名：(\S+)"]).alias("o")).collect()
    assert [(r.n, r.o) for r in got] == [("6222021234567890", "某人"), (None, None)]


def test_month_ranges():
    for t in ("2025-11~2026-04", "25年11月-26年4月", "2511-2604", "202511-202604"):
        assert text.month_range(t) == ("2025-11", "2026-04")
    assert text.month_range("all") == (None, None)
    assert text.default_months(date(2026, 4, 10)) == ("2025-11", "2026-04") and text.default_months(date(2026, 4, 10), from_day=15) == ("2025-10", "2026-03")
    with pytest.raises(ValueError):
        text.month_range("2025-13")


def test_split_totals(spark):
    months = spark.createDataFrame([("a", f"2026-0{k}", D(k)) for k in range(1, 8)], "account_no string, month string, w decimal(18,2)")
    even = scenario.split_evenly(months, F.lit(100).cast("decimal(18,2)"), ["account_no"])
    assert sum(r.share for r in even.collect()) == 100
    assert sum(r.share for r in scenario.split_by_weight(months, F.lit(D("99.99")), "w", "month", ["account_no"]).collect()) == D("99.99")
    flows = spark.createDataFrame([("2026-01", "p", D(0), D(3)), ("2026-01", "q", D(0), D(1))], "month string, flow_type string, income_sum decimal(18,2), expense_sum decimal(18,2)")
    got = {r.flow_type: r.share for r in scenario.allocate_by_flow(flows, spark.createDataFrame([("2026-01", D(8))], "month string, amount decimal(18,2)")).collect()}
    assert got == {"p": 6, "q": 2}


def test_scores(spark):
    s = spark.createDataFrame([("1", 10, 0, 0, 80), ("2", 0, 0, 0, 0), ("3", 30, 1, 2, 90)], "account_no string, count bigint, reviews bigint, low_risks bigint, score int")
    r = quality.overall_score(s).first()
    assert (r.score, r.level) == (82, "medium")  # 87.5 rounds to 88, less 4 and 2


def test_printed_totals_and_positions(spark):
    a = spark.createDataFrame([("1", 1, D(5)), ("1", 2, D(6))], "account_no string, k int, v decimal(18,2)")
    got = verify.compare_positions(a, a.filter("k = 2"), ["v"], ["k"]).orderBy("position").collect()
    assert [(r.position, r.side, r.differs) for r in got] == [(1, "both", "v"), (2, "left", "v")]


def test_readers_and_sinks(spark, tmp_path):
    from ledgerline.sources import io

    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "deep" / "a.txt").write_text("l1\nl2\fp2")
    (tmp_path / "in" / "b.csv").write_text('x,"y\nz",\n1,2,3\n')
    (tmp_path / "in" / "c.json").write_text('{"bank_id": "k"}')
    (tmp_path / "in" / "_t.json").write_text('{"bank_id": "template"}')
    assert sorted((r.page_no, r.line_no, r.text) for r in io.text_lines(spark, str(tmp_path / "in")).collect()) == [(1, 1, "l1"), (1, 2, "l2"), (2, 1, "p2")]
    assert [r.cells for r in io.sheet_cells(spark, str(tmp_path / "in")).orderBy("row_no").collect()] == [["x", "y\nz"], ["1", "2", "3"]]
    assert [r.bank_id for r in io.layout_files(spark, str(tmp_path / "in")).collect()] == ["k"]
    assert io.find_files(spark, str(tmp_path / "in")).count() == 1
    df = ledger(spark, [(1, 2)])
    for kind in ("parquet", "csv", "json"):
        io.write_tables({"detail": df, "summary": summary.summarize(df)}, str(tmp_path / kind), "r1", kind)
        assert spark.read.format(kind).option("header", "true").load(str(tmp_path / kind / "summary")).first().run_id == "r1"
    io.write_documents(summary.income_document(df), str(tmp_path / "docs"))
    assert spark.read.json(str(tmp_path / "docs")).count() == 1


def test_streams(spark, tmp_path):
    from ledgerline.streaming import arrivals

    rows = [(10, 110, datetime(2026, 1, 1)), (5, 115, datetime(2026, 1, 2)), (5, 200, datetime(2026, 1, 3))]
    df = ledger(spark, rows)
    df.filter("row_no < 3").coalesce(1).write.parquet(str(tmp_path / "in"))
    df.filter("row_no > 1").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run(make, mode):
        stream = make(arrivals.ledger_stream(spark, str(tmp_path / "in"), df.schema, 1))
        q = stream.writeStream.outputMode(mode).format("memory").queryName("got").trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table("got").collect()

    assert len(run(arrivals.without_repeats, "append")) == 3
    assert max(r.rows for r in run(arrivals.period_totals, "update")) >= 2
    breaks = run(lambda s: arrivals.chain_breaks(arrivals.without_repeats(s)), "append")
    assert [(r.row_no, r.expected, r.balance) for r in breaks] == [(3, 12000, 20000)]


@pytest.mark.parametrize("read", [money.amount_candidates, money.balance_candidates, money.parted_candidates])
def test_candidates_are_split_once(spark, read):
    # inside lambdas an expression runs as often as it is written, and here for each pair of digits
    plan = spark.createDataFrame([("5\n1,234.56",)], "t string").select(read(F.col("t")))._jdf.queryExecution().analyzed().toString()
    assert plan.count("split(") <= 12


def test_first_rows_sort_only_what_is_used(spark):
    rows = with_defaults(spark.range(400).selectExpr("CAST(id * 0 AS STRING) AS account_no", "CAST(id AS STRING) AS raw_text", "CAST(id % 2 AS STRING) AS merge_key", "id AS row_no", "TIMESTAMP '2026-01-01' AS transaction_time", "'a' AS source_file"))
    for got, first in ((dedupe.dedupe(rows), [0, 1]), (dedupe.dedupe_by(rows, "merge_key"), [0, 1]), (dedupe.dedupe_by_serial(rows.withColumn("raw_text", F.concat(F.lit("123456 x"), "row_no")), "raw_text"), [0])):
        plan = got.select("row_no")._jdf.queryExecution().executedPlan().toString()
        assert "WindowGroupLimit" in plan and "min_by(struct(account_no" not in plan
        assert sorted(r.row_no for r in got.collect()) == first
