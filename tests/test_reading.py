"""Reading a batch: words and visual lines, modes by layout, policies by statement, trails, detection by automaton."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import detect, parse, reading, sequence
from ledgerline.sources.detection import detection_rules
from ledgerline.sources.layouts import layouts

WORDS = "file string, bank_id string, page_no int, x0 double, x1 double, top double, text string"


def test_middle_of_a_word_and_visual_lines(spark):
    # mintai: the date column ends at 48; an amount lies over that edge, its halves 0.3 apart; a footer lies far below
    words = [("f", "mintai", 1, 2.0, 40.0, 20.0, "20240101"), ("f", "mintai", 1, 47.0, 55.0, 20.3, "5"), ("f", "mintai", 1, 55.0, 60.0, 20.0, ".00"), ("f", "mintai", 1, 160.0, 170.0, 20.0, "1.00"), ("f", "mintai", 1, 50.0, 52.0, 60.0, "9")]
    got = parse.word_ledger(spark.createDataFrame(words, WORDS), None, layouts(spark)).first()
    assert (str(got.income), str(got.expense), got.raw_time, got.issue_codes) == ("5.00", "0.00", "20240101", [])


def test_lines_of_a_cell(spark):
    cells = spark.createDataFrame([("f", 1, 10.0, 12.0, 30.0, "b"), ("f", 1, 20.0, 22.0, 28.5, "c"), ("f", 1, 5.0, 7.0, 29.0, "a"), ("f", 1, 5.0, 7.0, 33.0, "d")], "file string, page_no int, x0 double, x1 double, top double, text string")
    anchors = spark.createDataFrame([("f", 1, 28.0, 1)], "file string, page_no int, top double, row_no int")
    columns = spark.createDataFrame([("f", "x", 0.0, 50.0)], "file string, name string, left double, right double")
    assert parse.band_cells(cells, anchors, columns).first().text == "abc\nd"


def test_wallets_and_sheets_by_the_registry(spark):
    rows = [("w", "wechat", 0, ["交易时间", "收/支", "金额(元)"]), ("w", "wechat", 1, ["2024-01-02 10:00:00", "不计收支", "5.00"]), ("w", "wechat", 2, ["2024-01-03 10:00:00", "收入", "7.00"]),
            ("s", "excel", 0, ["日期", "金额", "余额"]), ("s", "excel", 1, ["2024-01-02", "-5.00", "1.00"]), ("b", "bocom", 0, ["交易日期", "借贷标志", "交易金额", "余额"]), ("b", "bocom", 1, ["2024-01-02", "D", "-3.00", "1.00"])]
    cells = spark.createDataFrame([(f, b, 1, 0, k, c) for f, b, k, c in rows], "file string, bank_id string, page_no int, table_no int, row_no int, cells array<string>")
    got = {(r.source_file, r.row_no): (str(r.income), str(r.expense), r.neutral, r.issue_codes) for r in parse.cell_ledger(cells, layouts(spark)).collect()}
    assert got == {("w", 1): ("0.00", "0.00", True, []), ("w", 2): ("7.00", "0.00", False, []), ("s", 1): ("0.00", "5.00", False, []), ("b", 1): ("3.00", "0.00", False, [])}


def test_direction_by_balance(spark):
    lines = spark.createDataFrame([("c", "citic", 1, k, t) for k, t in enumerate(["20240101 RMB 10.00 RMB 110.00 a", "20240102 RMB 5.00 RMB 105.00 b", "20240103 RMB 7.00 RMB 112.00 c"])], "file string, bank_id string, page_no int, line_no int, text string")
    got = [(str(r.income), str(r.expense), r.issue_codes) for r in parse.line_ledger(lines, layouts(spark)).orderBy("row_no").collect()]
    assert got == [("10.00", "0.00", []), ("0.00", "5.00", []), ("7.00", "0.00", [])]


def test_every_layout_can_be_read():
    from ledgerline.sources.layouts import rows

    known = {"sign", "separate", "signed", "direction", "flag", "reversal", "wallet", "sheet", "filtered", "balance"}
    for bank, shape, rx, columns, boxes, anchor, heads, mode, words, order, *_ in rows():
        assert mode in known and order in sequence.POLICIES, bank
        assert (rx and columns) if shape == "L" else ((boxes or heads) and anchor) if shape == "P" else shape in ("C", "M"), bank


def test_batch_without_any_input(spark):
    files = spark.createDataFrame([("a", "changsha"), ("b", "nobody"), ("c", None)], "file string, bank_id string")
    rows, seen = reading.read_batch(files, layouts(spark))
    assert rows.count() == 0 and {r.file: r.error for r in seen.collect()} == {"a": "no_rows", "b": "unknown_layout", "c": "unknown_layout"}


def all_trails(rows, previous):
    return [list(p) for p in itertools.permutations(rows) if all(a["balance"] + b["amount"] == b["balance"] for a, b in itertools.pairwise(p))]


@pytest.mark.parametrize("seed", range(30))
def test_trail_exists_iff_found(seed):
    rng = random.Random(seed)
    rows = []
    for _ in range(rng.randrange(1, 6)):
        a, b = rng.randrange(3), rng.randrange(3)
        rows.append({"balance": b, "amount": b - a, "n": len(rows)})
    for previous in (None, 0, 1, 7):
        got, found = sequence.euler_trail(rows, previous), all_trails(rows, previous)
        assert sorted(r["n"] for r in got) == list(range(len(rows)))
        fits = [t for t in found if previous is None or previous not in {r["balance"] - r["amount"] for r in rows} or t[0]["balance"] - t[0]["amount"] == previous]
        assert got in fits if fits else got == rows
    assert sequence.euler_trail([], 1) == [] and sequence.euler_trail([{"balance": None, "amount": 1}], None) == [{"balance": None, "amount": 1}]


def test_policies_of_one_batch(spark):
    rows = [("t", "trail", 1, 115, -5), ("t", "trail", 2, 110, 10), ("t", "trail", 3, 120, 10), ("s", None, 2, 5, 5), ("s", None, 1, 1, 1), ("r", "reverse_all", 1, 7, 2), ("r", "reverse_all", 2, 5, 5), ("x", "no such", 1, None, 1)]
    df = spark.createDataFrame(rows, "account_no string, order_policy string, row_no int, b int, a int")
    ledger = df.selectExpr("account_no", "order_policy", "row_no", "1 AS page_no", "CAST(row_no AS BIGINT) AS ingest_seq", "'f' AS source_file", "TIMESTAMP '2024-01-01' AS transaction_time", "CAST(b AS DECIMAL(18,2)) AS balance", "CAST(greatest(a, 0) AS DECIMAL(18,2)) AS income", "CAST(greatest(-a, 0) AS DECIMAL(18,2)) AS expense")
    got = {}
    for r in sequence.restore_order(ledger).orderBy("account_no", "statement_order").collect():
        got.setdefault(r.account_no, []).append((r.row_no, None if r.previous_balance is None else int(r.previous_balance)))
    assert got == {"t": [(2, None), (3, 110), (1, 120)], "s": [(1, None), (2, 1)], "r": [(2, None), (1, 5)], "x": [(1, None)]}


def test_automaton_and_loop_agree(spark):
    rng = random.Random(4)
    marks = ["".join(rng.choice("ab") for _ in range(rng.randrange(1, 5))) for _ in range(40)]
    rules = [(k, f"r{k}", rng.choice(["header", "top", "body"]), rng.sample(marks, rng.randrange(2)), rng.sample(marks, rng.randrange(1, 4)), "l", 1, "w") for k in range(30)] + [(99, "all", "body", [], [], "l", 1, "w")]
    docs = [(k, *["".join(rng.choice("abc") for _ in range(rng.randrange(12))) for _ in range(3)]) for k in range(200)] + [(300, None, None, None)]
    table = spark.createDataFrame(rules, "ord int, bank_id string, scope string, header_markers array<string>, markers array<string>, label string, confidence int, reason string")
    texts = spark.createDataFrame(docs, "file int, header string, top string, body string")
    one, two = ({r.file: r.bank_id for r in detect.first_match(texts, table, loop_rules=n).filter("file < 300").collect()} for n in (0, 100))
    assert one == two and len(set(one.values())) > 5
    assert detection_rules(spark).groupBy("ord").count().filter("count > 1").isEmpty()


def test_lines_of_files_in_blocks(spark, tmp_path):
    rng = random.Random(6)
    want = []
    for k in range(3):
        pieces = ["".join(rng.choice("ab\f\n ") for _ in range(400)) for _ in range(30)] + (["x"] if k else [])
        data = "".join(pieces) + "end" + "\r\n" * (k == 1) + "tail"
        (tmp_path / f"{k}.txt").write_bytes(data.encode())
        for p, page in enumerate(data.split("\f"), 1):
            want += [(f"{k}.txt", p, n, t.removesuffix("\r")) for n, t in enumerate(page.split("\n"), 1)]
    from ledgerline.sources import io

    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("700b", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = [(r.file.rsplit("/", 1)[1], r.page_no, r.line_no, r.text) for r in io.text_lines(spark, str(tmp_path)).collect()]
            assert sorted(got) == sorted(want)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_one_huge_account_fills_many_tasks(spark):
    from ledgerline.operators import carry

    rows = spark.range(6000).selectExpr("CASE WHEN id % 3 = 0 THEN 'huge' WHEN id % 3 = 1 THEN concat('a', id % 50) END AS account_no", "id AS n", "CASE WHEN id % 7 > 0 THEN id END AS v")
    own = carry.in_sequence(rows, ["account_no"], ["n"], ["v"], partitions=16)
    got = {r.n: (r.posting_seq, r.prev_v) for r in own.collect()}
    seen, last = {}, {}
    for r in rows.orderBy("n").collect():
        seen[r.account_no] = seen.get(r.account_no, 0) + 1
        assert got[r.n] == (seen[r.account_no], last.get(r.account_no))
        last[r.account_no] = r.v
    assert len(got) == 6000 and own.columns == ["account_no", "n", "v", "posting_seq", "prev_v"]
    dealt = rows.repartitionByRange(16, "account_no", "n").withColumn("p", F.spark_partition_id()).groupBy("p").count().agg(F.max("count")).first()[0]
    assert dealt < 1200  # a third of the rows has one account
    assert carry.in_sequence(rows.limit(0), ["account_no"], ["n"], ["v"]).count() == 0


def test_rows_of_several_lines(spark):
    from ledgerline.operators import carry

    texts = [("a", 1, "9.99 before 8.88 any 7.77 row"), ("a", 1, "2024-01-02 wire 5.55"), ("a", 1, None), ("a", 1, "10:20:30 0.00"), ("a", 2, "第2页 3.33"), ("a", 2, " 1,234.56 1.00 use"), ("a", 3, "2024-01-03 2.00 1.00"), ("b", 1, "no row")]
    lines = spark.createDataFrame([(f, "bazhou_shunfeng_corp", p, n, t) for n, (f, p, t) in enumerate(texts)], "file string, bank_id string, page_no int, line_no int, text string")
    for look in (parse.chain.beside, carry.beside):
        (got,) = parse.line_ledger(lines, layouts(spark), look).collect()  # two amounts are no row
        assert (str(got.income), str(got.expense), str(got.balance)) == ("1234.56", "0.00", "1.00")
        assert (str(got.transaction_time), got.page_no, got.row_no) == ("2024-01-02 10:20:30", 1, 1)
        assert got.raw_text == "2024-01-02 wire 5.55 10:20:30 0.00 1,234.56 1.00 use"
    assert parse.line_ledger(lines.limit(0), layouts(spark)).count() == 0


def _huge(spark, n=4000):
    """A third of the rows and more has one account; some balances are missing, some rows are cancelled by the next one."""
    rng, balances, rows = random.Random(8), {}, []
    for k in range(n):
        account = "huge" if k % 2 else None if k % 10 == 0 else f"a{k % 30}"
        last = balances.get(account, 50_000)
        again = k > 2 and k % 2 and rng.random() < 0.3 and rows[-2][1] == account
        amount = -rows[-2][2] if again else rng.choice([1, -1]) * rng.randint(1, 900)
        balances[account] = last + amount
        shown = None if rng.random() < 0.1 else balances[account] * rng.choice([1] * 9 + [10])
        rows.append((k, account, amount, shown))
    df = spark.createDataFrame(rows, "k long, account_no string, amount long, shown long")
    money = lambda c: F.col(c).cast("decimal(18,2)")
    made = df.select("account_no", F.col("k").alias("row_no"), F.col("k").alias("ingest_seq"), F.lit(1).alias("page_no"), F.lit("f").alias("source_file"), F.timestamp_seconds(F.col("k") * 900).alias("transaction_time"), F.greatest(money("amount"), F.lit(0)).cast("decimal(18,2)").alias("income"), F.greatest(-money("amount"), F.lit(0)).cast("decimal(18,2)").alias("expense"), money("shown").alias("balance"), F.col("amount").cast("string").alias("raw_amount"), F.col("shown").cast("string").alias("raw_balance"), F.lit("利息").alias("raw_text"), (F.col("k") % 3 == 0).alias("reliable"))
    return made.withColumns({"posting_seq": F.col("row_no") * 3, "repaired": F.lit(None).cast("string"), "issue_codes": F.array().cast("array<string>"), "balance_optional": F.lit(False), "balance_segment_start": F.lit(False), "balance_tolerance": F.lit(0).cast("decimal(18,2)"), "amount": F.abs(money("raw_amount"))})


@pytest.mark.parametrize("what", ["balance_breaks", "amounts_from_balance", "direction_from_balance", "without_reversal_pairs", "flipped_by_balance", "without_unmoved", "plausible_amounts", "mark_optional_dates", "page_totals"])
def test_repairs_of_huge_accounts_equal_the_windows(spark, what):
    from ledgerline.operators import carry, chain

    rows = _huge(spark).withColumn("total", F.when(F.col("row_no") % 997 == 1, F.col("row_no")))
    more = {"direction_from_balance": ["amount"], "plausible_amounts": ["reliable"], "page_totals": ["total", ["account_no"]], "mark_optional_dates": [["nothing"]]}.get(what, [])
    spread = lambda *a, **k: carry.beside(*a, **k, partitions=16)
    for df in (rows, rows.limit(0)):
        plain, dealt = (getattr(chain, what)(df, *more, look=look) for look in (chain.beside, spread))
        assert plain.columns == dealt.columns
        of = lambda d: sorted(d.collect(), key=lambda r: r.row_no)
        assert of(plain) == of(dealt)


@pytest.mark.parametrize("what", ["supported_balances", "backward_chain", "scale_repair", "pick_balance", "pick_amount_and_balance"])
def test_row_repairs_in_pieces_equal_the_stream(spark, what):
    from ledgerline.operators import sequence

    rows = _huge(spark, 1500)
    keep = ["row_no", "fixed_income", "fixed_expense", "fixed_balance", "fixed_by"]
    for df in (rows, rows.limit(0)):
        plain, dealt = (sorted(getattr(sequence, what)(df, pieces=n).select(*keep).collect()) for n in (None, 12))
        assert plain == dealt and len(plain) == df.count()


def test_pieces_run_again_where_the_state_is_carried(spark):
    """Balances that are missing from the second row on: every piece's true beginning comes from the pieces before it."""
    from ledgerline.operators import sequence

    rows = _huge(spark, 600).withColumn("account_no", F.lit("one")).withColumn("balance", F.when(F.col("row_no") == 0, F.lit(1000)).cast("decimal(18,2)"))
    got = sequence.backward_chain(rows, pieces=6).orderBy("posting_seq").collect()
    total = 1000
    for r in got[1:]:
        total += r.income - r.expense
        assert r.fixed_balance == total and r.fixed_by == "balance_filled"


def test_work_folders_can_be_removed(spark):
    from ledgerline.sources import io

    io.remove_work(spark)
    kept = io.written(spark.range(3), "some")
    assert kept.count() == 3 and io.remove_work(spark) == 1 and io.remove_work(spark) == 0


def test_words_are_not_broadcast(spark, sf):
    from ledgerline.plans import reading

    lines = reading.columns_by_header(spark, sf)._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = lambda line: next((k for k, c in enumerate(line) if c.isalpha()), 0)
    for k, line in enumerate(lines):
        if "BroadcastExchange" in line:
            below = itertools.takewhile(lambda x: depth(x) > depth(line), lines[k + 1 :])
            assert not any("FileScan" in x for x in below)


def test_header_roles_are_told_after_the_shuffle(spark):
    # before it the few splits of a small file would be the only tasks that tell them
    cells = spark.createDataFrame([(k, 1, 0, n, row) for k in range(3) for n, row in enumerate((["交易日期", "收入", "支出"], ["2024-01-01", "1.00", ""]))], "file bigint, page_no int, table_no int, row_no int, cells array<string>")
    got = parse.with_roles(cells, parse.ROLE_WORDS)
    steps = got._jdf.queryExecution().optimizedPlan().toString().split("Window [")  # the last one is done first, right after the shuffle
    assert "交易日期" in "".join(steps[:-1]) and "交易日期" not in steps[-1]
    assert sorted((r.file, r.roles["date"], r.cells[0]) for r in got.collect()) == [(k, 0, "2024-01-01") for k in range(3)]


@pytest.mark.parametrize("name", ["registered_layouts", "registered_blocks", "line_layouts", "printed_figures"])
def test_rows_are_not_sent_to_their_layouts(spark, sf, name):
    # a bank's rows would be read in the one task that holds its layout
    import __spark_entry__

    lines = __spark_entry__.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = lambda line: next((k for k, c in enumerate(line) if c.isalpha()), 0)
    for k, line in enumerate(lines):
        if "BroadcastExchange" in line:
            assert not any("FileScan" in x for x in itertools.takewhile(lambda x: depth(x) > depth(line), lines[k + 1 :]))
    assert not any("SortMergeJoin [bank_id" in x or "SortMergeJoin [_bank" in x for x in lines)


def test_a_cell_rows_time_is_told_once(spark):
    cells = spark.createDataFrame([("f", "icbc", 1, 0, 0, ["交易日期", "交易金额", "余额"])], "file string, bank_id string, page_no int, table_no int, row_no int, cells array<string>")
    plan = parse.cell_ledger(cells, layouts(spark))._jdf.queryExecution().optimizedPlan().toString()
    assert any("Filter" in x and "isnotnull(transaction_time" in x for x in plan.splitlines())  # the condition is on the time, not on what makes it


def test_header_words_do_not_span_cells(spark):
    df = spark.createDataFrame([(1, ["交易", "日期", "余 额", None]), (2, ["余额", "交易日期", "金额"])], "k int, cells array<string>")
    got = {r.k: r.roles for r in df.select("k", parse.roles_of(F.col("cells"), parse.ROLE_WORDS).alias("roles")).collect()}
    assert got == {1: {"date": 1, "balance": 2}, 2: {"date": 1, "amount": 2, "balance": 0}}
