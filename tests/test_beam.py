"""The beam on arrays against the plain rule, path by path."""

import time
from collections import defaultdict
from random import Random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerline.functions import money
from ledgerline.operators import beam, sequence

SCHEMA = "account_no string, ingest_seq bigint, raw_amount string, raw_balance string"


def options(row, previous):
    """(cost, amount, balance) of a row after a balance, cheapest first."""
    amounts, balances, raw = row["amounts"], row["balances"], row["raw"]
    show = lambda c: str(abs(c)).rjust(3, "0")
    digits = [c for c in raw if c in "0123456789"]
    if not amounts or not balances:
        return [(50_000_000, (amounts or [None])[0], (balances or [None])[0])]
    pairs = lambda n, m: [(10 * i + j, a, b) for i, a in enumerate(amounts[:n]) for j, b in enumerate(balances[:m])]
    if previous is None:
        return sorted(pairs(4, 8), key=lambda x: x[0])[:20]
    found = []
    for i, a in enumerate(amounts[:40]):
        want = previous + a
        if want in balances:
            found.append((10 * i + balances.index(want), a, want))
        elif ends := [j for j, b in enumerate(balances) if show(want).endswith(show(b)) and show(want) != show(b)]:
            found.append((10 * i + ends[0] + 500, a, want))
    for j, b in enumerate(balances[:40]):
        change, rest = b - previous, iter(digits)
        if change and change not in amounts[:40] and ("-" if change < 0 else "+") in raw and all(c in rest for c in show(change)):
            found.append((1000 + 10 * j, change, b))
    if found:
        return sorted(found, key=lambda x: x[0])[:25]
    return sorted(((10_000_000 + min(100 * abs(previous + a - b), 10_000_000) + c, a, b) for c, a, b in pairs(12, 20)), key=lambda x: x[0])[:10]


def plain(rows):
    """Output of a statement's rows: the first of the forty cheapest paths."""
    paths = [(0, None, ())]
    for row in rows:
        grown = [(cost + c, b, (path, a, b)) for cost, before, path in paths for c, a, b in options(row, before)]
        paths = sorted(grown, key=lambda x: x[0])[:40]
    taken, path, sure = [], paths[0][2], None
    while path:
        path, a, b = path
        taken.append((a, b))
    out = []
    for row, (a, b) in zip(rows, reversed(taken)):
        issue = "amount_unreadable" if a is None else "balance_unreadable" if b is None else "balance_break" if sure is not None and sure + a != b else None
        sure = sure if b is None else b
        out.append((row["account_no"], row["ingest_seq"], a, b, issue))
    return out


def candidates(rng, value):
    """Readings of a figure with a digit in front, somewhat as money's."""
    text = str(abs(value)).rjust(3, "0")
    noisy = rng.choice(["", "", "9", "70"]) + text
    found = [noisy[k:] for k in range(len(noisy) - 2)] + [noisy[:k] + noisy[k + 1 :] for k in range(len(noisy) - 2)]
    rng.random() < 0.15 and found.remove(text)
    return list(dict.fromkeys(int(x) for x in found if x)), noisy


def statement(rng, account, n, odd=0.1):
    rows, balance = [], rng.choice([0, 250, 400_000, 5_000_000])
    for k in range(n):
        amount = rng.choice([-1, 1]) * rng.choice([1, 45, 999, 10_004, 123_456, 5_000_000])
        balance = abs(balance + amount)
        (amounts, raw), (balances, _) = candidates(rng, amount), candidates(rng, balance)
        sign = "-" if amount < 0 else rng.choice("+ ")
        row = {"account_no": account, "ingest_seq": k, "amounts": [-a if amount < 0 else a for a in amounts], "balances": balances, "raw": f"{sign}{raw[:-2]}.{raw[-2:]}"}
        if rng.random() < odd:
            row |= rng.choice([{"amounts": []}, {"balances": []}, {"amounts": [], "balances": []}, {"raw": ""}, {"raw": "+-１2é0"}, {"balances": [10**18 - 1, 3]}, {"amounts": [0]}])
        rows.append(row)
    return rows


@pytest.mark.parametrize("at_once", [1, 7, 64, 4096])
def test_every_path_and_tie_is_as_in_the_plain_rule(monkeypatch, at_once):
    monkeypatch.setattr(beam, "AT_ONCE", at_once)
    monkeypatch.setattr(beam, "CELLS", 500)
    rng = Random(7)
    statements = [statement(rng, f"{k:03d}", n) for k, n in enumerate([1, 2, 30, 1, 300, 9, 9, 9, 90, 1])] + [statement(rng, None, 40)]
    rows = [r for x in statements for r in x]
    schema = pa.schema([("account_no", pa.string()), ("ingest_seq", pa.int64()), ("amounts", pa.list_(pa.int64())), ("balances", pa.list_(pa.int64())), ("raw", pa.string())])
    got = [tuple(r.values()) for out in beam.read(iter(pa.Table.from_pylist(rows, schema).to_batches(50)), ["account_no"], 40) for r in out.to_pylist()]
    want = [r for x in statements for r in plain(x)]
    assert got == want
    assert {r[4] for r in want} == {None, "amount_unreadable", "balance_unreadable", "balance_break"}


def test_a_row_costs_less_than_a_sixth_of_what_it_costs_path_by_path(spark):
    # 1 GB of the tables has 6,000,000 such rows: path by path they take hours of a core
    rng, rows = Random(3), []
    for account in range(600):
        balance = 400_000_000
        for k in range(20):
            amount = rng.choice([-1, 1]) * rng.randrange(100_000, 40_000_000)
            balance += amount
            noise = k and rng.random() < 0.25
            rows.append((str(account), k, f"{'+' if amount > 0 else '-'}{'9' * bool(noise)}{abs(amount) / 100:,.2f}", f"{'7' * bool(k and rng.random() < 0.2)}{balance / 100:,.2f}"))
    df = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    cents = lambda c: [int(v * 100) for v in c]
    some = df.filter("account_no < 20").select("account_no", "ingest_seq", sequence.amount_candidates(df.raw_amount).alias("a"), sequence.balance_candidates(df.raw_balance).alias("b"), "raw_amount").collect()
    alone = defaultdict(list)
    for r in sorted(some, key=lambda r: (r[0], r[1])):
        alone[r[0]].append({"account_no": r[0], "ingest_seq": r[1], "amounts": cents(r[2]), "balances": cents(r[3]), "raw": r[4]})
    began = time.time()
    want = {x[:2]: x[2:] for r in alone.values() for x in plain(r)}
    each = (time.time() - began) / len(want)
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        sequence.beam_readings(df.limit(40), ["account_no"], ["ingest_seq"]).collect()  # starts what has to start
        began = time.time()
        got = sequence.beam_readings(df, ["account_no"], ["ingest_seq"]).collect()
        took = time.time() - began
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
    assert len(got) == len(rows)
    assert {k: v for k, v in ((tuple(r[:2]), (int(r.amount * 100), int(r.balance * 100), r.issue)) for r in got) if k in want} == want
    assert took / len(rows) < each / 6, (took, each)


def test_readings_are_counted_in_cents(spark):
    # as many as from texts: endings, then one or two digits dropped, each value once; of 17 digits and more endings that fit alone
    balances = ["7\n1,234.56", "5.00", "12.30", "0.07", "100,200.00", "987654321.10", "1234567890.12", "1111111111111111.99", "x"]
    amounts = ["-9123.45", "+5.00", "+12.30", "-0.07", "-123456.78", "+1,2345.00", "-1111111111111111.99", "3.00", "x"]
    drop = lambda w: [w[:k] + w[k + 1 :] for k in range(len(w))]

    def texts(cell, most, twice):
        whole, after = "".join(c for c in cell if c in "0123456789.").split(".")
        found = [whole[k:] for k in range(len(whole))]
        if len(whole) <= most:
            found += drop(whole) + [whole[:i] + whole[i + 1 : j] + whole[j + 1 :] for i in range(len(whole)) for j in range(i + 1, len(whole)) if twice]
        return list(dict.fromkeys(int(w + after) for w in found if w))

    df = spark.createDataFrame(list(zip(amounts, balances)), "a string, b string")
    got = df.select(money.amount_cents(df.a).alias("a"), money.balance_cents(df.b).alias("b"), money.amount_candidates(df.a).alias("x"), money.balance_candidates(df.b).alias("y")).collect()
    assert [r.b for r in got] == [*(texts(c, 9, True) for c in balances[:-1]), []]
    signed = [[v * (-1 if c[0] == "-" else 1) for v in texts(c, 5, False) if v] for c in amounts[:-1]]
    signed[5] = [(v * 100) for v in (1345, 1245, 1235, 1234)]  # the group of thousands first
    assert [r.a for r in got][:5] + [r.a for r in got][6:] == signed[:5] + signed[6:7] + [[300], []]
    assert set(signed[5]) <= set(got[5].a[:4]) and got[5].a[4:] == [v for v in texts("12345.00", 5, False) if v not in got[5].a[:4]]
    assert [[int(v * 100) for v in r.x] for r in got] == [r.a for r in got] and [[int(v * 100) for v in r.y] for r in got] == [r.b for r in got]
    with_ansi = spark.conf.get("spark.sql.ansi.enabled")
    try:
        spark.conf.set("spark.sql.ansi.enabled", "false")
        long = spark.createDataFrame([("-" + "9" * 20 + ".25",)], "t string").select(money.amount_cents(F.col("t")).alias("a"), money.balance_cents(F.col("t")).alias("b")).first()
    finally:
        spark.conf.set("spark.sql.ansi.enabled", with_ansi)
    assert long.b == [int("9" * n + "25") for n in range(16, 0, -1)] and long.a == [-v for v in long.b]
