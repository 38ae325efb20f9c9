"""Conversation repair against trying all edits, in whole and in segments, on odd rows, and the query against its SQL."""

import hashlib
import itertools
import os
import random
import re

import duckdb
import pytest

from ledgerline.llm import convrepair as C


def plain(rows):
    """rows [(role, text)] -> (cost, audit, repaired) by trying everything, with at most two insertions in a row."""
    seen, faults = set(), []
    for role, text in rows:
        bare = text.strip(C.BLANKS)
        faults.append("b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    todo = [(0, "", "", ())]
    for (role, text), fault in zip([*rows, (None, None)], [*faults, "end"]):
        found = {}
        for cost, audit, roles, said in todo:
            for put in ("", "u", "a", "ua", "au"):
                base = (cost + 2 * len(put), audit + "I" * len(put), roles + put, said + tuple({"u": "user:", "a": "assistant:"}[c] for c in put))
                edits = [(0, "", "", ())] if fault == "end" else [(3, "D", "", ())]
                if fault in ("", "t"):
                    edits += [(e + (fault == "t"), x, r[0], (f"{r}:{text}",)) for e, x, r in ((0, "K", role), (2, "R", "user"), (2, "R", "assistant")) if r]
                for e in edits:
                    new = tuple(a + b for a, b in zip(base, e))
                    if re.fullmatch(r"(s?(ua)*u?)?", new[2]) and (new[2] not in found or new < found[new[2]]):
                        found[new[2]] = new
        todo = list(found.values())
    return min((c, a, "\n".join(s)) for c, a, r, s in todo if re.fullmatch(r"(s?(ua)+)?", r)), faults


@pytest.mark.parametrize("segment_rows", [1, 3, 1024])
def test_random_conversations(spark, segment_rows):
    rng = random.Random(7)
    convs = {k: [(rng.choice(["user", "assistant", "system", "tool", "u"]), rng.choice(["a.", "b!", "c", " ", "d?\n", "e ."])) for _ in range(rng.randrange(1, 8))] for k in range(60)}
    rows = [(k, t, r, x) for k, v in convs.items() for t, (r, x) in enumerate(v)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(3)
    got = {r.conv_id: r for r in C.repair(df, segment_rows=segment_rows).collect()}
    assert len(got) == len(convs)
    for k, v in convs.items():
        (cost, audit, said), faults = plain(v)
        r = got[k]
        assert (r.cost, r.audit, r.repaired_sha256) == (cost, audit, hashlib.sha256(said.encode()).hexdigest()), v
        assert (r.blank, r.duplicate, r.truncated) == tuple(faults.count(x) for x in "bdt") and r.gaps == 0
        assert r.illegal == sum((a[0][0] + b[0][0]) not in ("su", "ua", "au") for a, b in itertools.pairwise(v))


def test_agenda_breaks_ties_by_letters_after_all_equal_costs():
    for n in range(6):
        for codes in itertools.product([C.USER, C.ASSISTANT, C.SYSTEM, C.OTHER, C.USER | C.FORCED, C.SYSTEM | C.TRUNCATED], repeat=n):
            got = C.lightest(bytes(codes), C.ENDS)[C.START]
            best = {C.START: (0, "")}
            for code in codes:  # forwards, all equal
                puts = {}
                for q, w in best.items():
                    for path in ((q,), *[(q, b) for (a, r), b in C.STEP.items() if a == q and r != C.SYSTEM]):
                        x = (w[0] + 2 * (len(path) - 1), w[1] + "I" * (len(path) - 1))
                        for a, b, c, letter in C._rules(code):
                            if a == path[-1]:
                                y = (x[0] + c, x[1] + letter)
                                puts[b] = min(puts.get(b, y), y)
                best = puts
            assert got == min((c + C.ENDS[q][0], a + C.ENDS[q][1]) for q, (c, a) in best.items())


def test_odd_rows_and_messages(spark):
    rows = [(1, None, "user", "x."), (1, 3, "user", "x."), (1, 3, "user", "x."), (1, 9, "assistant", None), (None, 1, None, "y."), (None, 2, "user", "z" * 300000 + "."), (2, None, "system", "s."), (3, 5, "user", "late")]
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], "conv_id bigint, turn bigint, role string, text string, seq int, key string")
    origin = df.select("conv_id").union(spark.createDataFrame([(77,)], "conv_id bigint"))
    got = {r.conv_id: r for r in C.repair(df, originals=origin).collect()}
    assert set(got) == {None, 1, 2, 3, 77}
    assert got[77].audit == "" and got[77].repaired_sha256 == hashlib.sha256(b"").hexdigest() and got[77].cost == 0
    assert (got[1].gaps, got[1].blank, got[1].duplicate, got[1].audit) == (5, 1, 2, "KDDDI") and got[2].audit == "D" and got[2].gaps == 0
    assert got[None].audit in ("DKI", "RRDI", "RR", "DIK", "RR") and got[None].cost == min(3 + 2, 4)
    said = [(r.conv_id, r.position, r.edit, r.turn, r.role, r.text) for r in C.repair(df, messages=True).filter("conv_id IN (1, 3)").orderBy("conv_id", "position").collect()]
    assert said == [(1, 1, "K", None, "user", "x."), (1, 2, "I", None, "assistant", "")] + ([] if got[3].audit == "D" else said[2:])
    assert C.repair(df.limit(0)).count() == 0 == C.repair(df.limit(0), messages=True).count()


def test_one_long_conversation_fills_many_segments(spark):
    rows = spark.range(6000).selectExpr("1L AS conv_id", "id AS turn", "CASE WHEN id % 7 = 0 THEN 'system' WHEN id % 2 = 0 THEN 'user' ELSE 'assistant' END AS role", "concat('t', id, CASE WHEN id % 5 = 0 THEN '' ELSE '.' END) AS text")
    whole, cut = (C.repair(rows, segment_rows=n).collect() for n in (100000, 64))
    assert whole == cut and len(whole[0].audit) >= 6000


def test_query_equals_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{sf}/conversations.parquet')")
    names = "conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256"
    want = sorted(con.execute(f"SELECT {names} FROM ({C.OP12_SQL})").fetchall())
    assert os.path.exists(f"{sf}/conversations.parquet") and sorted(tuple(r) for r in C.op12_conversation_repair(spark, sf).select(*names.split(", ")).collect()) == want
