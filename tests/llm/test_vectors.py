import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.llm import ann, kdtopk


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, "clash") for i, v in rows], "vec_id bigint, embedding array<float>, label int, score string")


def brute_cosine(rows, mod, k):
    rows = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all() and any(v)]
    out = {}
    for i, q in rows:
        if i % mod == 0:
            best = sorted((-float(q @ v / np.sqrt(q @ q) / np.sqrt(v @ v)), j) for j, v in rows if j != i and len(v) == len(q))
            out[i] = [(j, -s) for s, j in best[:k]]
    return out


def test_ann_recall_and_scores(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want = brute_cosine(rows, 50, 5)
    got = {}
    for r in ann.op3_one_bit_ann(spark, sf).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert got.keys() == want.keys()
    hits = 0
    for i, found in got.items():
        assert [x[0] for x in sorted(found)] == list(range(1, len(want[i]) + 1))
        hits += len({j for _, j, _ in found} & {j for j, _ in want[i]})
    assert hits >= 0.9 * sum(map(len, want.values()))


def test_estimates_stay_in_their_bounds():
    rng = np.random.default_rng(5)
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    x, q = unit(rng.standard_normal((3000, 100))), unit(rng.standard_normal((20, 100)))
    turn = ann.rotation(100, 7)
    codes, f = ann.encode(x, turn)
    assert codes.shape == (3000, 13)
    far = np.abs(ann.estimate(codes, f, q @ turn.T) - q @ x.T)
    assert (far <= 1.9 * np.sqrt((1 - f * f) / f**2) / np.sqrt(99)).mean() > 0.9


@pytest.mark.parametrize("block_rows", [7, 8192])
def test_ann_edges(spark, block_rows):
    rng = np.random.default_rng(3)
    rows = [(i, rng.standard_normal(6).tolist()) for i in range(40)] + [(50, None), (100, [0.0] * 6), (150, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (200, [float("nan")] * 6), (250, [float("inf")] + [0.0] * 5), (None, [1.0] * 6), (300, [1.0, 2.0]), (301, [2.0, 4.0]), (302, [2.0, 4.0]), (350, [3e38] * 6), (400, [1e-40] * 6), (450, [2.0]), (451, [5.0])]
    df = table(spark, rows + rows[:5])
    got = {}
    for r in ann.search_rows(df, df.filter("vec_id % 50 = 0"), block_rows=block_rows).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, round(r.score, 6)))
    want = brute_cosine([(i, None if v is None else [None if c is None else float(np.float32(c)) for c in v]) for i, v in rows + rows[:5]], 50, 5)
    assert {i: [(k, j, s) for k, j, s in sorted(v)] for i, v in got.items()} == {i: [(k + 1, j, round(s, 6)) for k, (j, s) in enumerate(v)] for i, v in want.items() if v}
    assert ann.search_rows(df.limit(0), df).count() == 0 == ann.search_rows(df, df.limit(0)).count()


def brute_inner(rows, mod, k):
    rows = [(i, v) for i, v in rows if i is not None and v is not None and None not in v]
    return {i: [(n + 1, j, -s) for n, (s, j) in enumerate(sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in rows if j != i and len(v) == len(q))[:k])] for i, q in rows if i % mod == 0}


@pytest.mark.parametrize("shard_rows,leaf,step", [(8192, 4, 3), (40, 8, 1024)])
def test_top_k_is_exact_with_ties(spark, shard_rows, leaf, step):
    rng = np.random.default_rng(9)
    rows = [(i, rng.integers(-3, 4, 5).tolist()) for i in range(300)] + [(i, [2, 2, 2, 2, 2]) for i in range(300, 380)]
    rows += [(400, None), (420, [1, None, 1, 1, 1]), (None, [9] * 5), (440, [1, 2]), (441, [3, 4]), (460, [7])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows + rows[:30]], "vec_id bigint, vector array<bigint>, score int")
    got = {}
    for r in kdtopk.search_rows(df, df.filter("vec_id % 20 = 0"), shard_rows=shard_rows, leaf=leaf, step=step).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert {i: sorted(v) for i, v in got.items()} == {i: v for i, v in brute_inner(rows + rows[:30], 20, 20).items() if v}  # every row is a candidate, also one that repeats


def test_huge_components(spark):
    rows = [(0, [2**40, 1]), (1, [2**40, 3]), (2, [2**62, 2]), (3, [-(2**40), 5])]
    df = spark.createDataFrame(rows, "vec_id bigint, vector array<bigint>")
    got = [(r.rank, r.vec_id, r.score) for r in kdtopk.search_rows(df, df.filter("vec_id = 0")).orderBy("rank").collect()]
    assert got == [(1, 1, 2**63 - 1), (2, 2, 2**63 - 1), (3, 3, -(2**63))]  # both first scores are beyond 64 bits and tie
    assert kdtopk.search_rows(df.limit(0), df).count() == 0


def test_op4_takes_no_invalid_vectors(spark, tmp_path):
    table(spark, [(0, [1.0, 0.5]), (20, [0.0, float("nan")]), (1, [-0.01, 1.0]), (2, None), (3, [None, 1.0])]).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = [tuple(r) for r in kdtopk.op4_kd_topk(spark, str(tmp_path)).select("query_id", "rank", "vec_id", "score").collect()]
    assert got == [(0, 1, 1, 64 * -1 + 32 * 64)]


def test_all_rows_of_an_id_are_candidates(spark, tmp_path):
    rows = [(0, [1.0, 1.0]), (1, [1.0, 0.5]), (1, [3.0, 0.5]), (2, [1.0, 1.0]), (20, [0.5, 1.0]), (20, [0.25, 1.0]), (50, [1.0, 2.0])]
    table(spark, rows + rows[:1]).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in kdtopk.op4_kd_topk(spark, str(tmp_path)).collect()]
    assert sorted(x for x in got if x[0] == 0)[0] == (0, 1, 1, 64 * 192 + 64 * 32) and [x[2] for x in got if x[0] == 0].count(1) == 2
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    assert sorted(got) == sorted(con.sql(kdtopk.OP4_SQL).fetchall())
    found = [(r.rank, r.vec_id, round(r.score, 3)) for r in ann.search_rows(table(spark, rows), table(spark, rows[:1]), k=6).collect()]
    assert sorted(found)[0] == (1, 2, 1.0) and {(1, 0.949), (1, 0.814)} <= {x[1:] for x in found}


def test_exact_scores_of_large_integers():
    rng = np.random.default_rng(4)
    for top in (1 << 20, 1 << 40, 1 << 62):
        q, x = rng.integers(-top, top, (5, 600)), rng.integers(-top, top, (7, 600))
        q[0], x[0] = 0, -(2**63)
        q[1], x[1] = 2**63 - 1, 2**63 - 1
        want = [[max(-(2**63), min(2**63 - 1, sum(int(a) * int(b) for a, b in zip(v, w)))) for w in x] for v in q]
        assert kdtopk.exact_scores(q, x).tolist() == want
    assert kdtopk.exact_scores(np.array([[1, -1, 2**31]]), np.array([[-(2**63), 0, 0], [5, 7, 2**32], [2**62, 0, 2**31 - 1]])).tolist() == [[-(2**63), 2**63 - 2, 2**63 - 2**31]]


def test_one_large_component_keeps_the_tree(spark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.integers(-500, 500, 16).tolist()) for i in range(20_000)]
    rows[40][1][3] = rows[77][1][0] = 10**14
    df = spark.createDataFrame(rows, "vec_id bigint, vector array<bigint>").repartition(4)
    got = {}
    for r in kdtopk.search_rows(df, df.filter("vec_id % 400 = 40")).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    x = np.array([v for _, v in rows], dtype=object)
    for i, found in got.items():
        score = (x * x[i]).sum(axis=1)
        want = sorted((-int(s), j) for j, s in enumerate(score) if j != i)[:20]
        assert sorted(found) == [(n + 1, j, -s) for n, (s, j) in enumerate(want)]
    assert len(got) == 50
