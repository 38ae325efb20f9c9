import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.llm import lm


def tokens(text):
    low = (text or "").encode().lower().split()
    return [*low, b""]


def expected(rows, weights):
    """rows: (id, text, role); weights as learned -> id -> (n, known, N, base, score), by plain counting."""
    train = [tokens(t) for _, t, r in rows if r != lm.TEST]
    uni = Counter(w for d in train for w in d)
    pairs = Counter(p for d in train for p in zip([b"", *d], d))
    n, v = sum(uni.values()), len(uni)
    out = {}
    for i, t, _ in rows:
        d = tokens(t)
        base = sum(math.log10((uni[w] + 1) / (n + v + 1)) for w in d)
        score = 0.0
        for u, w in zip([b"", *d], d):
            l2, l1, l0 = weights[min(uni[u].bit_length(), lm.BUCKETS - 1)]
            score += math.log10((l2 * pairs[u, w] / uni[u] if uni[u] else 0) + l1 * uni[w] / max(n, 1) + l0 / (v + 1))
        out[i] = (len(d), sum(uni[w] > 0 for w in d), n, base, score)
    return out


@pytest.mark.parametrize("shard_bytes", [3000, 32 << 20])
def test_query_equals_plain_counting(spark, sf, monkeypatch, shard_bytes):
    seen = {}
    learn = lm.em_weights
    monkeypatch.setattr(lm, "em_weights", lambda *a: seen.setdefault("w", learn(*a)))
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    role = F.crc32(F.col("doc_id").cast("string")) % 7
    got = lm.score_documents(docs, role == 2, role == 3, shard_bytes=shard_bytes).collect()
    rows = [(r.doc_id, r.text, {2: lm.TEST, 3: lm.DELETED}.get(zlib.crc32(str(r.doc_id).encode()) % 7, lm.KEPT)) for r in docs.collect()]
    want = expected(rows, seen["w"])
    assert len(got) == len(rows)
    for r in got:
        n, known, total, base, score = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score == pytest.approx(score, rel=1e-9)
    held = [r for r in got if r.held_out]
    assert held and sum(r.score for r in held) > sum(r.base_score for r in held)
    assert np.allclose(seen["w"].sum(axis=1), 1)


def test_weights_against_unbinned_em():
    rng = np.random.default_rng(1)
    p2, p1 = rng.choice([0, 0.1, 0.01], 4000), 10 ** -rng.uniform(1, 6, 4000)
    import pandas as pd

    cells = pd.DataFrame({"bucket": 3, "bin2": lm._bins(p2), "bin1": lm._bins(p1), "n": 1, "sum2": p2, "sum1": p1}).groupby(["bucket", "bin2", "bin1"], as_index=False).sum()
    got = lm.em_weights(cells, 1e-6)[3]
    p, w = np.stack([p2, p1, np.full(4000, 1e-6)], axis=1), np.full(3, 1 / 3)
    for _ in range(60):
        share = p * w
        w = (share / share.sum(axis=1, keepdims=True)).mean(axis=0)
    assert np.allclose(got, w, atol=0.01)


def test_nulls_repeats_and_empty(spark):
    rows = [(1, "A a", False), (1, "A a", False), (2, None, False), (3, "", True), (None, "b a", True), (None, None, None)]
    docs = spark.createDataFrame([(i, t, h, 0) for i, t, h in rows], "doc_id bigint, text string, h boolean, score int")
    got = lm.score_documents(docs, F.col("h"), F.lit(False)).collect()
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known) for r in got) == sorted([("1", False, 3, 3), ("1", False, 3, 3), ("2", False, 1, 1), ("3", True, 1, 1), ("None", True, 3, 2), ("None", False, 1, 1)])
    assert {r.train_tokens for r in got} == {8}
    assert lm.score_documents(docs.limit(0), F.col("h"), F.lit(False)).count() == 0
    untrained = lm.score_documents(docs, F.lit(True), F.lit(False)).collect()
    assert {r.train_tokens for r in untrained} == {0} and all(math.isfinite(r.score) for r in untrained)
