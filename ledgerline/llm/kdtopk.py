"""Exact top-k by inner product: a KD-tree in each shard, searched best-first.

Trees are built by median splits of the widest dimension and keep a tight bounding box for each node. The largest inner
product of a query with anything in a box is the sum over dimensions of max(q * low, q * high). A query opens the node
with the best bound next and ends when no bound reaches its k-th score. Each query is first searched in its home shard;
the k-th score found there goes with it to all other shards as the bound to beat.

Bounds are doubles. Scores are doubles, too, for vectors and queries whose products stay below 2^53, where doubles are
exact; the scores of larger ones are exact sums of products of 22-bit limbs, and bounds are widened by what doubles round off.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .vectors import count_blocks, deal, nearest, sides, usable

FOUND = "query_id bigint, vec_id bigint, score bigint"
LOW, NO_ID = np.int64(np.iinfo(np.int64).min), np.int64(np.iinfo(np.int64).max)


class Tree:
    def __init__(self, x: np.ndarray, ids: np.ndarray, leaf: int = 256):
        self.order = np.arange(len(x))
        self.low, self.high, self.child, self.span, self.least = [], [], [], [], []
        stack = [(0, len(x), None)]
        while stack:
            a, b, parent = stack.pop()
            own = self.order[a:b]
            low, high = x[own].min(axis=0), x[own].max(axis=0)
            node = len(self.low)
            self.low.append(low)
            self.high.append(high)
            self.least.append(ids[own].min())
            self.span.append((a, b))
            self.child.append([])
            if parent is not None:
                self.child[parent].append(node)
            wide = high - low
            if b - a > leaf and wide.max(initial=0) > 0:  # equal vectors can't be split, and needn't
                d = int(np.argmax(wide))
                mid = (b - a) // 2
                self.order[a:b] = own[np.argpartition(x[own, d], mid)]
                stack += [(a + mid, b, node), (a, a + mid, node)]
        self.low, self.high, self.least = np.array(self.low), np.array(self.high), np.array(self.least)
        self.x, self.ids = x[self.order], ids[self.order]


def bounds(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Largest inner products of queries with boxes (queries x boxes)."""
    return np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T


def _limbs(v: np.ndarray) -> list[np.ndarray]:
    """Three limbs of integers: v = a + b 2^22 + c 2^44, the last one signed."""
    mask = np.int64((1 << 22) - 1)
    return [(v & mask).astype(np.float64), (v >> 22 & mask).astype(np.float64), (v >> 44).astype(np.float64)]


def exact_scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of 64-bit integers (queries x vectors), exactly; those beyond 64 bits become the nearest 64-bit integer.

    Sums of 512 products of 22-bit limbs stay below 2^53, so doubles hold them; they are carried into digits of 22 bits.
    """
    sums = np.zeros((5, len(q), len(x)), np.int64)
    for d in range(0, q.shape[1], 512):
        for i, a in enumerate(_limbs(q[:, d : d + 512])):
            for j, b in enumerate(_limbs(x[:, d : d + 512])):
                sums[i + j] += (a @ b.T).astype(np.int64)
    digits, carry = [], np.zeros((len(q), len(x)), np.int64)
    for k in range(4):
        carry = carry + sums[k]
        digits.append(carry & ((1 << 22) - 1))
        carry = carry >> 22
    top = carry + sums[4]  # the value is top 2^88 + digits
    upper = np.clip(top, -1, 0) * (1 << 22) + digits[3]  # bits 66 and up, if top is 0 or -1
    fits = (top >= -1) & (top <= 0) & (upper >= -1) & (upper <= 0)
    upper = np.clip(upper, -1, 0) * (1 << 22) + digits[2]  # bits 44 and up
    fits &= (upper >= -(1 << 19)) & (upper < 1 << 19)
    value = (upper << 44) + (digits[1] << 22) + digits[0]
    return np.where(fits, value, np.where(top < 0, LOW, NO_ID))


def search(tree: Tree, query_ids: np.ndarray, q: np.ndarray, floor: np.ndarray, k: int, big: np.ndarray | None = None, whole: np.ndarray | None = None):
    """Best k scores and ids of each query; fewer, or none that reach ``floor``, leave ``NO_ID``.

    big: the queries as 64-bit integers, whole: the tree's vectors likewise, where doubles aren't exact.
    """
    n, exact = len(q), big is None
    scores, ids = np.full((n, k), LOW, np.int64), np.full((n, k), NO_ID)
    # what doubles may round off a bound: conversion, products and sums
    slack = np.zeros(n) if exact else np.abs(q) @ np.maximum(np.abs(tree.low[0]), np.abs(tree.high[0])) * (q.shape[1] + 8) * 2.0**-52
    front = np.full((n, len(tree.low)), -np.inf)
    front[:, 0] = bounds(q, tree.low[:1], tree.high[:1])[:, 0]
    while True:
        node = front.argmax(axis=1)
        best = front[np.arange(n), node]
        kth = np.maximum(scores[:, -1], floor)
        if exact:  # equal scores, but larger ids only
            tie = (best == kth) & (scores[:, -1] == kth) & (tree.least[node] > ids[:, -1]) & (best > -np.inf)
            front[tie, node[tie]] = -np.inf
            open_ = (best >= kth) & ~tie
        else:
            tie = np.zeros(n, bool)
            open_ = best + slack + np.abs(kth.astype(np.float64)) * 2.0**-51 >= kth.astype(np.float64)
        live = np.flatnonzero(open_ & (best > -np.inf))
        if not len(live):
            if tie.any():
                continue
            return scores, ids
        front[live, node[live]] = -np.inf
        live = live[np.argsort(node[live], kind="stable")]
        cuts = np.flatnonzero(np.r_[True, np.diff(node[live]) != 0, True])
        for a, b in zip(cuts, cuts[1:]):
            rows, at = live[a:b], node[live[a]]
            if tree.child[at]:
                front[np.ix_(rows, tree.child[at])] = bounds(q[rows], tree.low[tree.child[at]], tree.high[tree.child[at]])
                continue
            s, e = tree.span[at]
            for m in range(s, e, 4096):  # equal vectors make leaves of any size
                _take(scores, ids, rows, kth, tree.ids[m : min(e, m + 4096)], query_ids, (q[rows] @ tree.x[m : min(e, m + 4096)].T).astype(np.int64) if exact else exact_scores(big[rows], whole[m : min(e, m + 4096)]), k)


def _take(scores, ids, rows, kth, leaf_ids, query_ids, got, k):
    """Merge the scores of a leaf into the best of ``rows``; ``~score`` sorts descending without overflow."""
    fair = (got >= kth[rows][:, None]) & (query_ids[rows][:, None] != leaf_ids[None, :])
    hit = np.flatnonzero(fair.any(axis=1))
    if not len(hit):
        return
    rows, got, fair = rows[hit], got[hit], fair[hit]
    new_i = np.where(fair, np.broadcast_to(leaf_ids, got.shape), NO_ID)
    new_s = np.where(fair, got, LOW)
    if got.shape[1] > 4 * k:  # only columns that can matter to a row: its k best, with all their ties
        cut = np.partition(new_s, new_s.shape[1] - k, axis=1)[:, -k][:, None]
        width = int(((new_s >= cut) & fair).sum(axis=1).max())
        col = np.lexsort((~fair, np.where((new_s >= cut) & fair, ~new_s, NO_ID)), axis=1)[:, : max(width, 1)]
        new_s, new_i = np.take_along_axis(new_s, col, axis=1), np.take_along_axis(new_i, col, axis=1)
    all_s, all_i = np.concatenate((scores[rows], new_s), axis=1), np.concatenate((ids[rows], new_i), axis=1)
    pick = np.lexsort((all_i, ~all_s), axis=1)[:, :k]
    scores[rows], ids[rows] = np.take_along_axis(all_s, pick, axis=1), np.take_along_axis(all_i, pick, axis=1)


def _task(k: int, leaf: int, step: int):
    def task(key, pdf: pd.DataFrame) -> pd.DataFrame:
        both = sides(pdf, np.int64)
        if both is None:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        ids, x, q_ids, q, _, at = both
        floor = pdf["floor"].to_numpy(np.int64)[at]
        # doubles are exact for what stays below 2^53, sums of products included; the rest has a tree of its own
        most = lambda v: np.abs(v.astype(np.float64)).max(axis=1, initial=0)
        room = 2.0**53 / max(1, x.shape[1])
        far_x, far_q = most(x), most(q)
        small_q = far_q <= 2.0**26
        small_x = far_x * max(1.0, far_q[small_q].max(initial=0)) < room
        out = []
        for rows, asks in ((small_x, small_q), (~small_x, small_q), (np.ones(len(x), bool), ~small_q)):
            if not rows.any() or not asks.any():
                continue
            exact = asks is small_q and rows is small_x
            tree = Tree(x[rows].astype(np.float64), ids[rows], leaf)
            whole = None if exact else x[rows][tree.order]
            own, qs, fl = q_ids[asks], q[asks], floor[asks]
            for s in range(0, len(qs), step):
                part = qs[s : s + step]
                scores, found = search(tree, own[s : s + step], part.astype(np.float64), fl[s : s + step], k, None if exact else part, whole)
                r, c = np.nonzero(found != NO_ID)
                out.append(pd.DataFrame({"query_id": own[s : s + step][r], "vec_id": found[r, c], "score": scores[r, c]}))
        return pd.concat(out)

    return task


def search_rows(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "vector", shard_rows: int = 65536, shard_bytes: int = 64 << 20, leaf: int = 256, step: int = 1024) -> DataFrame:
    """The k largest inner products with rows of ``vectors`` for each row of ``queries``: query_id, rank, vec_id, score.

    Vectors are arrays of 64-bit integers. Null ids and null vectors or components take no part; vectors meet those of
    their own length; all rows that repeat an id are candidates, of queries that repeat an id the first vector in order
    of components counts; a query's own id is left out; ties go to the smaller id; fewer than k candidates give fewer rows;
    scores beyond 64 bits become the nearest 64-bit integer; other columns don't matter; empty tables give no rows.
    """

    def valid(df):
        return df.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast("array<bigint>").alias("vector")).filter(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & F.forall("vector", lambda c: c.isNotNull()))

    rows, asked = valid(vectors), valid(queries)
    shards, parts = count_blocks(rows, asked, shard_rows, shard_bytes)
    task = _task(k, leaf, step)
    dealt = lambda asked: deal(rows, asked, shards, parts, {"floor": "bigint"}).withColumn("floor", F.coalesce("floor", F.lit(int(LOW))))  # noqa: E731  no nulls: they would make doubles of it
    home = F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int")
    at_home = ~F.col("is_query") | (F.col("block") == home)
    first = materialise(dealt(asked).filter(at_home).groupBy("dim", "block", "part").applyInPandas(task, FOUND), "topk-home")
    if shards == 1:
        return nearest(first, k)
    # the k-th score at home; queries with fewer have no bound yet
    kth = first.groupBy("query_id").agg(F.min("score").alias("floor"), F.count("*").alias("n")).filter(F.col("n") >= k).select(F.col("query_id").alias("vec_id"), "floor")
    bounded = asked.join(kth, "vec_id", "left")
    rest = dealt(bounded).filter(~F.col("is_query") | (F.col("block") != home))
    return nearest(first.unionByName(rest.groupBy("dim", "block", "part").applyInPandas(task, FOUND)), k)


def op4_kd_topk(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").filter(usable(F.col("embedding")))
    ints = rows.select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * 64)).alias("vector"))
    return search_rows(ints, ints.filter(F.col("vec_id") % 20 == 0))


OP4_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM (SELECT vec_id, min(v) AS v FROM v WHERE vec_id % 20 = 0 GROUP BY vec_id, len(v)) q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
