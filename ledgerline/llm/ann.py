"""Approximate nearest neighbours by randomly rotated one-bit codes.

Unit vectors are rotated by a random orthogonal matrix and coded by the signs of their components, packed to bits. With
the scalar f = <vector, code> the inner product of a query and a vector is estimated as <query, code> / f; its error
stays, with high probability, within ``eps`` * sqrt((1 - f^2) / f^2) / sqrt(dim - 1). The query's components are
rounded to ``QUERY_BITS`` bits, laid out as bit planes, so that <query, code> is a sum of population counts of packed
words; what rounding can add to the error is part of the bound. Vectors whose upper bound reaches the k-th best exact
cosine found so far are reranked by their exact cosine.

Codes and scalars are made once, before vectors are dealt to blocks, and go with them. The vectors go along, too: a query set
that is a share of all rows reranks more vectors in total than there are, so fetching them by a join would move more.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vectors import count_blocks, deal, nearest, sides, usable

QUERY_BITS = 8
FOUND = "query_id bigint, vec_id bigint, score double"


@lru_cache(maxsize=4)
def rotation(dim: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def encode(unit: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed sign bits and the correction scalars <vector, code> of unit vectors."""
    z = unit @ turn.T
    return np.packbits(z > 0, axis=1), np.abs(z).sum(axis=1) / np.sqrt(unit.shape[1])


def _words(packed: np.ndarray) -> np.ndarray:
    """Packed bytes (last axis) as 64-bit words."""
    out = np.zeros((*packed.shape[:-1], -(-packed.shape[-1] // 8) * 8), np.uint8)
    out[..., : packed.shape[-1]] = packed
    return out.view("<u8")


def grid(rotated: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least value and step of each query's ``QUERY_BITS`` levels."""
    low = rotated.min(axis=1)
    return low, np.maximum(rotated.max(axis=1) - low, 1e-300) / ((1 << QUERY_BITS) - 1)


def estimate(codes: np.ndarray, f: np.ndarray, rotated: np.ndarray, block: int = 8192) -> np.ndarray:
    """Estimated inner products (queries x vectors) from packed bits: population counts of the query's bit planes with the codes."""
    dim, (low, step) = rotated.shape[1], grid(rotated)
    level = np.rint((rotated - low[:, None]) / step[:, None]).astype(np.uint32)
    planes = _words(np.packbits(np.stack([level >> p & 1 for p in range(QUERY_BITS)]).astype(bool), axis=2))
    whole = low * dim + step * level.sum(axis=1)  # sum of the rounded query's components
    out = np.empty((len(rotated), len(codes)), np.float32)
    for k in range(0, len(codes), block):
        some = _words(codes[k : k + block])
        ones = np.bitwise_count(some).sum(axis=1, dtype=np.int64)
        dots = np.zeros((len(rotated), len(some)), np.int64)
        for p in range(QUERY_BITS):
            for w in range(some.shape[1]):
                dots += np.bitwise_count(planes[p, :, w, None] & some[None, :, w]).astype(np.int64) << p
        inner = 2 * (low[:, None] * ones + step[:, None] * dots) - whole[:, None]  # set bits count plus, others minus
        out[:, k : k + block] = inner / np.sqrt(dim) / f[k : k + block]
    return out


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact cosines of rows, in double precision; each row is summed on its own, so equal rows get equal values."""
    dot = lambda x, y: np.einsum("ij,ij->i", x, y)
    return dot(a, b) / (np.sqrt(dot(a, a)) * np.sqrt(dot(b, b)))


def search(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, codes: np.ndarray, f: np.ndarray, k: int, eps: float = 1.9, seed: int = 7, cells: int = 1 << 22):
    """(query_id, vec_id, score) arrays: up to k nearest rows of ``x`` (by ascending id) for each query, those of its own id left out."""
    dim = x.shape[1]
    turn = rotation(dim, seed)
    err = eps * np.sqrt(np.maximum(1 - f * f, 0)) / f / np.sqrt(max(1, dim - 1))
    out, step = [], max(1, cells // max(1, len(ids)))  # so many estimates at a time
    sx = scaled(x)
    for s in range(0, len(q), step):
        qs, own = q[s : s + step], query_ids[s : s + step]
        rotated = unit(qs) @ turn.T
        est, rounding = estimate(codes, f, rotated), grid(rotated)[1] / 2 * np.sqrt(dim)
        start, end = np.searchsorted(ids, own, "left"), np.searchsorted(ids, own, "right")
        mine = np.repeat(np.arange(len(qs)), end - start)
        est[mine, np.concatenate([np.arange(a, b) for a, b in zip(start, end)] or [mine])] = -np.inf
        first = min(len(ids), 4 * k)
        seeds = np.argpartition(-est, first - 1, axis=1)[:, :first]
        rows = np.repeat(np.arange(len(qs)), first)
        sq = scaled(qs)
        exact = cosines(sq[rows], sx[seeds.ravel()]).reshape(-1, first)
        exact[np.isinf(np.take_along_axis(est, seeds, axis=1))] = -np.inf
        floor = np.sort(exact, axis=1)[:, -k] if first >= k else np.full(len(qs), -np.inf)
        r, c = np.nonzero(est + (err[None, :] + rounding[:, None] / f).astype(np.float32) >= (floor - 1e-6)[:, None])
        keep = np.isfinite(est[r, c])
        r = np.concatenate((r[keep], rows))
        c = np.concatenate((c[keep], seeds.ravel()))
        pair = np.unique(r.astype(np.int64) * len(ids) + c)
        r, c = pair // len(ids), pair % len(ids)
        keep = own[r] != ids[c]
        r, c = r[keep], c[keep]
        score = np.concatenate([cosines(sq[r[j : j + 65536]], sx[c[j : j + 65536]]) for j in range(0, len(r), 65536)] or [np.empty(0)])
        order = np.lexsort((ids[c], -score, r))
        r, c, score = r[order], c[order], score[order]
        start = np.searchsorted(r, r)
        top = np.arange(len(r)) - start < k
        out.append((own[r[top]], ids[c[top]], score[top]))
    return [np.concatenate(p) for p in zip(*out)] if out else [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]


def unit(v: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled by the largest component first, as squares of huge or tiny components would overflow or vanish."""
    s = v / np.abs(v).max(axis=1, keepdims=True)
    return s / np.sqrt((s * s).sum(axis=1, keepdims=True))


def scaled(v: np.ndarray) -> np.ndarray:
    """The vectors themselves, or powers of two of them where squares would leave the range of doubles."""
    big = np.abs(v).max(axis=1, keepdims=True)
    if big.max(initial=0) < 1e120 and big.min(initial=1) > 1e-120:
        return v
    return v / np.exp2(np.floor(np.log2(big)))


def with_codes(rows: DataFrame, seed: int = 7) -> DataFrame:
    """rows(vec_id, vector) with ``code`` (packed bits) and ``f`` (the correction scalar)."""

    @F.pandas_udf("code binary, f double")
    def coded(vector: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame({"code": pd.Series([b""] * len(vector), dtype=object), "f": np.zeros(len(vector))})
        dims = np.array([len(v) for v in vector])
        for dim in np.unique(dims):
            at = np.flatnonzero(dims == dim)
            codes, f = encode(unit(np.stack([vector.iloc[k] for k in at]).astype(np.float64)), rotation(int(dim), seed))
            out.loc[at, "f"] = f
            for k, c in zip(at, codes):
                out.at[k, "code"] = c.tobytes()
        return out

    return rows.select("vec_id", "vector", coded("vector").alias("c")).select("vec_id", "vector", "c.*")


def search_rows(vectors: DataFrame, queries: DataFrame, k: int = 5, eps: float = 1.9, id_col: str = "vec_id", vector_col: str = "embedding", block_rows: int = 65536, block_bytes: int = 64 << 20) -> DataFrame:
    """The k nearest rows of ``vectors`` by cosine for each row of ``queries``: query_id, rank, vec_id, score.

    Null ids and vectors that are null, zero, or hold null or non-finite components take no part; vectors meet those of
    their own length; all rows that repeat an id are candidates, of queries that repeat an id the first vector in order of
    components counts. A query's own id is never its neighbour. Ties go to the smaller id. Vectors of any length are read
    whole. Other columns don't matter; empty tables give no rows.
    """

    def valid(df):
        v = df.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
        return v.filter(F.col("vec_id").isNotNull() & usable(F.col("vector")) & F.exists("vector", lambda x: x != 0))

    rows, asked = valid(vectors), valid(queries)

    def task(key, pdf: pd.DataFrame) -> pd.DataFrame:
        both = sides(pdf, np.float64)
        if both is None:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        ids, x, q_ids, q, at, _ = both
        codes = np.frombuffer(b"".join(pdf["code"].iloc[at]), np.uint8).reshape(len(ids), -1)
        found = search(ids, x, q_ids, q, codes, pdf["f"].to_numpy(np.float64)[at], k, eps)
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), found)))

    blocks, parts = count_blocks(rows, asked, block_rows, block_bytes)
    dealt = deal(with_codes(rows), asked, blocks, parts, {"code": "binary", "f": "double"})
    return nearest(dealt.groupBy("dim", "block", "part").applyInPandas(task, FOUND), k)


def op3_one_bit_ann(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return search_rows(rows, rows.filter(F.col("vec_id") % 50 == 0))
