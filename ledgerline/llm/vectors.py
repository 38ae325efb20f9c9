"""What both vector searches share: valid vectors, dealing vectors and queries to blocks, and merging nearest lists."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """True for vectors without null and non-finite components."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def count_blocks(vectors: DataFrame, queries: DataFrame, block_rows: int, block_bytes: int, least_rows: int = 2048) -> tuple[int, int]:
    """(blocks of vectors, parts of queries): none over ``block_rows`` rows or some ``block_bytes`` of doubles, and one block a shuffle partition as long as blocks hold ``least_rows``."""
    n, wide = vectors.agg(F.count("*"), F.max(F.size("vector"))).first()
    asked = queries.count()
    rows = max(1, min(block_rows, block_bytes // (8 * max(wide or 1, 1))))
    partitions = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, -(-n // rows), min(partitions, n // least_rows)), max(1, -(-asked // rows))


def deal(vectors: DataFrame, queries: DataFrame, blocks: int, parts: int, extra: dict[str, str]) -> DataFrame:
    """Rows for each pair of a block of vectors and a part of the queries, with ``is_query``, ``dim``, ``block``, ``part``.

    Blocks are dealt by a hash of id and vector, so their sizes are even whatever ids and vectors repeat; every vector
    goes to all parts of the queries and every query to all blocks of vectors. Such a pair is what a task holds at a
    time. ``extra``: further columns (name: type), null on a side that lacks them.
    """
    block = F.pmod(F.xxhash64("vec_id", "vector"), F.lit(blocks)).cast("int")
    part = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(parts)).cast("int")
    base = lambda df: ["vec_id", "vector", F.size("vector").alias("dim"), *[c if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in extra.items()]]
    left = vectors.select(*base(vectors), F.lit(False).alias("is_query"), block.alias("block"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    right = queries.select(*base(queries), F.lit(True).alias("is_query"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), part.alias("part"))
    return left.unionByName(right)


def in_order(ids: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Positions by ascending id; rows that repeat an id by their components."""
    if len(np.unique(ids)) == len(ids):
        return np.argsort(ids, kind="stable")
    return np.lexsort((*x.T[::-1], ids))


def sides(pdf, kind):
    """(ids, vectors, query ids, query vectors, their rows in ``pdf``) of a dealt group; None where a side is empty.

    All rows are candidates, also those that repeat an id; of queries that repeat an id the first in order of components counts.
    """
    asks = pdf["is_query"].to_numpy(bool)
    if asks.all() or not asks.any():
        return None
    out, at = [], []
    for rows in (np.flatnonzero(~asks), np.flatnonzero(asks)):
        side = pdf.iloc[rows]
        ids, x = side["vec_id"].to_numpy(np.int64), np.array(side["vector"].tolist(), kind).reshape(len(side), side["dim"].iloc[0])
        pick = in_order(ids, x)
        if len(out):
            pick = pick[np.r_[True, np.diff(ids[pick]) != 0]]
        out += [ids[pick], x[pick]]
        at.append(rows[pick])
    return (*out, *at)


def nearest(found: DataFrame, k: int) -> DataFrame:
    """found(query_id, vec_id, score) -> the k best of each query with their rank; ties to the smaller vec_id."""
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
