"""Shards as ranges of an id with about equal bytes: a plan made by Spark, and the shard of each row."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Plan(NamedTuple):
    """bounds of the cells of ids (cell 0 is that of null ids), and of each cell: its first shard, how many shards it has, its least id and its end."""

    bounds: np.ndarray
    first: np.ndarray
    parts: np.ndarray
    low: np.ndarray
    end: np.ndarray

    @property
    def shards(self) -> int:
        return int(self.first[-1] + self.parts[-1])


def cells(bounds: np.ndarray, ids: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(cell of each id, ids with 0 for null). Arrow arrays: pandas would turn ids beside nulls into floats."""
    plain = ids.fill_null(0).to_numpy(zero_copy_only=False)
    return np.where(ids.is_valid().to_numpy(zero_copy_only=False), 1 + np.searchsorted(bounds, plain, "right"), 0), plain


def plan_shards(light: DataFrame, rows_per_shard: int = 1 << 20, most_cells: int = 1 << 16) -> Plan:
    """light(id, weight) -> shards of 8 to 512 MB by ranges of ids, whatever the partitions or settings of the session.

    Bounds are ids picked by hash, at most some 400,000 whatever the table's size, and the ids that fill a shard alone;
    bytes are summed by cell in Spark. Neighbouring cells fill a shard; a cell that holds several shards is cut evenly by id,
    one of a single id (or null) by the row's hash, so shards are ranges of (id, hash) at any size.
    """
    n, size, least, greatest = light.agg(F.count("*"), F.sum("weight"), F.min("id"), F.max("id")).first()
    shard_bytes = min(512 << 20, max(8 << 20, (size or 0) >> 12))
    shards = max(1, -(-(size or 0) // shard_bytes), -(-n // rows_per_shard))
    every = max(1, n // 200_000)
    picked = np.sort(light.select("id").filter(f"id IS NOT NULL AND pmod(xxhash64(id), {every}) = 0").distinct().toPandas()["id"].to_numpy(np.int64))
    if len(picked):
        picked = picked[np.linspace(0, len(picked) - 1, min(len(picked), most_cells)).astype(int)]
    # at most one id for each 8 MB of a shard can weigh so much
    heavy = light.filter("id IS NOT NULL").groupBy("id").agg(F.sum("weight").alias("w")).filter(F.col("w") >= shard_bytes).select("id").toPandas()["id"].to_numpy(np.int64)
    bounds = np.unique(np.concatenate([picked, heavy, heavy[heavy < np.iinfo(np.int64).max] + 1])).astype(np.int64)
    sent = light.sparkSession.sparkContext.broadcast(bounds)

    @F.arrow_udf("int")
    def cell_of(ids: pa.Array) -> pa.Array:
        return pa.array(cells(sent.value, ids)[0], pa.int32())

    weights = np.zeros(len(bounds) + 2)
    for r in light.groupBy(cell_of("id").alias("cell")).agg(F.sum("weight").alias("w")).toLocalIterator():
        weights[r["cell"]] = r["w"]
    each = max(1.0, weights.sum() / shards)
    parts = np.maximum(1, np.round(weights / each)).astype(np.int64)  # shards of cells that hold more than one
    first, at, filled = np.zeros(len(weights), np.int64), 0, 0.0
    for k, w in enumerate(weights):
        if filled and (filled + w > each or parts[k] > 1):
            at, filled = at + 1, 0.0
        first[k] = at
        filled += w
        if parts[k] > 1:
            at, filled = at + parts[k], 0.0
    edges = np.concatenate([[0.0, float(least or 0)], bounds.astype(float), [float(greatest or 0) + 1]])
    return Plan(bounds, first, parts, edges[:-1], edges[1:])


def shard_column(plan: Plan, sent, id_col: Column, hash_col: Column) -> Column:
    """The shard of each row by the broadcast ``sent`` of ``plan``; it never falls while (id with nulls first, hash) rises."""

    @F.arrow_udf("int")
    def shard_of(ids: pa.Array, h: pa.Array) -> pa.Array:
        p = sent.value
        cell, plain = cells(p.bounds, ids)
        parts, width = p.parts[cell], p.end[cell] - p.low[cell]
        alone = (cell == 0) | (width <= 1)
        share = np.where(alone, h.to_numpy(zero_copy_only=False) / 2.0**64 + 0.5, (plain - p.low[cell]) / np.maximum(width, 1))
        part = np.clip(np.floor(share * parts).astype(np.int64), 0, parts - 1)
        return pa.array((p.first[cell] + part).astype(np.int32))

    return shard_of(id_col, hash_col)
