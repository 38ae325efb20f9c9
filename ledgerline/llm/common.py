"""Shared scratch storage and small column helpers of the corpus operators."""

from __future__ import annotations

import tempfile
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space and words of every word-based operator here (ASCII white space only).
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only where that is unset and the master is local (tests, notebooks) a temporary folder is set. On a cluster without
    it this is an error: a folder of one machine would lose rows without a word.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="corpus-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


_MADE: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name in the shared folder; nothing else uses it."""
    _MADE.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _MADE[-1]


def remove_scratch() -> int:
    """Delete all scratch folders that this process made; for callers that have read or written all results. How many there were."""
    count = 0
    while _MADE:
        fs, path = filesystem(_MADE.pop())
        if fs.get_file_info(path).type.name == "Directory":
            fs.delete_dir(path)
            count += 1
    return count


def small_batches(spark: SparkSession, rows: int = 512) -> SparkSession:
    """Have Spark hand at most ``rows`` texts at once to Python: its own limit of bytes (64 MB) is much for a small executor's workers."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows or int(spark.conf.get(key)) <= 0:
        spark.conf.set(key, str(rows))
    return spark


def filesystem(uri: str):
    """(file system, path) of a shared folder, for tasks that write or read files there."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if ":" in uri.split("/")[0] else (fs.LocalFileSystem(), uri)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage ends there, lost executors cost nothing."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have, whatever its case."""
    taken, out = {c.lower() for c in df.columns}, f"_{name}"
    while out in taken:
        out += "_"
    return out


def whole_groups(batches, keys: list[str], least_rows: int = 50_000):
    """Data frames of whole groups out of a partition's batches, sorted by ``keys``; some ``least_rows`` rows each, or one group."""
    held, count = [], 0
    for pdf in batches:
        held.append(pdf)
        count += len(pdf)
        if count >= least_rows:
            x = pd.concat(held, ignore_index=True)
            done = int((x[keys] == x[keys].iloc[-1]).all(axis=1).to_numpy().argmax())  # where the last group starts
            if done:
                yield x.iloc[:done]
            held, count = [x.iloc[done:]], len(x) - done
    if count:
        yield pd.concat(held, ignore_index=True)


def lower_ascii(c: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def id_text(c: Column) -> Column:
    return c.cast("string")


def crc_mod(c: Column, n: int) -> Column:
    """crc32 of an id's decimal text, modulo n; 0 for a null id (so that it is defined)."""
    return F.coalesce(F.crc32(id_text(c)) % n, F.lit(0))


def document_key(docs: DataFrame) -> Column:
    """What tells documents apart, in order: id (null last), then the text's hash (null last)."""
    return F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("text").isNull().alias("no_text"), F.md5("text").alias("md5"))


def keep_first_of_groups(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose key names its group in groups(doc_id, component_id); of rows that repeat id and text, the one
    whose columns hash least.

    Decided on narrow rows; texts are shuffled once and not sorted, those of repeated rows only are aggregated.
    """
    key, more = fresh(docs, "key"), fresh(docs, "more")
    parts = [F.coalesce(F.col("doc_id")[c].cast("string"), F.lit("~")) for c in ("doc_id", "md5")]
    flat = F.concat(*[x for p in parts for x in (p, F.lit("|"))])
    stay = groups.filter(F.col("doc_id") == F.col("component_id")).groupBy(flat.alias(key)).agg((F.count("*") > 1).alias(more))
    stay = materialise(stay, "near-stay")
    mine = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("~")), F.lit("|"), F.coalesce(F.md5("text"), F.lit("~")), F.lit("|"))
    hit = docs.withColumn(key, mine).join(stay.hint("shuffle_hash"), key)
    out = hit.filter(~F.col(more))
    if not stay.filter(more).isEmpty():
        # which one: the least by a hash of all its columns, so reruns agree
        whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
        one = hit.filter(more).groupBy(key).agg(F.min_by(whole, F.sha2(F.to_json(whole), 256)).alias(key + "_"))
        out = out.select(*[F.col(f"`{c}`") for c in docs.columns]).unionByName(one.select(*[F.col(key + "_")[c].alias(c) for c in docs.columns]))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
