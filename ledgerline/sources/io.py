"""Readers of extracted lines, cells and words, and sinks of result tables. Every sink is one ``df.write`` a table."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def text_lines(spark: SparkSession, path: str, pattern: str = "*.txt") -> DataFrame:
    """Text files of a folder tree as lines: file, page_no (form feeds part pages), line_no (from 1 on each page), text.

    A file of any size is read in blocks by many tasks. Lines are numbered inside their block; what a block begins with
    comes from the sums of the blocks before it, one row a block. A line end at the end of a file begins no line.
    """
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).option("lineSep", "\n").text(path)
    # a task reads a block's lines one after another, so this number follows their order
    read = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"), F.regexp_replace("value", "\r$", "").alias("value"))
    feeds = F.length("value") - F.length(F.replace("value", F.lit("\f"), F.lit("")))
    inside = Window.partitionBy("file", "block").orderBy("n")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    own = read.withColumn("feeds", feeds).withColumn("i", F.row_number().over(inside).cast("bigint"))
    own = own.withColumns({"pages": F.coalesce(F.sum("feeds").over(before), F.lit(0)), "fed": F.max(F.when(F.col("feeds") > 0, F.col("i"))).over(before)})
    blocks = read.withColumn("feeds", feeds).groupBy("file", "block").agg(F.count("*").alias("lines"), F.sum("feeds").alias("feeds"), F.min("n").alias("first"), F.max(F.when(F.col("feeds") > 0, F.col("n"))).alias("fed"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("lines_before", F.coalesce(F.sum("lines").over(earlier), F.lit(0)))
    blocks = blocks.withColumns({"pages_before": F.coalesce(F.sum("feeds").over(earlier), F.lit(0)), "fed_before": F.max(F.when(F.col("fed").isNotNull(), F.col("lines_before") + F.col("fed") - F.col("first") + 1)).over(earlier)})
    whole = own.join(blocks.select("file", "block", "lines_before", "pages_before", "fed_before"), ["file", "block"])
    at, last = F.col("lines_before") + F.col("i"), F.coalesce(F.col("lines_before") + F.col("fed"), F.col("fed_before"))
    line = F.coalesce(at - last + 1, at)
    pieces = whole.select("file", (F.col("pages_before") + F.col("pages") + 1).alias("page"), line.alias("line"), F.posexplode(F.split("value", "\f")).alias("k", "text"))
    return pieces.select("file", (F.col("page") + F.col("k")).cast("int").alias("page_no"), F.when(F.col("k") == 0, F.col("line")).otherwise(1).cast("int").alias("line_no"), "text")


def sheet_cells(spark: SparkSession, path: str, pattern: str = "*.csv", width: int | None = None, widest: int = 16_384) -> DataFrame:
    """CSV exports of a folder tree as cells: file, page_no, table_no, row_no (from 1 in each file), cells.

    Rows may differ in width, up to ``width`` cells if it is given; a wider row is an error, never cut. How many columns
    must be read is found from the data in a first pass (commas inside quotes count, so it may be more than needed).
    """

    def read(n):
        names = [f"c{k}" for k in range(n)]
        rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).option("multiLine", "true").option("columnNameOfCorruptRecord", "_odd")
        raw = rows.schema(", ".join(f"{c} string" for c in names) + ", _odd string").csv(path)  # _odd: rows of any other width
        return raw.select(F.col("_metadata.file_path").alias("file"), F.array(*names).alias("all"), (F.length("_odd") - F.length(F.replace("_odd", F.lit(","), F.lit(""))) + 1).alias("most"))

    least = width or 64
    columns = max(least, read(least).agg(F.max("most"), F.count_if(F.col("all")[0].isNotNull())).first()[0] or 0)  # Spark doesn't read that column alone
    if columns > widest:
        raise ValueError(f"a row of some {columns} cells: raise widest, the most columns to read")
    row_no = F.row_number().over(Window.partitionBy("file").orderBy("n"))  # one task reads a file
    last = F.array_max(F.transform("all", lambda c, i: F.when(c.isNotNull(), i + 1).otherwise(0))).cast("int")
    if width is not None:
        last = F.when(last > width, F.raise_error(F.concat(F.lit(f"a row of more than {width} cells in "), F.col("file"))).cast("int")).otherwise(last)
    raw = read(columns).withColumn("n", F.monotonically_increasing_id())
    return raw.select("file", F.lit(1).alias("page_no"), F.lit(0).alias("table_no"), row_no.alias("row_no"), F.slice("all", F.lit(1), F.greatest(last, F.lit(1))).alias("cells"))


def layout_files(spark: SparkSession, path: str) -> DataFrame:
    """Layout configurations, one JSON file each; names that start with an underscore are templates."""
    docs = spark.read.option("multiLine", "true").option("pathGlobFilter", "*.json").json(path)
    return docs.select("*", F.col("_metadata.file_name").alias("file_name")).filter(~F.startswith("file_name", F.lit("_")))


def find_files(spark: SparkSession, path: str, extensions=("pdf", "xls", "xlsx", "csv")) -> DataFrame:
    """Files of a folder tree by extension, without their content."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join([*extensions, *map(str.upper, extensions)]) + "}").load(path)
    return found.select("path", "length", "modificationTime")


def write_tables(tables: dict[str, DataFrame], path: str, run_id: str, kind: str = "parquet") -> None:
    """One folder a table, one partition a run; writing a run again replaces it."""
    for name, df in tables.items():
        flat = df if kind != "csv" else df.select(*[F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in df.dtypes])
        flat.write.mode("overwrite").format(kind).option("header", "true").save(f"{path}/{name}/run_id={run_id}")


def write_documents(documents: DataFrame, path: str) -> None:
    """JSON texts, one a line."""
    documents.select("document").write.mode("overwrite").text(path)


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder name in the folder that driver and executors share (``spark.checkpoint.dir``); local masters may do without the setting."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="ledger-")
    _MADE.append(f"{found.rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return _MADE[-1]


_MADE: list[str] = []


def remove_work(spark: SparkSession) -> int:
    """Delete the folders that this process named in the shared folder; for callers that have read or written all results. How many there were."""
    count = 0
    while _MADE:
        path = spark._jvm.org.apache.hadoop.fs.Path(_MADE.pop())
        count += bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))
    return count


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: what follows doesn't compute it again, and lost executors cost nothing."""
    out = work_folder(df.sparkSession, name) + "/table"
    df.write.parquet(out)
    return df.sparkSession.read.schema(df.schema).parquet(out)
