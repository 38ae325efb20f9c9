"""One reading of a batch: each file goes to the reader of its layout's shape, what gives no rows to the generic one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.operators import detect, parse
from ledgerline.sources import io

#: Layouts that read what no other one does: lines with one or three amounts, and words in seven columns.
GENERIC, GENERIC_WORDS = "generic_pdf", "generic_words"
#: Of a layout with several shapes, the first that gives rows counts.
SHAPES = ["C", "M", "L", "P"]


def read_batch(statements: DataFrame, layouts: DataFrame, lines: DataFrame | None = None, cells: DataFrame | None = None, words: DataFrame | None = None, keywords: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """(ledger rows, files). statements(file, bank_id); lines, cells and words as extracted, each with ``file``.

    Rows say who read them (``reader``: own or generic) and from which ``shape``. Files: file, bank_id, rows, reader and ``error``:
    unknown_layout (even if the generic reader found rows) or no_rows; so no file is read as nothing without a word.
    """
    spark = layouts.sparkSession
    empty = lambda schema: spark.createDataFrame([], schema)
    of = statements.select("file", "bank_id")
    lines = (empty("file string, page_no int, line_no int, text string") if lines is None else lines).drop("bank_id")
    cells = (empty("file string, page_no int, table_no int, row_no int, cells array<string>") if cells is None else cells).drop("bank_id")
    words = (empty("file string, page_no int, x0 double, x1 double, top double, text string") if words is None else words).drop("bank_id")

    known = layouts.filter(~F.col("bank_id").isin(GENERIC, GENERIC_WORDS))
    read = parse.line_ledger(lines.join(of, "file"), known)
    read = read.unionByName(parse.cell_ledger(cells.join(of, "file"), known, keywords)).unionByName(parse.word_ledger(words.join(of, "file"), None, known))
    read = io.written(read, "read-own")  # parsed once, whatever asks for it below
    own = _first_shape(read).withColumn("reader", F.lit("own"))
    rest = of.select("file").join(read.select(F.col("source_file").alias("file")).distinct(), "file", "left_anti")
    as_bank = lambda df, bank: df.join(rest, "file").withColumn("bank_id", F.lit(bank))
    last = parse.line_ledger(as_bank(lines, GENERIC), layouts.filter(F.col("bank_id") == GENERIC))
    last = io.written(last.unionByName(parse.word_ledger(as_bank(words, GENERIC_WORDS), None, layouts.filter(F.col("bank_id") == GENERIC_WORDS))), "read-generic")
    ledger = own.unionByName(_first_shape(last).withColumn("reader", F.lit("generic")))
    counts = ledger.groupBy(F.col("source_file").alias("file")).agg(F.count("*").alias("rows"), F.max("reader").alias("reader"))
    files = detect.route(of, layouts).join(counts, "file", "left").withColumn("rows", F.coalesce("rows", F.lit(0)))
    error = F.coalesce("error", F.when(F.col("rows") == 0, F.lit("no_rows")))
    return ledger, files.select("file", "bank_id", "rows", "reader", error.alias("error"))


def _first_shape(rows: DataFrame) -> DataFrame:
    """Of a file's rows those of its first shape; counted by file before the join, so a huge file is no hot spot."""
    rank = F.array_position(F.array(*map(F.lit, SHAPES)), F.col("shape"))
    best = rows.groupBy(F.col("source_file").alias("_file")).agg(F.min_by("shape", rank).alias("_shape"))
    return rows.join(best, (F.col("source_file") == F.col("_file")) & (F.col("shape") == F.col("_shape"))).drop("_file", "_shape")
