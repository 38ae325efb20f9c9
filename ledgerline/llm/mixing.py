"""Mixing sources to target weights by hash-threshold histograms (DataFrame functions only).

Each source gets a target of words. A source's documents are all taken ``floor(target / size)`` times; for the rest,
those whose id hash lies under a threshold are taken once more. The threshold comes from histograms of words by hash
bucket: a coarse one over all documents, a finer one of the boundary bucket only, and at last the single hashes of
the boundary's boundary. No document is ever sorted or ranked; reruns and other partitionings decide alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, fresh, materialise

HASH_BITS, COARSE_BITS, FINE_BITS = 60, 12, 24


def id_hash(id_col, text_col):
    """60 bits of md5 over the id's text; rows with a null id go by their text."""
    key = F.coalesce(id_col.cast("string"), F.concat(F.lit("~"), F.coalesce(text_col, F.lit(""))))
    return F.conv(F.substring(F.md5(key), 1, HASH_BITS // 4), 16, 10).cast("bigint")


def word_count(text_col):
    return F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, weights=(5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """sizes(source, source_size), one row a source -> with weight and target added.

    ``share`` times all words are dealt by weight (``weights`` repeat over the sources by code point, null last); no
    target exceeds ``cap`` times its source, the excess goes to the others by weight. The level at which dealing stops
    is found from running sums over the sources ordered by cap / weight. One row a source: a single small window.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    everything = Window.partitionBy()
    s = sizes.withColumn("weight", F.element_at(cycle, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    s = s.withColumns({"cap": F.col("source_size") * F.lit(float(cap)), "total": F.sum("source_size").over(everything) * F.lit(float(share)), "all_weight": F.sum("weight").over(everything)})
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    s = s.withColumns({"caps": F.sum("cap").over(by_ratio), "open_weight": F.col("all_weight") - F.sum("weight").over(by_ratio)})
    s = s.withColumn("full", F.col("caps") + F.col("cap") / F.col("weight") * F.col("open_weight") <= F.col("total"))
    s = s.withColumns({"taken_caps": F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0.0)).over(everything), "rest_weight": F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("weight"))).over(everything)})
    level = (F.col("total") - F.col("taken_caps")) / F.when(F.col("rest_weight") > 0, F.col("rest_weight"))
    target = F.when(F.col("full"), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("weight") * level))
    return s.select("source", "source_size", "weight", target.alias("target"))


def _boundary(hist: DataFrame, plan: DataFrame, bucket: str) -> DataFrame:
    """The bucket in which a source's running sum first exceeds its budget, with the sum before it."""
    running = Window.partitionBy("source").orderBy(bucket).rowsBetween(Window.unboundedPreceding, 0)
    cum = hist.join(plan, hist["source"].eqNullSafe(plan["source"])).drop(plan["source"])
    cum = cum.withColumn("cum", F.col("before") + F.sum("words").over(running)).filter(F.col("cum") > F.col("budget"))
    return cum.groupBy("source").agg(F.min_by(F.struct(F.col(bucket), (F.col("cum") - F.col("words")).alias("before"), F.col("words"), "budget"), bucket).alias("b"))


def _light(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), id_hash(F.col(id_col), F.col(text_col)).alias("h"))


def thresholds(light: DataFrame, weights=(5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """light(source, size, h) -> one row a source: ds (the source), source_size, target, whole, limit.

    A document is taken ``whole`` times, and once more if its hash is at most ``limit`` (-1 where whole times meet the target).
    """
    sources = source_targets(light.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, cap)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("bigint")
    plan = materialise(sources.withColumn("whole", whole).withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size")).withColumn("before", F.lit(0).cast("bigint")), "mix-sources")

    coarse_shift, fine_shift = HASH_BITS - COARSE_BITS, HASH_BITS - COARSE_BITS - FINE_BITS
    coarse = light.groupBy("source", F.shiftright("h", coarse_shift).alias("bucket")).agg(F.sum("size").alias("words"))
    first = materialise(_boundary(coarse, plan.select("source", "budget", "before"), "bucket").select(F.col("source").alias("bs"), F.col("b.bucket").alias("bucket"), F.col("b.before").alias("before"), F.col("b.budget").alias("budget")), "mix-coarse")

    inside = light.join(first, light["source"].eqNullSafe(first["bs"]) & (F.shiftright("h", coarse_shift) == F.col("bucket")))
    fine = inside.groupBy("source", F.shiftright("h", fine_shift).alias("fine")).agg(F.sum("size").alias("words"))
    second = materialise(_boundary(fine, first.select(F.col("bs").alias("source"), "budget", "before"), "fine").select(F.col("source").alias("bs"), F.col("b.fine").alias("fine"), F.col("b.before").alias("before"), F.col("b.budget").alias("budget")), "mix-fine")

    within = light.join(second, light["source"].eqNullSafe(second["bs"]) & (F.shiftright("h", fine_shift) == F.col("fine")))
    single = within.groupBy("source", "h").agg(F.sum("size").alias("words"))
    last = _boundary(single, second.select(F.col("bs").alias("source"), "budget", "before"), "h")
    nearer = F.col("b.before") + F.col("b.words") - F.col("b.budget") < F.col("b.budget") - F.col("b.before")
    limits = last.select(F.col("source").alias("bs"), F.when(nearer, F.col("b.h")).otherwise(F.col("b.h") - 1).alias("limit"))
    return materialise(plan.join(limits, plan["source"].eqNullSafe(limits["bs"]), "left").select(F.col("source").alias("ds"), "source_size", "target", "whole", F.when(F.col("budget") > 0, F.coalesce("limit", F.lit(-1))).otherwise(-1).alias("limit")), "mix-limits")


def mix(docs: DataFrame, weights=(5, 2, 1), share: float = 1.5, cap: float = 2.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row a document: doc_id, source, size, h, source_size, target, copies, taken.

    copies: how often the mix takes the document (0 up to ``cap``); taken: its words times copies. A null source is a
    source of its own, null and blank texts have size 0, long ones are counted whole, repeated rows share their hash and so their fate, an empty table gives
    an empty result; other columns don't matter. A source's words miss its target by at most half of the words of one
    single hash. The table of decisions has one row a source and is joined, so Spark's own size check picks the way.
    """
    light = materialise(_light(docs, id_col, text_col, source_col), "mix-light")
    decided = thresholds(light, weights, share, cap)
    out = light.join(decided, light["source"].eqNullSafe(decided["ds"]))
    copies = (F.col("whole") + (F.col("h") <= F.col("limit")).cast("bigint")).alias("copies")
    return out.select("doc_id", "source", "size", "h", "source_size", "target", copies).withColumn("taken", F.col("size") * F.col("copies"))


def mix_rows(docs: DataFrame, weights=(5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Pipeline form: ``docs`` with each row as often as the mix takes it; rows that it doesn't take are gone. Texts aren't shuffled.

    Needs doc_id, text and source; other columns may have any name. Nulls, blank texts, repeated rows and empty tables
    as in ``mix``; texts of any length are counted whole.
    """
    decided = thresholds(materialise(_light(docs, "doc_id", "text", "source"), "mix-light"), weights, share, cap)
    of, whole, limit, copy = (fresh(docs, c) for c in ("of", "whole", "limit", "copy"))
    decided = decided.select(F.col("ds").alias(of), F.col("whole").alias(whole), F.col("limit").alias(limit))
    copies = F.col(whole) + (id_hash(F.col("doc_id"), F.col("text")) <= F.col(limit)).cast("bigint")
    hit = docs.join(decided, F.col("source").eqNullSafe(F.col(of))).withColumn(copy, copies).filter(F.col(copy) > 0)
    return hit.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copy).cast("int")))).select(*[F.col(f"`{c}`") for c in docs.columns])


def op2_mixing(spark, sf_dir):
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '~' || coalesce(text, ''))), 1, 15) AS BIGINT) AS h
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM s),
c AS (SELECT *, source_size * 2.0::DOUBLE AS cap, sum(source_size) OVER () * 1.5::DOUBLE AS total, sum(weight) OVER () AS all_weight FROM w),
r AS (SELECT *, sum(cap) OVER o AS caps, all_weight - sum(weight) OVER o AS open_weight FROM c
      WINDOW o AS (ORDER BY cap / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
f AS (SELECT *, caps + cap / weight * open_weight <= total AS isfull FROM r),
g AS (SELECT *, sum(CASE WHEN isfull THEN cap ELSE 0 END) OVER () AS taken_caps, sum(CASE WHEN isfull THEN 0 ELSE weight END) OVER () AS rest FROM f),
t AS (SELECT source, source_size, CASE WHEN isfull THEN cap ELSE least(cap, weight * ((total - taken_caps) / rest)) END AS target FROM g),
p AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
b AS (SELECT *, target - whole * source_size AS budget FROM p),
u AS (SELECT source, h, CAST(sum(size) AS BIGINT) AS words FROM d GROUP BY source, h),
v AS (SELECT *, sum(words) OVER (PARTITION BY source ORDER BY h ROWS UNBOUNDED PRECEDING) AS cum FROM u),
x AS (SELECT b.source, min_by(struct_pack(h := h, cum := cum, words := words), h) AS k, any_value(budget) AS budget
      FROM b JOIN v ON b.source IS NOT DISTINCT FROM v.source WHERE cum > budget GROUP BY b.source),
y AS (SELECT source, CASE WHEN k.cum - budget < budget - (k.cum - k.words) THEN k.h ELSE k.h - 1 END AS lim FROM x)
SELECT d.doc_id, d.size, b.source_size, b.target,
       CAST(d.size * (b.whole + CASE WHEN d.h <= coalesce(y.lim, -1) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source LEFT JOIN y ON y.source IS NOT DISTINCT FROM b.source
"""
