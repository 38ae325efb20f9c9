"""Near copies by wide SimHash: documents whose sets of distinct five-word shingles have a Jaccard similarity of at least 0.8.

A document's fingerprint has 2,048 bits, each the majority over its distinct shingles. MinHash bands say which
fingerprints meet; inside a band value's bucket they are compared by SimHash distance, and what is near enough is
confirmed by the exact Jaccard similarity of both sets in Spark joins. Only confirmed links make components.

Two passes: first every fingerprint of a bucket meets the one nearest to the bucket's bitwise majority (the common
original of edited copies, if there is one); a large bucket does so in chunks, whose nearest ones then meet in the same
way until one is left. Components come from these links. Then, in buckets that still hold
several components, every fingerprint outside the largest one meets all of the others: 252 bit planes in carry-save
counters leave out most pairs, all 2,048 bits decide. So pairs go through Spark only if they lie in different
components and are within reach; no bucket is cut, and large ones are dealt out as pairs of chunks.
"""

from __future__ import annotations

from functools import lru_cache
from math import comb

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import document_key, keep_first_of_groups, materialise, small_batches, whole_groups
from .simhash import SEED, components, sliced_within

#: 14 bands of 4 minima let 1 - (1 - 0.8 ** 4) ** 14 = 99.94 % of the pairs at 0.8 meet, and more above it
SHINGLE, BANDS, DEPTH, WORDS, SLICED = 5, 14, 4, 32, 252
#: A pair at exactly the wanted similarity is within reach with 99.5 % (all bits) and 99.9 % (planes).
SPREAD, SLICED_SPREAD = 2.6, 3.2
_RNG = np.random.default_rng(SEED)
_KEYS, _WIDE_KEYS = _RNG.integers(0, 1 << 64, BANDS * DEPTH, np.uint64), _RNG.integers(0, 1 << 64, WORDS, np.uint64)
_A, _B, _29, _32 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(29), np.uint64(32)
_LOW = np.uint64(0x0101010101010101)


def shingles(text: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """Distinct hashes, ascending, of a text's shingles (its whole line where it has fewer words); none for no words."""
    words = text.lower().split() if text else []  # bytes: A-Z only, ASCII white space only
    if not words:
        return np.empty(0, np.uint64)
    line = b" ".join(words)
    if len(words) <= shingle:
        starts, ends = [0], [len(line)]
    else:
        after = np.cumsum([len(w) + 1 for w in words])
        starts, ends = [0, *after[:-shingle].tolist()], (after[shingle - 1 :] - 1).tolist()
    h = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((h(line[a:b], SEED) for a, b in zip(starts, ends)), np.uint64, len(starts)))


def _hashed(own: np.ndarray, keys: np.ndarray) -> np.ndarray:
    x = (own ^ keys) * _A
    x ^= x >> _32
    x *= _B
    return x


def band_values(own: np.ndarray, block: int = 2048) -> np.ndarray:
    """One hash a band of the minima of a set of shingles."""
    least = np.full(len(_KEYS), 0xFFFFFFFFFFFFFFFF, np.uint64)
    for k in range(0, len(own), block):
        np.minimum(least, _hashed(own[k : k + block], _KEYS[:, None]).min(axis=1), out=least)
    rows = least.reshape(BANDS, DEPTH)
    return np.array([xxhash.xxh64_intdigest(rows[k].tobytes(), k) for k in range(BANDS)], np.uint64).view(np.int64)


def bit_counts(x: np.ndarray) -> np.ndarray:
    """How many rows of ``x`` (rows x words) have each bit, 255 rows at a time in eight lanes a word."""
    counts = np.zeros((8, x.shape[1] * 8), np.int64)
    for k in range(0, len(x), 255):
        for j in range(8):
            counts[j] += (x[k : k + 255] >> np.uint64(j) & _LOW).sum(axis=0).view(np.uint8)
    return counts.T.ravel()


def majority(x: np.ndarray) -> np.ndarray:
    """Words whose bits are set in over half of the rows."""
    return np.packbits(bit_counts(x) * 2 > len(x), bitorder="little").view("<u8")


def wide_print(own: np.ndarray, block: int = 255 * 8) -> np.ndarray:
    """The wide fingerprint (32 words) of a set of shingles."""
    counts = np.zeros(WORDS * 64, np.int64)
    for k in range(0, len(own), block):
        x = _hashed(own[k : k + block, None], _WIDE_KEYS)
        counts += bit_counts(x ^ x >> _29)
    return np.packbits(counts * 2 > len(own), bitorder="little").view("<u8")


@lru_cache(maxsize=4)
def flip_shares(percent: int, upto: int = 128) -> np.ndarray:
    """Share of bits that differ between sets at exactly ``percent`` similarity, by the smaller set's size (the worst split of what they don't share)."""
    coin = lambda n: (np.arange(-n, n + 1, 2), np.array([comb(n, k) for k in range(n + 1)], float) / 2.0**n)
    share = np.zeros(upto + 1)
    for s in range(1, upto + 1):
        odd = s * (100 - percent) // percent
        at, mass = coin(s)
        for b in {0, odd // 2}:
            ones = [(mass_x[None, :] * (at[:, None] + x[None, :] > 0)).sum(axis=1) for x, mass_x in (coin(odd - b), coin(b))]
            n = min(s + b, upto)
            share[n] = max(share[n], float((mass * (ones[0] * (1 - ones[1]) + ones[1] * (1 - ones[0]))).sum()))
    return np.maximum.accumulate(share[::-1])[::-1]  # a larger set never reaches further than a smaller one


def reach(sizes: np.ndarray, percent: int, bits: int, spread: float) -> np.ndarray:
    """Distance within which pairs at ``percent`` lie, by the smaller set's size."""
    p = flip_shares(percent)
    p = p[np.minimum(sizes, len(p) - 1)]
    return np.ceil(bits * p + spread * np.sqrt(bits * p * (1 - p)))


def _within(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs of rows (fingerprints a, b of sets of sizes n, m) may have the wanted similarity."""
    far = np.concatenate([np.bitwise_count(a[k : k + 4096] ^ b[k : k + 4096]).sum(axis=1, dtype=np.int64) for k in range(0, len(a), 4096)] or [np.empty(0, np.int64)])
    return (far <= reach(np.minimum(n, m), percent, WORDS * 64, SPREAD)) & (np.minimum(n, m) * 100 >= np.maximum(n, m) * percent)


def _node(own: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(own.tobytes())).view(np.int64))


def _sketches(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, node (a hash of the set), n (its size), bands."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("node bigint, n int, bands array<bigint>")
    def sketch(text: pd.Series) -> pd.DataFrame:
        sets = [shingles(t) for t in text]
        return pd.DataFrame({"node": np.array([_node(s) for s in sets], np.int64), "n": np.array([len(s) for s in sets], np.int32), "bands": [band_values(s) for s in sets]})

    return docs.select("doc_id", sketch(F.col("text").cast("binary")).alias("p")).select("doc_id", "p.*")


def _sets(docs: DataFrame) -> DataFrame:
    """docs(text) -> node, n, own (the set), print, bands."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("node bigint, n int, own array<bigint>, print binary, bands binary")
    def sets(text: pd.Series) -> pd.DataFrame:
        found = [shingles(t) for t in text]
        return pd.DataFrame({"node": np.array([_node(s) for s in found], np.int64), "n": np.array([len(s) for s in found], np.int32), "own": [s.view(np.int64) for s in found], "print": [wide_print(s).tobytes() for s in found], "bands": [band_values(s).tobytes() for s in found]})

    # nondeterministic, or Spark asks it once more on all texts, below the joins, whether its results are null
    return docs.select(sets.asNondeterministic()(F.col("text").cast("binary")).alias("p")).select("p.*")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """pairs(a, b) whose sets have a Jaccard similarity of at least ``percent`` in 100, exactly."""
    side = lambda c: sets.select(F.col("node").alias(c), F.col("own").alias(f"own_{c}"))
    # the side that many pairs may share comes last, where rows are wide enough for Spark to split its partition
    wide = pairs.join(side("b"), "b").join(side("a"), "a")
    both, total = F.size(F.array_intersect("own_a", "own_b")), F.size("own_a") + F.size("own_b")
    return materialise(wide.filter(both * (100 + percent) >= total * percent).select("a", "b"), "near-links")


def _prints(pdf: pd.DataFrame) -> np.ndarray:
    return np.frombuffer(b"".join(pdf["print"]), "<u8").reshape(-1, WORDS)


def _meet_hubs(percent: int):
    """Rows by (bucket, chunk) -> pairs (a, b): each fingerprint with the one nearest to its chunk's majority, if within
    reach; and (bucket, a) alone for the latter where the bucket has more chunks."""

    def meet(batches):
        for x in whole_groups(batches, ["bucket", "chunk"], 8192):
            node, n, prints = x["node"].to_numpy(), x["n"].to_numpy(np.int64), _prints(x)
            first = np.flatnonzero(np.r_[True, (x["bucket"].to_numpy()[1:] != x["bucket"].to_numpy()[:-1]) | (x["chunk"].to_numpy()[1:] != x["chunk"].to_numpy()[:-1])])
            size = np.diff(np.r_[first, len(x)])
            hub = first.copy()  # of two, the first: rows come by node
            for k in np.flatnonzero(size > 2):
                own = prints[first[k] : first[k] + size[k]]
                hub[k] += np.bitwise_count(own ^ majority(own)).sum(axis=1, dtype=np.int64).argmin()
            a, b = np.repeat(hub, size), np.arange(len(x))
            a, b = a[a != b], b[a != b]
            near = _within(prints[a], prints[b], n[a], n[b], percent)
            yield pd.DataFrame({"bucket": pd.array([pd.NA] * int(near.sum()), "Int64"), "a": node[a[near]], "b": node[b[near]]})
            more = hub[x["chunks"].to_numpy()[hub] > 1]
            if len(more):
                yield pd.DataFrame({"bucket": x["bucket"].to_numpy()[more], "a": node[more], "b": pd.array([pd.NA] * len(more), "Int64")})

    return meet


def _meet_all(percent: int):
    """Rows by (bucket, i, j) with ``asks`` -> pairs (a < b) of an asking fingerprint and any other of another component, if within reach.

    Two fingerprints may share several buckets; their pair comes from the one of the first band that they share.
    """

    def meet(batches):
        for x in whole_groups(batches, ["bucket", "i", "j"], 8192):
            keys = x[["bucket", "i", "j"]].to_numpy()
            group = np.r_[0, np.cumsum((keys[1:] != keys[:-1]).any(axis=1))]
            asks, prints, n, root, node = x["asks"].to_numpy(bool), _prints(x), x["n"].to_numpy(np.int64), x["root"].to_numpy(), x["node"].to_numpy()
            bands, bucket = np.frombuffer(b"".join(x["bands"]), "<i8").reshape(-1, BANDS), x["bucket"].to_numpy()
            q, r = np.flatnonzero(asks), np.flatnonzero(~asks)
            if not len(q) or not len(r):
                continue
            radius = int(reach(n.min(keepdims=True), percent, SLICED, SLICED_SPREAD)[0])
            for a, b in sliced_within(prints[q], prints[r], radius, SLICED, group[q], group[r]):
                a, b = q[a], r[b]
                apart = root[a] != root[b]
                a, b = a[apart], b[apart]
                same = (bands[a] == bands[b]).argmax(axis=1)
                once = bands[a, same] == bucket[a]
                a, b = a[once], b[once]
                near = _within(prints[a], prints[b], n[a], n[b], percent)
                a, b = node[a[near]], node[b[near]]
                yield pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return meet


def near_copies(docs: DataFrame, percent: int = 80, max_bucket: int = 1024) -> DataFrame:
    """docs(doc_id, text) -> doc_id, component_id (the least id that links lead to, its own included), one row a document.

    Texts without words (null ones too) are copies of each other and of nothing else; documents with equal sets are one
    node from the start; texts of any length are read whole; an empty table gives no rows.
    """
    light = materialise(_sketches(docs.select("doc_id", "text")), "near-light")
    nodes = materialise(light.groupBy("node").agg(F.min("doc_id").alias("least"), F.first("n").alias("n"), F.first("bands").alias("bands")), "near-nodes")
    rows = nodes.filter("n > 0").select("node", F.explode("bands").alias("bucket"))
    shared = rows.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1")
    shared = materialise(rows.join(shared, "bucket"), "near-shared")
    # only texts that meet another one are read again: one a node, for its fingerprint and its set
    met = materialise(nodes.select("node", "least").join(shared.select("node").distinct(), "node", "left_semi"), "near-met")
    own = _sets(docs.join(met.select(F.col("least").alias("doc_id")).distinct().hint("shuffle_hash"), "doc_id", "left_semi")).join(met.select("node"), "node", "left_semi")
    sets = materialise(own.groupBy("node").agg(F.first("n").alias("n"), F.first("own").alias("own"), F.first("print").alias("print"), F.first("bands").alias("bands")), "near-sets")
    prints = sets.select("node", "n", "print")
    chunk = lambda chunks, seed: F.pmod(F.xxhash64("node", F.lit(seed)), chunks).cast("int")

    # numbers of their own: the work on a row says more than its bytes
    partitions = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    star, level = None, shared.select("node", "bucket", "size")
    while True:  # hubs of hubs, until a bucket has one: a bucket of a million copies takes two rounds
        chunks = F.ceil(F.col("size") / max_bucket).cast("int")
        dealt = level.select("node", "bucket", chunks.alias("chunks"), chunk(chunks, 0).alias("chunk")).join(prints, "node")
        met = dealt.repartition(partitions, "bucket", "chunk").sortWithinPartitions("bucket", "chunk", "node").mapInPandas(_meet_hubs(percent), "bucket bigint, a bigint, b bigint")
        met = materialise(met, "near-star")
        found, hubs = met.filter("bucket IS NULL").select("a", "b").distinct(), met.filter("bucket IS NOT NULL")
        star = found if star is None else star.unionByName(found)
        if hubs.isEmpty():
            break
        level = hubs.select(F.col("a").alias("node"), "bucket").distinct()
        level = materialise(level.join(level.groupBy("bucket").agg(F.count("*").alias("size")), "bucket"), "near-hubs")
    star = star.distinct()
    links = _confirmed(star, sets, percent)

    roots = components(links).select("node", "root")
    placed = materialise(shared.select("bucket", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "near-placed")
    held = placed.groupBy("bucket", "root").agg(F.count("*").alias("k")).groupBy("bucket").agg(F.sum("k").alias("size"), F.max(F.struct("k", "root")).alias("top"), F.count("*").alias("roots"))
    mixed = held.filter("roots > 1").select("bucket", F.col("top.root").alias("main"), F.ceil(F.col("size") / max_bucket).cast("int").alias("chunks"), F.ceil((F.col("size") - F.col("top.k")) / max_bucket).cast("int").alias("ask_chunks"))
    work = materialise(placed.join(mixed, "bucket"), "near-mixed")
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    asked = work.select("bucket", "node", "root", F.lit(False).alias("asks"), chunk(F.col("chunks"), 1).alias("j"), each(F.col("ask_chunks")).alias("i"))
    asking = work.filter("root <> main").select("bucket", "node", "root", F.lit(True).alias("asks"), chunk(F.col("ask_chunks"), 2).alias("i"), each(F.col("chunks")).alias("j"))
    both = asked.unionByName(asking).join(sets.select("node", "n", "print", "bands"), "node").repartition(partitions, "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    pairs = both.mapInPandas(_meet_all(percent), "a bigint, b bigint").distinct()
    tried = star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    rest = materialise(pairs.join(tried, ["a", "b"], "left_anti"), "near-rest")
    if not rest.isEmpty():
        roots = components(links.union(_confirmed(rest, sets, percent)))

    labelled = nodes.select("node", "least").join(roots.select("node", "root"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    labelled = materialise(labelled, "near-roots")
    names = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    of_node = materialise(labelled.join(names, "root").select("node", "component_id"), "near-of")
    return light.select("doc_id", "node").join(of_node, "node").select("doc_id", "component_id")


def drop_near_copies(docs: DataFrame, **how) -> DataFrame:
    """Pipeline form: of each group the document with the least id stays, with all columns of ``docs`` (doc_id and text among them, any others).

    Rows that repeat an id with another text are documents of their own (the least text hash comes first); of rows that
    repeat id and text one stays; rows without an id come after all others. Null and blank texts are one group. An
    empty table gives an empty one; texts of any length are read whole; other columns may have any name.
    """
    groups = near_copies(docs.select(document_key(docs).alias("doc_id"), "text"), **how)
    return keep_first_of_groups(docs, groups)
