"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked at a Hamming distance of at most ``radius``.

Fingerprints that differ in at most 3 bits agree in at least two of five blocks of bits, so only fingerprints that share
the values of two blocks (some 26 bits) are compared, in ten groupings, one a pair of blocks. A bucket of them is laid out as bit planes: plane p holds bit p of 64 fingerprints in
each machine word. One fingerprint is compared with 64 at a time: planes are xor-ed with its bits and added up in
carry-save counters; words in which all 64 distances exceed the radius are abandoned. Large buckets are dealt out as
pairs of chunks, so no task holds more than two chunks of one. A task sends on a spanning forest of the links that it
finds, not all pairs; connected components come from contraction rounds over Spark tables.
"""

from __future__ import annotations

from itertools import combinations, count

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import document_key, keep_first_of_groups, materialise, small_batches, whole_groups

BITS, BLOCKS, SEED = 64, 5, 42
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    """Signed 64-bit fingerprint of a text's UTF-8 bytes; 0 where there are no words."""
    words = text.lower().split() if text else []  # bytes: A-Z only, ASCII white space only
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= shingle:
        starts, ends = [0], [len(line)]
    else:
        after = np.cumsum([len(w) + 1 for w in words])
        starts, ends = [0, *after[:-shingle].tolist()], (after[shingle - 1 :] - 1).tolist()
    h = xxhash.xxh64_intdigest
    ones, n = np.zeros(BITS, np.int64), len(starts)
    for k in range(0, n, 65536):
        part = np.array([h(line[a:b], SEED) for a, b in zip(starts[k : k + 65536], ends[k : k + 65536])], "<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, text_col: str = "text", shingle: int = 3, out: str = "fp") -> DataFrame:
    """All rows of ``docs`` with their fingerprint as a bigint column ``out``; null and blank texts have 0."""

    small_batches(docs.sparkSession)

    @F.pandas_udf("bigint")
    def prints(text: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, shingle) for t in text], dtype="int64")

    return docs.withColumn(out, prints(F.col(text_col).cast("binary")))


def _join_roots(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Union of all pairs (a, b) in a forest of minimum roots."""
    while True:
        a, b = parent[a], parent[b]
        apart = a != b
        if not apart.any():
            return parent
        a, b = a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := parent[parent], parent):
            parent = up


def bucket_links(fps: np.ndarray, bucket: np.ndarray, asks: np.ndarray, planes_used, radius: int = 3, step: int = 1 << 17) -> np.ndarray:
    """Forest (parent index of each row) of the links inside each bucket. Rows must come bucket by bucket.

    ``asks``: rows that are compared with their whole bucket (of a pair of chunks, one side does).
    """
    n = len(fps)
    parent = np.arange(n)
    if not n or radius > 3:
        if radius > 3:
            raise ValueError("two counter bits and an overflow bit hold a radius of at most 3")
        return parent
    first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    size = np.diff(np.r_[first, n])
    words = (size + 63) // 64
    word0 = np.r_[0, np.cumsum(words)]
    of = np.repeat(np.arange(len(first)), size)
    lane = np.arange(n) - first[of]
    slot = word0[of] * 64 + lane
    padded = np.zeros(word0[-1] * 64, np.uint64)
    padded[slot] = fps
    valid = np.zeros(word0[-1] * 64, bool)
    valid[slot] = True
    empty = ~np.packbits(valid.reshape(-1, 64), axis=1, bitorder="little").view("<u8").ravel()
    one = np.uint64(1)
    planes = {p: np.packbits((padded >> np.uint64(p) & one).astype(bool).reshape(-1, 64), axis=1, bitorder="little").view("<u8").ravel() for p in planes_used}
    askers = np.flatnonzero(asks & (size[of] > 1))
    repeat = words[of[askers]]
    ends = np.cumsum(repeat)
    at = 0
    while at < len(askers):  # so many askers that their words fit in a step
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + step, "right")))
        own, times = askers[at:to], repeat[at:to]
        at = to
        for q, w in _pieces(own, times, word0[of[own]], step):
            over = empty[w].copy()
            self_word = w == slot[q] // 64
            over[self_word] |= one << (slot[q][self_word] % 64).astype(np.uint64)
            bits = fps[q]
            low, high = np.zeros(len(q), np.uint64), np.zeros(len(q), np.uint64)
            for k in range(0, len(planes_used), 3):
                x, y, z = (planes[p][w] ^ (np.uint64(0) - (bits >> np.uint64(p) & one)) if p is not None else np.zeros(len(w), np.uint64) for p in (*planes_used[k : k + 3], None, None)[:3])
                both = x ^ y
                total, carry = both ^ z, x & y | z & both
                c = low & total
                low ^= total
                over |= high & carry
                high ^= carry
                over |= high & c
                high ^= c
                if k % 6 == 3:
                    live = over != ALL
                    if live.mean() < 0.75:
                        q, w, over, bits, low, high = q[live], w[live], over[live], bits[live], low[live], high[live]
                        if not len(q):
                            break
            hit = np.flatnonzero(over != ALL)
            for k in range(0, len(hit), 1 << 14):
                some = hit[k : k + (1 << 14)]
                r, l = np.nonzero(np.unpackbits((~over[some]).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
                there = first[of[q[some][r]]] + (w[some][r] - word0[of[q[some][r]]]) * 64 + l
                parent = _join_roots(parent, q[some][r], there)
    return parent


def _pieces(own, times, word0, step):
    """(row, word) index pairs of the askers, at most about ``step`` at a time, also within one asker."""
    if len(own) == 1 and times[0] > step:
        for k in range(0, int(times[0]), step):
            m = min(step, int(times[0]) - k)
            yield np.full(m, own[0]), word0[0] + np.arange(k, k + m)
        return
    q = np.repeat(own, times)
    yield q, np.repeat(word0, times) + np.arange(len(q)) - np.repeat(np.cumsum(times) - times, times)


def sliced_within(asks: np.ndarray, prints: np.ndarray, radius: int, bits: int, ask_group: np.ndarray | None = None, group: np.ndarray | None = None, step: int = 1 << 16):
    """Pairs (position in ``asks``, position in ``prints``) of a group whose first ``bits`` bits differ in at most ``radius``, some at a time.

    Both are fingerprints of equal width (rows x 64-bit words), with the number of their group (ascending for ``prints``;
    all one group without). Each group has words of its own in the bit planes. Planes are added up seven at a time: four
    full adders make a three-bit number, which goes into counters that were set so that they overflow beyond the radius.
    """
    n, one, zero = len(prints), np.uint64(1), np.uint64(0)
    if not n or not len(asks):
        return
    asks, prints = asks[:, : -(-bits // 64)], prints[:, : -(-bits // 64)]
    group = np.zeros(n, np.int64) if group is None else group
    ask_group = np.zeros(len(asks), np.int64) if ask_group is None else ask_group
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    size = np.diff(np.r_[first, n])
    words = -(-size // 64)
    word0 = np.r_[0, np.cumsum(words)]
    slot = np.arange(n) - np.repeat(first - word0[:-1] * 64, size)
    back = np.full(word0[-1] * 64, -1)
    back[slot] = np.arange(n)
    bit = lambda x, p: x[:, p // 64] >> np.uint64(p % 64) & one
    planes, lanes = np.empty((bits, word0[-1]), np.uint64), np.zeros(word0[-1] * 64, bool)
    for p in range(bits):
        lanes[slot] = bit(prints, p)
        planes[p] = np.packbits(lanes.reshape(-1, 64), axis=1, bitorder="little").view("<u8").ravel()
    empty = np.packbits((back < 0).reshape(-1, 64), axis=1, bitorder="little").view("<u8").ravel()
    known = np.searchsorted(group[first], ask_group)
    met = np.flatnonzero((known < len(first)) & (group[first][np.minimum(known, len(first) - 1)] == ask_group))
    width = max(3, int(radius).bit_length())
    start = (1 << width) - 1 - radius

    def full(x, y, z):
        both = x ^ y
        return both ^ z, x & y | z & both

    ends = np.cumsum(words[known[met]])
    at = 0
    while at < len(met):  # so many askers that their words fit in a step
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + step, "right")))
        own = met[at:to]
        at = to
        for q, w in _pieces(own, words[known[own]], word0[known[own]], step):
            over = empty[w]
            sums = [np.full(len(q), ALL if start >> k & 1 else zero) for k in range(width)]
            wanted = asks[q]
            for p in range(0, bits, 7):
                x = [planes[k][w] ^ (zero - bit(wanted, k)) if k < bits else np.zeros(len(q), np.uint64) for k in range(p, p + 7)]
                (s1, c1), (s2, c2) = full(*x[:3]), full(*x[3:6])
                s, c3 = full(s1, s2, x[6])
                add = full(c1, c2, c3)
                carry = sums[0] & s
                sums[0] = sums[0] ^ s
                for k in (1, 2):
                    sums[k], carry = full(sums[k], add[k - 1], carry)
                for k in range(3, width):
                    sums[k], carry = sums[k] ^ carry, sums[k] & carry
                over |= carry
                if p % 28 == 21:
                    live = over != ALL
                    if live.mean() < 0.75:
                        q, w, over, wanted, sums = q[live], w[live], over[live], wanted[live], [c[live] for c in sums]
                        if not len(q):
                            break
            hit = np.flatnonzero(over != ALL)
            for k in range(0, len(hit), 1 << 12):
                some = hit[k : k + (1 << 12)]
                r, lane = np.nonzero(np.unpackbits((~over[some]).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
                yield q[some][r], back[w[some][r] * 64 + lane]


def _blocks(blocks: int) -> list[tuple[int, int]]:
    """(first bit, bits) of each block; widths differ by one bit at most."""
    cut = [BITS * k // blocks for k in range(blocks + 1)]
    return [(a, b - a) for a, b in zip(cut, cut[1:])]


def near_links(prints: DataFrame, radius: int = 3, max_bucket: int = 16384, blocks: int = BLOCKS) -> DataFrame:
    """prints(fp), all distinct -> links (a, b), a spanning forest of each bucket's links: every pair of fingerprints within ``radius`` is connected through them."""
    of = _blocks(blocks)
    groupings = list(combinations(range(blocks), blocks - radius))  # at most ``radius`` blocks can differ

    def bucket(g, k):
        key, used = F.lit(g).cast("bigint"), 0
        for b in k:
            at, width = of[b]
            used += width
            if used > 56:
                raise ValueError("a bucket's key has 56 bits for its blocks: take more blocks")
            key = F.shiftleft(key, width).bitwiseOR(F.shiftrightunsigned("fp", at).bitwiseAND((1 << width) - 1))
        return key

    keys_of = F.array(*[F.struct(F.lit(g).alias("grouping"), bucket(g, k).alias("bucket")) for g, k in enumerate(groupings)])
    rows = prints.select("fp", F.explode(keys_of).alias("x")).select("fp", "x.*")
    # a row for each bucket that must be cut: Spark's own size check picks the join
    large = rows.groupBy("grouping", "bucket").agg(F.count("*").alias("n")).filter(F.col("n") > max_bucket).select("grouping", "bucket", F.ceil(F.col("n") / max_bucket).cast("int").alias("chunks"))
    dealt = rows.join(large, ["grouping", "bucket"], "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = dealt.select("grouping", "bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") <= F.col("other")).alias("asks"), "fp")
    keys = ["grouping", "bucket", "i", "j"]

    def compare(batches):
        for x in whole_groups(batches, keys, 100_000):
            for g in np.unique(x["grouping"]):
                y = x[x["grouping"] == g]
                ends = np.flatnonzero((y[keys].to_numpy()[1:] != y[keys].to_numpy()[:-1]).any(axis=1)) + 1
                size = np.diff(np.r_[0, ends, len(y)])
                mates = np.repeat(size > 1, size)
                fps = y["fp"].to_numpy(np.int64).view(np.uint64)[mates]
                same = {p for b in groupings[g] for p in range(of[b][0], sum(of[b]))}
                parent = bucket_links(fps, np.repeat(np.arange(len(size)), size)[mates], y["asks"].to_numpy(bool)[mates], [p for p in range(BITS) if p not in same], radius)
                child = np.flatnonzero(parent != np.arange(len(parent)))
                yield pd.DataFrame({"a": fps[child].view(np.int64), "b": fps[parent[child]].view(np.int64)})

    # a number of its own: the work grows with the square of a bucket, so bytes say little about it
    partitions = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(partitions, *keys).sortWithinPartitions(*keys).mapInPandas(compare, "a bigint, b bigint")


def components(links: DataFrame) -> DataFrame:
    """links(a, b) -> (node, root): one root for each connected component, for all nodes that have links.

    Each round, every node goes to the least of itself and its neighbours, by value in even rounds (stars end at
    once) and by a hash in odd ones (a quarter of the nodes goes in the mean, whatever the shape); then links are
    rewritten between what is left. All rounds are tables in the shared folder.
    """
    edges = materialise(links.filter("a <> b").distinct(), "cc-edges")
    first = None
    for k in count():
        if edges.isEmpty():
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        order = (lambda c: F.col(c)) if k % 2 == 0 else (lambda c, k=k: F.xxhash64(F.col(c), F.lit(k)))
        least = both.groupBy("a").agg(F.min(F.struct(order("b").alias("o"), F.col("b").alias("v"))).alias("m"))
        step = materialise(least.select(F.col("a").alias("node"), F.least("m", F.struct(order("a").alias("o"), F.col("a").alias("v")))["v"].alias("root")), "cc-step")
        to_a = step.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        to_b = step.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        edges = materialise(edges.join(to_a, "a").join(to_b, "b").filter("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "cc-edges")
        if first is None:
            first = step
        else:
            later = step.select(F.col("node").alias("root"), F.col("root").alias("next"))
            first = materialise(first.join(later, "root", "left").select("node", F.coalesce("next", "root").alias("root")), "cc-roots")
    return first if first is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 3, max_bucket: int = 16384) -> DataFrame:
    """One row a document: id, fp, component_id (the least id that links lead to, its own included).

    Null and blank texts have fingerprint 0 and link like any other; null ids never name a component (unless it has no
    other id: then null); repeated rows stay; texts of any length are read whole; columns besides id and text don't matter;
    an empty table gives no rows.
    """
    light = materialise(fingerprints(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text")), "_text", shingle).select("doc_id", "fp"), "sim-light")
    nodes = materialise(light.groupBy("fp").agg(F.min("doc_id").alias("least")), "sim-nodes")
    roots = components(near_links(nodes.select("fp"), radius, max_bucket))
    labelled = nodes.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    labelled = materialise(labelled, "sim-roots")
    names = materialise(labelled.groupBy("root").agg(F.min("least").alias("component_id")), "sim-names")
    of_print = materialise(labelled.join(names, "root").select("fp", "component_id"), "sim-of")
    # both sides are plain scans, so Spark may split the partitions of frequent fingerprints
    return light.join(of_print, "fp").select("doc_id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, **how) -> DataFrame:
    """Rows of ``docs`` that name their group of near duplicates: as ``nearcopies.drop_near_copies``, linked by this module's fingerprints alone."""
    keyed = docs.select(document_key(docs).alias("doc_id"), "text")
    return keep_first_of_groups(docs, near_duplicates(keyed, **how).select("doc_id", "component_id"))


def op5_simhash(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
