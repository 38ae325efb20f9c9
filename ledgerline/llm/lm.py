"""LM scoring by deleted interpolation of a word bigram model.

p(w | u) = l2 * c(u, w) / c(u) + l1 * c(w) / N + l0 / (V + 1), with weights l2, l1, l0 of their own for each bucket of
the context's frequency c(u). The weights come from expectation-maximisation on a deleted part of the training
documents, against counts of the rest; counts for scoring are those of all training documents.

Tokens are the lower-cased words (A-Z only) and one end mark a document, which is also the context of its first word.

How it runs: a task cuts its documents into shards of some 8 MB of text, numbers a shard's words, and writes the numbered
tokens to the shared folder. To the shuffle go only a shard's distinct words and word pairs, packed by the part of
the key space that counts them; each part sums its keys and answers with the totals in the order in which they were
asked for. Answers go back to their shard, whose tokens are read from the shared folder; texts and tokens
themselves are never shuffled. Keys are 64-bit hashes of words, and 48 bits of a pair's hash within its part.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, filesystem, materialise, scratch, small_batches

TEST, KEPT, DELETED = 0, 1, 2
END = b""  # no word is empty
NO_ID = np.int64(np.iinfo(np.int64).min)
BUCKETS, BIN = 24, 8  # context buckets by powers of two; bins a factor of ten for the held-out counts
MESSAGE = "part int, shard string, words binary, word_kept binary, word_deleted binary, pairs binary, pair_kept binary, pair_deleted binary"
ANSWER = "part int, shard string, word_kept binary, word_deleted binary, pair_kept binary, pair_deleted binary, types bigint, kept bigint, deleted bigint"
NOTED = "shard string, words binary, pairs binary, bucket int, bin2 int, bin1 int, n bigint, sum2 double, sum1 double"


def pack(a: np.ndarray) -> bytes:
    """Unsigned integers in the narrowest width that holds them, compressed."""
    width = next(w for w in (1, 2, 4, 8) if w == 8 or not len(a) or a.max() < 1 << 8 * w)
    return bytes([width]) + zstandard.ZstdCompressor(1).compress(a.astype(f"<u{width}").tobytes())


def unpack(b: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b[1:]), f"<u{b[0]}").astype(np.int64)


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64-bit hash of pairs of 64-bit hashes."""
    x = a * np.uint64(0x9E3779B97F4A7C15) ^ (b << np.uint64(31) | b >> np.uint64(33)) * np.uint64(0xC2B2AE3D27D4EB4F)
    x = (x ^ x >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ x >> np.uint64(32)


def _parts(ids: np.ndarray, short: np.ndarray, parts: int):
    """Order of a shard's words by part, and its distinct pairs (code, token -> pair) with their order by part.

    ``short`` are 32 bits of the words' hashes: they decide the part of a word and of a pair.
    """
    word_part = (short % np.uint32(parts)).astype(np.int64)
    before = np.r_[ids[-1:] if len(ids) else ids, ids[:-1]].astype(np.int64)  # the last token of a shard is an end mark, too
    codes, at = np.unique(before * len(short) + ids, return_inverse=True)
    u, w = codes // len(short), codes % len(short)
    pair_part = (_mix(short[u].astype(np.uint64), short[w].astype(np.uint64)) % np.uint64(parts)).astype(np.int64)
    return word_part, np.argsort(word_part, kind="stable"), u, w, at, pair_part, np.argsort(pair_part, kind="stable")


def _cut(docs, out_dir: str, parts: int, shard_bytes: int):
    fs, base = filesystem(out_dir)
    fs.create_dir(base, recursive=True)
    task, made = TaskContext.get().partitionId(), 0

    def flush(number, tokens, doc_ids, roles):
        nonlocal made
        name = f"{task:06d}-{made:04d}"
        made += 1
        ids, lens = np.concatenate(tokens), np.array([len(t) for t in tokens])
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, number), np.uint64, len(number))
        short = hashes.astype(np.uint32)
        columns = {"ids": pack(ids), "lens": pack(lens), "roles": pack(np.array(roles)), "docs": np.array(doc_ids, np.int64).tobytes(), "short": short.tobytes()}
        table = pa.table({k: pa.array([v], pa.large_binary()) for k, v in columns.items()})
        temp = f"{base}/{name}.{TaskContext.get().taskAttemptId()}.tmp"
        with fs.open_output_stream(temp) as sink, pa.ipc.new_stream(sink, table.schema) as w:
            w.write_table(table)
        fs.move(temp, f"{base}/{name}")  # a second attempt writes the same again
        role = np.repeat(roles, lens)
        word_part, word_order, u, w, at, pair_part, pair_order = _parts(ids, short, parts)
        keys = _mix(hashes[u], hashes[w])
        counts = lambda idx, n: [np.bincount(idx, role == r, n).astype(np.int64) for r in (KEPT, DELETED)]
        word_counts, pair_counts = counts(ids, len(number)), counts(at, len(u))
        present = np.union1d(word_part, pair_part)  # only parts that get a key: there may be far more parts than keys
        ends = lambda sorted_parts: (np.searchsorted(sorted_parts, present, "left"), np.searchsorted(sorted_parts, present, "right"))
        rows = []
        for p, wa, wb, pa_, pb in zip(present.tolist(), *ends(word_part[word_order]), *ends(pair_part[pair_order])):
            a, b = word_order[wa:wb], pair_order[pa_:pb]
            rows.append((p, name, hashes[a].tobytes(), *(pack(c[a]) for c in word_counts), np.ascontiguousarray(keys[b].astype("<u8").view(np.uint8).reshape(-1, 8)[:, 2:]).tobytes(), *(pack(c[b]) for c in pair_counts)))
        types = [pa.int32(), pa.string()] + [pa.binary()] * 6
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], [f.split()[0] for f in MESSAGE.split(", ")])

    number, tokens, doc_ids, roles, size = {END: 0}, [], [], [], 0
    for batch in docs:
        for doc_id, role, text in zip(batch["doc_id"].to_pylist(), batch["role"].to_pylist(), batch["text"]):
            words = (text.as_py() or b"").lower().split()
            tokens.append(np.array([*(number.setdefault(w, len(number)) for w in words), 0], np.int32))
            doc_ids.append(NO_ID if doc_id is None else doc_id)
            roles.append(role)
            size += sum(map(len, words)) + len(words)
            if size >= shard_bytes:
                yield flush(number, tokens, doc_ids, roles)
                number, tokens, doc_ids, roles, size = {END: 0}, [], [], [], 0
    if tokens:
        yield flush(number, tokens, doc_ids, roles)


def _total(keys: list[np.ndarray], kept: list[np.ndarray], deleted: list[np.ndarray]):
    distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
    sums = [np.bincount(at, np.concatenate(c), len(distinct)).astype(np.int64) for c in (kept, deleted)]
    cut = np.cumsum([len(k) for k in keys])[:-1]
    return sums, [np.split(s[at], cut) for s in sums]


def _answer(key, pdf: pd.DataFrame) -> pd.DataFrame:
    """All messages of one part -> their keys' totals, message by message, and the part's types and tokens."""

    def pair_keys(b):
        out = np.zeros((len(b) // 6, 8), np.uint8)
        out[:, :6] = np.frombuffer(b, np.uint8).reshape(-1, 6)
        return out.view("<u8").ravel()

    (word_kept, word_deleted), words = _total([np.frombuffer(b, "<u8") for b in pdf["words"]], *([unpack(b) for b in pdf[c]] for c in ("word_kept", "word_deleted")))
    _, pairs = _total([pair_keys(b) for b in pdf["pairs"]], *([unpack(b) for b in pdf[c]] for c in ("pair_kept", "pair_deleted")))
    out = pd.DataFrame({"part": pdf["part"], "shard": pdf["shard"], "word_kept": list(map(pack, words[0])), "word_deleted": list(map(pack, words[1])), "pair_kept": list(map(pack, pairs[0])), "pair_deleted": list(map(pack, pairs[1])), "types": 0, "kept": 0, "deleted": 0})
    out.loc[out.index[0], ["types", "kept", "deleted"]] = [int((word_kept + word_deleted > 0).sum()), int(word_kept.sum()), int(word_deleted.sum())]
    return out


def _shard(out_dir: str, name: str) -> dict:
    fs, base = filesystem(out_dir)
    with fs.open_input_stream(f"{base}/{name}") as source:
        row = pa.ipc.open_stream(source).read_all().to_pylist()[0]
    return {k: unpack(row[k]) for k in ("ids", "lens", "roles")} | {"docs": np.frombuffer(row["docs"], np.int64), "short": np.frombuffer(row["short"], np.uint32)}


def bucket_of(c: np.ndarray) -> np.ndarray:
    """0 for a context never seen, then one bucket a power of two."""
    return np.minimum(np.frexp(c.astype(np.float64))[1], BUCKETS - 1)


def _bins(p: np.ndarray) -> np.ndarray:
    """Bins of a probability by its logarithm; -1 for 0."""
    return np.where(p > 0, np.minimum(-np.log10(np.where(p > 0, p, 1)) * BIN, 20 * BIN).astype(np.int64), -1)


def _note(out_dir: str, parts: int, n_kept: int):
    def note(key, pdf: pd.DataFrame) -> pd.DataFrame:
        """A shard's answers -> totals by word and by pair, and the shard's share of the held-out counts, binned."""
        s = _shard(out_dir, key[0])
        pdf = pdf.sort_values("part")
        word_part, word_order, u, w, at, pair_part, pair_order = _parts(s["ids"], s["short"], parts)
        total = {}
        for c, order in (("word_kept", word_order), ("word_deleted", word_order), ("pair_kept", pair_order), ("pair_deleted", pair_order)):
            total[c] = np.zeros(len(order), np.int64)
            total[c][order] = np.concatenate([unpack(b) for b in pdf[c]])
        rows = [pd.DataFrame({"shard": [key[0]], "words": [pack(total["word_kept"] + total["word_deleted"])], "pairs": [pack(total["pair_kept"] + total["pair_deleted"])]})]
        held = at[np.repeat(s["roles"], s["lens"]) == DELETED]
        if len(held):
            context = total["word_kept"][u[held]]
            p2 = total["pair_kept"][held] / np.maximum(context, 1)
            p1 = total["word_kept"][w[held]] / max(n_kept, 1)
            cells = pd.DataFrame({"bucket": bucket_of(context), "bin2": _bins(p2), "bin1": _bins(p1), "n": 1, "sum2": p2, "sum1": p1})
            rows.append(cells.groupby(["bucket", "bin2", "bin1"], as_index=False).sum())
        return pd.concat(rows).reindex(columns=[f.split()[0] for f in NOTED.split(", ")]).astype({c: "Int64" for c in ("bucket", "bin2", "bin1", "n")})

    return note


def em_weights(cells: pd.DataFrame, uniform: float, rounds: int = 60) -> np.ndarray:
    """Weights (buckets x [bigram, unigram, uniform]) that make the held-out counts most probable.

    A bucket without held-out tokens takes the weights of all buckets together; no weight falls under 1e-6.
    """

    def learn(c):
        if not len(c):
            return np.array([0.5, 0.4, 0.1])
        n = c["n"].to_numpy(float)
        p = np.stack([c["sum2"] / n, c["sum1"] / n, np.full(len(c), uniform)], axis=1)
        weights = np.full(3, 1 / 3)
        for _ in range(rounds):
            share = p * weights
            weights = (share / share.sum(axis=1, keepdims=True) * n[:, None]).sum(axis=0) / n.sum()
            weights = np.maximum(weights, 1e-6)
            weights /= weights.sum()
        return weights

    whole = learn(cells)
    return np.array([learn(own) if len(own := cells[cells["bucket"] == b]) else whole for b in range(BUCKETS)])


def _score(out_dir: str, parts: int, n: int, types: int, weights: np.ndarray):
    def score(batches):
        for pdf in batches:
            for name, words, pairs in zip(pdf["shard"], pdf["words"], pdf["pairs"]):
                s = _shard(out_dir, name)
                _, _, u, w, at, _, _ = _parts(s["ids"], s["short"], parts)
                word, pair = unpack(words), unpack(pairs)
                lam = weights[bucket_of(word[u])]
                p = lam[:, 0] * pair / np.maximum(word[u], 1) + lam[:, 1] * word[w] / max(n, 1) + lam[:, 2] / (types + 1)
                start = np.cumsum(s["lens"]) - s["lens"]
                sums = lambda x: np.add.reduceat(x, start)
                own = word[s["ids"]]
                yield pd.DataFrame({
                    "doc_id": pd.array(s["docs"], "Int64").copy() if not (s["docs"] == NO_ID).any() else pd.array([None if i == NO_ID else i for i in s["docs"].tolist()], "Int64"),
                    "held_out": s["roles"] == TEST, "n_tokens": s["lens"], "n_known": sums((own > 0).astype(np.int64)), "train_tokens": n,
                    "base_score": sums(np.log10((own + 1) / (n + types + 1))), "score": sums(np.log10(p)[at]),
                })

    return score


def score_documents(docs: DataFrame, held_out: Column, deleted: Column, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = 8 << 20, part_bytes: int = 4 << 20) -> DataFrame:
    """One row a document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10, whole texts).

    The model learns from documents that aren't ``held_out``; its weights from those of them that are ``deleted``.
    base_score is the add-one unigram score. Null texts are empty (one token, the end), null conditions false, repeated
    rows count and score each; texts of any length are one document of one shard; other columns don't matter. An empty table gives no rows, and without training
    documents every token has the uniform share. Ids must be integers. A task that runs again must meet the same rows in
    the same order, so ``docs`` should be a scan of files or a table written before, not a shuffle's output.
    """
    spark = small_batches(docs.sparkSession)
    role = F.when(F.coalesce(held_out, F.lit(False)), TEST).when(F.coalesce(deleted, F.lit(False)), DELETED).otherwise(KEPT)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), role.alias("role"), F.col(text_col).cast("binary").alias("text"))
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // part_bytes)
    out_dir = scratch(spark, "lm-shards")

    messages = rows.mapInArrow(lambda batches: _cut(batches, out_dir, parts, shard_bytes), MESSAGE)
    answers = materialise(messages.groupBy("part").applyInPandas(_answer, ANSWER), "lm-answers")
    counted = answers.agg(F.sum("types"), F.sum("kept"), F.sum("deleted")).first()
    types, kept, gone = (x or 0 for x in counted)
    note = _note(out_dir, parts, kept)
    noted = materialise(answers.select("part", "shard", "word_kept", "word_deleted", "pair_kept", "pair_deleted").groupBy("shard").applyInPandas(note, NOTED), "lm-noted")
    # at most BUCKETS x (20 BIN + 2)^2 cells, whatever the corpus
    cells = noted.filter(F.col("n").isNotNull()).groupBy("bucket", "bin2", "bin1").agg(F.sum("n").alias("n"), F.sum("sum2").alias("sum2"), F.sum("sum1").alias("sum1"))
    weights = em_weights(cells.orderBy("bucket", "bin2", "bin1").toPandas(), 1 / (types + 1))
    shards = noted.filter(F.col("words").isNotNull()).select("shard", "words", "pairs")
    schema = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    # a number of its own: a row stands for a shard's whole work; many shards share a task where there are very many
    return shards.repartition(max(1, min(shards.count(), 50_000))).mapInPandas(_score(out_dir, parts, kept + gone, types, weights), schema)


def op6_lm_scoring(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    part = crc_mod(F.col("doc_id"), 7)
    return score_documents(docs, part == 2, part == 3)
