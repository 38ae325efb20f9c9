"""Token files: ids of many documents as one array, document boundaries in Elias-Fano code.

A file holds the concatenated ids (two bytes each while the vocabulary allows, else four), then two Elias-Fano
sequences (the ends of the documents in the array, and the document ids), then a footer. An Elias-Fano sequence of n
non-decreasing values below u takes some 2 + log2(u / n) bits a value: the low bits are stored as they are, the high
bits in unary, and the place of every 256th one is kept in 32 bits, so that select(k) reads a few words.

Documents are cut into shards by ranges of (id, hash of the text), in ascending order; a shard's task writes one file
under a temporary name, a manifest names the files of successful tasks, a second job renames them. A file's first
offset in the whole corpus is in the manifest, so every offset is known without 64-bit tables.
"""

from __future__ import annotations

import hashlib
import itertools
import os
import re
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import filesystem, materialise, scratch, small_batches
from .shards import plan_shards, shard_column

MAGIC, MANIFEST, EVERY = b"LLTOKEF1", "manifest", 256
_FOOTER = struct.Struct("<8q8s")  # width, n ids, n documents, null ids, least id, bytes of ends, bytes of ids' code, reserved, magic
#: Characters after which a long text is cut where it can be.
BLOCK = 1 << 16


class EliasFano:
    """A non-decreasing sequence of integers from 0 on in near-minimal space."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, places: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.places = n, low_bits, low, high, places

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n, u = len(values), int(values[-1]) + 1 if len(values) else 1
        low_bits = max(0, (u // max(n, 1)).bit_length() - 1)
        shifts = np.arange(low_bits, dtype=np.uint64)
        low = np.packbits(((values[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
        ones = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros((int(ones[-1]) + 1 if n else 0), np.uint8)
        bits[ones] = 1
        return cls(n, low_bits, low, np.packbits(bits, bitorder="little"), ones[::EVERY].astype(np.uint32))

    def select(self, k: int) -> int:
        """Where the k-th one of the high bits stands."""
        at = int(self.places[k // EVERY])
        left, byte = k % EVERY, at >> 3
        if not left:
            return at
        left += int(np.bitwise_count(self.high[byte] & np.uint8((1 << (at & 7)) - 1)))  # ones before the place in its byte
        while True:
            counts = np.cumsum(np.bitwise_count(self.high[byte : byte + 64]), dtype=np.int64)
            if counts[-1] > left:
                k = int(np.searchsorted(counts, left, "right"))
                left -= int(counts[k - 1]) if k else 0
                bits = np.flatnonzero(np.unpackbits(self.high[byte + k : byte + k + 1], bitorder="little"))
                return ((byte + k) << 3) + int(bits[left])
            left -= int(counts[-1])
            byte += 64

    def _lows(self, a: int, b: int) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(b - a, np.uint64)
        first = a * self.low_bits
        bits = np.unpackbits(self.low[first >> 3 : (b * self.low_bits + 7) >> 3], bitorder="little")[first & 7 :][: (b - a) * self.low_bits]
        return (bits.reshape(-1, self.low_bits).astype(np.uint64) << np.arange(self.low_bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)

    def __getitem__(self, k: int) -> int:
        if not 0 <= k < self.n:
            raise IndexError(k)
        return (self.select(k) - k << self.low_bits) | int(self._lows(k, k + 1)[0])

    def slice(self, a: int, b: int) -> np.ndarray:
        """Values a to b (b not included): one select, then the bits from there on."""
        if a >= b:
            return np.empty(0, np.int64)
        first, last = self.select(a), self.select(b - 1)
        bits = np.unpackbits(self.high[first >> 3 : (last >> 3) + 1], bitorder="little")
        ones = np.flatnonzero(bits[first & 7 :])[: b - a] + first
        return (((ones - np.arange(a, b)).astype(np.uint64) << np.uint64(self.low_bits)) | self._lows(a, b)).astype(np.int64)

    def to_bytes(self) -> bytes:
        head = struct.pack("<5q", self.n, self.low_bits, len(self.low), len(self.high), len(self.places))
        return head + self.low.tobytes() + self.high.tobytes() + self.places.astype("<u4").tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> EliasFano:
        n, low_bits, a, b, c = struct.unpack_from("<5q", data)
        at = np.cumsum([40, a, b])
        return cls(n, low_bits, np.frombuffer(data, np.uint8, a, at[0]), np.frombuffer(data, np.uint8, b, at[1]), np.frombuffer(data, "<u4", c, at[2]))


class TokenFile:
    """One file: offsets by select, ids by a range of the array."""

    def __init__(self, stream, size: int):
        self.stream = stream
        stream.seek(size - _FOOTER.size)
        self.width, self.n_ids, self.n, self.nulls, self.least, ends, ids, _, magic = _FOOTER.unpack(stream.read(_FOOTER.size))
        if magic != MAGIC or size != len(MAGIC) + self.width * self.n_ids + ends + ids + _FOOTER.size:
            raise ValueError("not a whole token file")
        stream.seek(size - _FOOTER.size - ends - ids)
        self.ends, self.keys = EliasFano.from_bytes(stream.read(ends)), EliasFano.from_bytes(stream.read(ids))
        self.type = np.dtype(f"<u{self.width}")

    def span(self, k: int) -> tuple[int, int]:
        return (self.ends[k - 1] if k else 0), self.ends[k]

    def ids(self, a: int, b: int) -> np.ndarray:
        self.stream.seek(len(MAGIC) + a * self.width)
        return np.frombuffer(self.stream.read((b - a) * self.width), self.type)

    def documents(self, step: int = 4096):
        """(id or None, start, end) of all documents in order."""
        for a in range(0, self.n, step):
            b, starts = min(self.n, a + step), self.ends.slice(max(a - 1, 0), min(self.n, a + step))
            starts = starts if a else np.r_[0, starts]
            keys = self.keys.slice(max(a - self.nulls, 0), max(b - self.nulls, 0))
            for k in range(a, b):
                yield (None if k < self.nulls else int(keys[k - max(a, self.nulls)]) + self.least), int(starts[k - a]), int(starts[k - a + 1])


LETTER, NUMBER, OTHER, SPACE, BREAK = range(5)
PLANES = 0x20000  # code points whose class is looked up; texts with others go to the library whole


def character_classes(path: str) -> bytes | None:
    """The class that the library's own splitter gives each of the first code points; None if the model isn't byte-level without a normaliser.

    Read off the borders that the library draws around each character beside a letter, a digit and a mark.
    """
    from tokenizers import Tokenizer, pre_tokenizers

    tok = Tokenizer.from_file(path)
    pre = tok.pre_tokenizer
    if not isinstance(pre, pre_tokenizers.ByteLevel) or pre.add_prefix_space or not pre.use_regex or tok.normalizer is not None:
        return None
    codes = np.array([c for c in range(PLANES) if not 0xD800 <= c < 0xE000])
    starts = np.zeros(7 * len(codes) + 1, bool)
    for k in range(0, len(codes), 4096):  # blocks: each unit begins with a letter after a mark, so none reaches into the next
        text = "".join(f"a{chr(c)}1{chr(c)}!{chr(c)}." for c in codes[k : k + 4096])
        starts[[7 * k + x for _, (x, _) in pre.pre_tokenize_str(text)]] = True
    unit = starts[:-1].reshape(-1, 7)
    out = np.full(PLANES, OTHER, np.uint8)
    out[codes] = np.select([~unit[:, 1], ~unit[:, 2] & ~unit[:, 3], ~unit[:, 5]], [LETTER, NUMBER, OTHER], SPACE)
    out[0x20] = SPACE
    return out.tobytes()


def split_starts(codes: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Where tokens of the byte-level split begin: runs of letters, numbers or marks, each with one blank before it, short
    forms such as 's after anything but a mark or blank, and other runs of white space without the character before a word."""
    start = np.ones(len(codes), bool)
    start[1:] = (kinds[1:] != kinds[:-1]) | (kinds[1:] == BREAK)
    last = np.flatnonzero((kinds[:-1] == SPACE) & (kinds[1:] < SPACE))
    start[last] = True
    start[last[codes[last] == 0x20] + 1] = False
    at = np.flatnonzero((codes == 0x27) & start)
    ahead = np.r_[codes, np.zeros(3, codes.dtype)]
    one, two = ahead[at + 1], ahead[at + 1].astype(np.int64) << 16 | ahead[at + 2]
    for hit, n in ((np.isin(one, [ord(c) for c in "stmd"]), 2), (np.isin(two, [ord(a) << 16 | ord(b) for a, b in ("re", "ve", "ll")]), 3)):
        some = at[hit]
        start[some + 1] = False
        start[(some + n)[some + n < len(start)]] = True
    return start


class Encoder:
    """Ids of texts by a byte-level tokenizer of the tokenizers library.

    Byte-level models encode every match of one split pattern by itself. So batches of texts are split in arrays, the
    library encodes distinct matches once each, and the texts' ids are gathered. Texts with a character that has no
    known class, and all texts of other models, go to the library whole.
    """

    def __init__(self, path: str, classes: bytes | None, most_known: int = 1 << 19):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True  # their names in a text are text
        self.part = Tokenizer.from_str(self.whole.to_str())
        self.part.encode_special_tokens = True
        if classes:
            self.part.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.kinds = np.frombuffer(classes, np.uint8) if classes else None
        self.cut = re.compile(r"(?<=[!-~])(?= [A-Za-z])").search
        self.most = most_known
        self._clear()

    def _clear(self):
        self.known, self.flat, self.starts, self.sizes, self.letters = {}, np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64), 0

    def _learn(self, words: list[bytes]):
        lists = [e.ids for e in self.part.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)]
        sizes = np.array([len(x) for x in lists], np.int64)
        for w in words:
            self.known[w] = len(self.known)
        self.starts = np.r_[self.starts, len(self.flat) + np.cumsum(sizes) - sizes]
        self.sizes = np.r_[self.sizes, sizes]
        self.flat = np.r_[self.flat, np.fromiter(itertools.chain.from_iterable(lists), np.uint32, int(sizes.sum()))]
        self.letters += sum(map(len, words))

    def _blocks(self, text: str):
        """The text in blocks; no token crosses a blank between a visible character and a letter."""
        a = 0
        while len(text) - a > BLOCK:
            m = self.cut(text, a + BLOCK)
            if not m:
                break
            yield text[a : m.start()]
            a = m.start()
        yield text[a:]

    def _some(self, blocks: list[str]) -> list[np.ndarray]:
        joined = "\n".join(blocks) + "\n"
        codes = np.frombuffer(joined.encode("utf-32-le"), "<u4")
        ends = np.cumsum([len(x) + 1 for x in blocks]) - 1
        if self.kinds is None or int(codes.max()) >= PLANES:
            odd = [k for k, x in enumerate(blocks) if self.kinds is None or (x and ord(max(x)) >= PLANES)]
            out = dict(zip(odd, ([np.array(self.whole.encode(blocks[k], add_special_tokens=False).ids, np.uint32) for k in odd])))
            rest = [k for k in range(len(blocks)) if k not in out]
            out |= dict(zip(rest, self._some([blocks[k] for k in rest]))) if rest else {}
            return [out[k] for k in range(len(blocks))]
        kinds = self.kinds[codes]
        kinds[ends] = BREAK
        at = np.flatnonzero(split_starts(codes, kinds))
        size = np.ones(len(codes), np.uint8)
        for edge in (0x80, 0x800, 0x10000):
            size += codes >= edge
        bytes_before = np.r_[0, np.cumsum(size, dtype=np.int64)]
        offsets = np.r_[bytes_before[at], bytes_before[-1]].astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(joined.encode())])
        coded = words.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        if len(self.known) > self.most or self.letters > 16 * self.most:
            self._clear()
        if new := [w for w in distinct if w not in self.known]:
            self._learn(new)
        own = np.fromiter(map(self.known.__getitem__, distinct), np.int64, len(distinct))[coded.indices.to_numpy()]
        sizes = self.sizes[own]
        sizes[np.searchsorted(at, ends)] = 0  # the line ends between texts
        total = np.cumsum(sizes)
        ids = self.flat[np.repeat(self.starts[own] - total + sizes, sizes) + np.arange(total[-1])]
        return np.split(ids, total[np.searchsorted(at, ends)][:-1])

    def encode(self, texts, at_once: int = 1 << 20):
        """For each text its ids, in order; long texts in blocks, some 10^6 characters at once."""
        held: list[str] = []
        size, pieces = 0, []  # pieces: how many blocks each waiting text has

        def run():
            done, k = self._some(held), 0
            for n in pieces:
                yield np.concatenate(done[k : k + n]) if n > 1 else done[k]
                k += n

        for text in texts:
            blocks = list(self._blocks(text))
            if len(text) > at_once:  # by itself, a few blocks at a time
                if pieces:
                    yield from run()
                parts = [p for k in range(0, len(blocks), 16) for p in self._some(blocks[k : k + 16])]
                yield np.concatenate(parts)
                held, size, pieces = [], 0, []
                continue
            held += blocks
            pieces.append(len(blocks))
            size += len(text)
            if size >= at_once:
                yield from run()
                held, size, pieces = [], 0, []
        if pieces:
            yield from run()


_ENCODERS: dict[str, Encoder] = {}
_CLASSES: dict[str, bytes | None] = {}


def encoder(path: str, classes: bytes | None) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path, classes)
    return _ENCODERS[path]


def classes_of(path: str) -> bytes | None:
    if path not in _CLASSES:
        _CLASSES[path] = character_classes(path)
    return _CLASSES[path]


def public_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


MANIFEST_FIELDS = {"temp": pa.string(), "file": pa.string(), "shard": pa.int64(), "documents": pa.int64(), "ids": pa.int64(), "bytes": pa.int64(), "sha1": pa.string()}
_SQL = {pa.string(): "string", pa.int64(): "bigint"}
SCHEMA = ", ".join(f"{k} {_SQL[t]}" for k, t in MANIFEST_FIELDS.items())


class _Writer:
    """A shard's file under a temporary name; keeps two integers a document until the file is closed."""

    def __init__(self, fs, base: str, shard: int, width: int):
        self.temp, self.shard, self.width, self.sum, self.size = f"_temporary/{uuid.uuid4().hex}.tok", shard, width, hashlib.sha1(), 0
        self.out = fs.open_output_stream(f"{base}/{self.temp}", compression=None)
        self.ends, self.keys, self.nulls, self.at = [], [], 0, 0
        self._put(MAGIC)

    def _put(self, data: bytes):
        self.out.write(data)
        self.sum.update(data)
        self.size += len(data)

    def add(self, key, ids: np.ndarray):
        self._put(ids.tobytes())
        self.at += len(ids)
        self.ends.append(self.at)
        if key is None:
            self.nulls += 1
        else:
            self.keys.append(key)

    def close(self):
        least = self.keys[0] if self.keys else 0
        ends = EliasFano.of(np.array(self.ends, np.int64)).to_bytes()
        keys = EliasFano.of(np.array([k - least for k in self.keys], np.uint64)).to_bytes()
        self._put(ends + keys + _FOOTER.pack(self.width, self.at, len(self.ends), self.nulls, least, len(ends), len(keys), 0, MAGIC))
        self.out.close()
        return (self.temp, f"part-{self.shard:07d}.tok", self.shard, len(self.ends), self.at, self.size, self.sum.hexdigest())


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), MANIFEST_FIELDS.values())], list(MANIFEST_FIELDS))


def write_tokens(docs: DataFrame, out_dir: str, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, rows_per_shard: int = 1 << 20, verify_every: int = 256) -> DataFrame:
    """Encode every whole text, add ``end_id`` after each document and write the files; returns the manifest.

    Documents stand in ascending order of id (null first), rows that repeat an id in the order of their text's hash and
    ids. A null text is an empty one: only the end id. Ids must be integers; other columns don't matter. An empty table
    gives a manifest without rows. Files are the same whatever the partitions, executors or retries.
    ``path`` is a file of the tokenizers library, read on the driver's and the executors' machines alike. Texts whose
    crc32 ``verify_every`` divides are also encoded whole by the library; a difference ends the job.
    """
    spark = small_batches(docs.sparkSession)
    path = path or public_vocabulary()
    from tokenizers import Tokenizer

    width = 2 if max(Tokenizer.from_file(path).get_vocab_size(True), end_id + 1) <= 1 << 16 else 4
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    plan = plan_shards(rows.select("id", (F.octet_length("text") + 8).cast("bigint").alias("weight")), rows_per_shard)
    sent = spark.sparkContext.broadcast(plan)

    model = spark.sparkContext.broadcast(classes_of(path))

    @F.arrow_udf("binary")
    def encoded(text: pa.Array) -> pa.Array:
        own, out = encoder(path, model.value), []
        end = np.array([end_id], np.uint32)
        for x, ids in zip(text, own.encode(t.as_py() for t in text)):
            if verify_every and zlib.crc32(b := x.as_py().encode()) % verify_every == 0 and own.whole.encode(b.decode(), add_special_tokens=False).ids != ids.tolist():
                raise ValueError(f"encoded in another way than by the library: {x.as_py()[:200]!r}")
            whole = np.concatenate([ids, end]).astype(f"<u{width}")
            out.append(whole.view(np.uint8).reshape(-1, width).T.tobytes())  # bytes by significance: they shrink more in a shuffle
        return pa.array(out, pa.binary())

    dealt = rows.withColumn("h", F.xxhash64("text")).withColumn("shard", shard_column(plan, sent, F.col("id"), F.col("h")))
    dealt = dealt.select("shard", "id", "h", encoded("text").alias("ids")).repartitionById(plan.shards, "shard")
    dealt = dealt.sortWithinPartitions("shard", F.col("id").asc_nulls_first(), "h", "ids")

    def write(batches):
        fs, base = filesystem(out_dir)
        fs.create_dir(f"{base}/_temporary", recursive=True)
        writer = None
        for b in batches:
            shards, keys, ids = (b.column(b.schema.get_field_index(c)) for c in ("shard", "id", "ids"))
            for k in range(b.num_rows):
                if writer is None or writer.shard != shards[k].as_py():
                    if writer:
                        yield _rows([writer.close()])
                    writer = _Writer(fs, base, shards[k].as_py(), width)
                raw = np.frombuffer(ids[k].as_buffer(), np.uint8).reshape(width, -1)
                writer.add(keys[k].as_py(), np.ascontiguousarray(raw.T).view(f"<u{width}").ravel())
        if writer:
            yield _rows([writer.close()])

    def rename(batches):
        fs, base = filesystem(out_dir)
        for b in batches:
            for r in b.to_pylist():
                if fs.get_file_info(f"{base}/{r['temp']}").size == r["bytes"]:
                    fs.move(f"{base}/{r['temp']}", f"{base}/{r['file']}")
                elif fs.get_file_info(f"{base}/{r['file']}").size != r["bytes"]:
                    raise OSError(f"neither {r['temp']} nor {r['file']} is whole")
            yield b

    written = materialise(dealt.mapInArrow(write, SCHEMA), "token-files").mapInArrow(rename, SCHEMA).drop("temp")
    done = materialise(written, "token-renamed").orderBy("shard").toPandas()  # a row a file of 8 MB and more
    done["first"] = (done["ids"].cumsum() - done["ids"]).astype("int64")
    kept = spark.createDataFrame(done.to_dict("records"), "file string, shard bigint, documents bigint, ids bigint, bytes bigint, sha1 string, first bigint")
    kept.coalesce(1).write.parquet(f"{out_dir}/{MANIFEST}")
    return spark.read.parquet(f"{out_dir}/{MANIFEST}")


def read_tokens(spark: SparkSession, out_dir: str, ids: bool = False) -> DataFrame:
    """Documents of the files in the manifest: doc_id, start (ids before it in the corpus), n_tokens, ids_crc32, and the ids if asked for."""
    fields = {"doc_id": pa.int64(), "start": pa.int64(), "n_tokens": pa.int64(), "ids_crc32": pa.int64()} | ({"ids": pa.list_(pa.int32())} if ids else {})
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<int>" * ids

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), fields.values())], list(fields))

    def read(batches):
        fs, base = filesystem(out_dir)
        for b in batches:
            for r in b.to_pylist():
                info = fs.get_file_info(f"{base}/{r['file']}")
                if info.size != r["bytes"]:
                    raise ValueError(f"{r['file']} has {info.size} bytes, not {r['bytes']}")
                with fs.open_input_file(f"{base}/{r['file']}") as stream:
                    f, rows, held = TokenFile(stream, info.size), [], 0
                    if (f.n, f.n_ids) != (r["documents"], r["ids"]):
                        raise ValueError(f"{r['file']} holds other documents than the manifest says")
                    for key, a, e in f.documents():
                        crc, parts = 0, []
                        for k in range(a, e, 1 << 20):
                            x = f.ids(k, min(e, k + (1 << 20)))
                            crc = zlib.crc32(x.astype("<u4").tobytes(), crc)
                            parts += [x.astype(np.int32)] if ids else []
                        rows.append((key, r["first"] + a, e - a, crc, *([np.concatenate(parts)] if ids else [])))
                        held += (e - a) * ids + 1
                        if held > 1 << 16:
                            yield batch(rows)
                            rows, held = [], 0
                    if rows:
                        yield batch(rows)

    files = spark.read.parquet(f"{out_dir}/{MANIFEST}")
    return files.repartition(max(1, min(files.count(), 50_000))).mapInArrow(read, schema)


def op11_token_files(spark, sf_dir):
    out = scratch(spark, "tokens")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), out)
    return read_tokens(spark, out)
