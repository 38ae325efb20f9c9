"""Phrase collocations by prefix-free parsing.

Texts are cut into pieces at punctuation and pieces into words. A piece is parsed into chunks that begin at its start
and at every trigger word (one whose hash says so); a chunk runs to the next trigger and on for as many words as a
phrase is longer than one, so each phrase occurrence starts in the counted part of just one chunk. The dictionary of distinct
chunks and their frequencies is one Spark aggregate: copies and common passages are counted once, by weight.

Phrases are then counted level by level inside distinct chunks. A phrase of k words can be frequent only if both
phrases of k - 1 words in it are; so a level counts pairs of neighbouring frequent phrases, numbered by the level before.
Numbers go to the tasks by broadcast up to a checked size; beyond it they are joined back to the rows that hold the chunks.
Counts are exact: words are compared as they are, phrases by the numbers of their parts.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import materialise, small_batches

TRIGGER = 32  # one word in so many begins a chunk
LONGEST = 5
#: Positions in one row of the parsed corpus; 12 bytes each.
ROW_POSITIONS = 300_000
#: Frequent phrases of a level that are sent to tasks; more are joined.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 64 << 20
#: Class of each byte: 0 in a word, 1 blank, 2 border of pieces; and its lower-case form (A-Z only).
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], ..., starts[0] + sizes[0] - 1, starts[1], ...: indices of many ranges one after another."""
    total = np.cumsum(sizes)
    return np.repeat(starts - total + sizes, sizes) + np.arange(total[-1] if len(total) else 0)


def words_of(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lower-cased bytes, start of each word, its size, the number of its piece)."""
    raw = _LOWER[np.frombuffer(data, np.uint8)]
    kind = _KIND[raw]
    inside = np.r_[False, kind == 0, False]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    return raw, starts, ends - starts, np.cumsum(kind == 2)[starts] if len(starts) else starts


def coded(raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Each word as an index into the distinct words."""
    data = raw[ragged(starts, sizes)]
    offsets = np.r_[0, np.cumsum(sizes)].astype(np.int64)
    array = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
    return array.indices.to_numpy(), array.dictionary.to_pylist()


def is_trigger(words: list[bytes]) -> np.ndarray:
    return np.fromiter((zlib.crc32(w) % TRIGGER == 0 for w in words), bool, len(words))


def chunks_of(data: bytes, longest: int = LONGEST) -> tuple[pa.Array, np.ndarray]:
    """(chunks as space-ended words, where in ``data`` each one starts)."""
    raw, starts, sizes, piece = words_of(data)
    if not len(starts):
        return pa.array([], pa.string()), starts
    index, distinct = coded(raw, starts, sizes)
    first = np.r_[True, piece[1:] != piece[:-1]]
    begins = np.flatnonzero(first | is_trigger(distinct)[index])
    piece_ends = np.r_[np.flatnonzero(first)[1:], len(starts)][np.cumsum(first) - 1]
    ends = np.minimum(np.r_[begins[1:], len(starts)] + longest - 1, piece_ends[begins])
    # words of all chunks, each with the byte after it, which becomes a space
    word = ragged(begins, ends - begins)
    spaced = sizes[word] + 1
    at = ragged(starts[word], spaced)
    text = np.append(raw, np.uint8(32))[at]
    text[np.cumsum(spaced) - 1] = 32
    offsets = np.r_[0, np.cumsum(np.add.reduceat(spaced, np.cumsum(ends - begins) - (ends - begins)))].astype(np.int64)
    return pa.Array.from_buffers(pa.large_string(), len(begins), [None, pa.py_buffer(offsets), pa.py_buffer(text)]).cast(pa.string()), starts[begins]


def parse(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = LONGEST) -> DataFrame:
    """docs -> the dictionary: lang, chunk, freq; one row a distinct chunk of a language."""

    def cut(batches):
        for b in batches:
            langs, held, size, some = b.column(0), [], 0, []
            for k in range(b.num_rows):
                data = b.column(1)[k].as_buffer()
                held.append(data.to_pybytes())
                some.append(k)
                size += len(data)
                if size >= 1 << 20 or k == b.num_rows - 1:
                    chunks, at = chunks_of(b"\n".join(held), longest)  # a line end is a border of pieces
                    doc = np.searchsorted(np.cumsum([len(x) + 1 for x in held]), at, "right")
                    yield pa.RecordBatch.from_arrays([langs.take(pa.array(np.array(some)[doc])), chunks], ["lang", "chunk"])
                    held, size, some = [], 0, []

    small_batches(docs.sparkSession)
    own = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    return own.mapInArrow(cut, "lang string, chunk string").groupBy("lang", "chunk").agg(F.count("*").alias("freq"))


PARSED = "shard bigint, level int, ids binary, weights binary, langs array<string>, words array<binary>, lang_of binary, numbers binary"


def _parsed(level, ids, weights, langs=(), words=(), lang_of=b"", numbers=b"") -> dict:
    return {"level": level, "ids": ids.astype(np.int32).tobytes(), "weights": weights, "langs": list(langs), "words": list(words), "lang_of": lang_of, "numbers": numbers}


_PARSED_ARROW = pa.schema([("shard", pa.int64()), ("level", pa.int32()), ("ids", pa.binary()), ("weights", pa.binary()), ("langs", pa.list_(pa.string())), ("words", pa.list_(pa.binary())), ("lang_of", pa.binary()), ("numbers", pa.binary())])


def arrange(dictionary: DataFrame, longest: int = LONGEST, row_positions: int = ROW_POSITIONS) -> DataFrame:
    """Distinct chunks as rows of arrays: at each position the word's index in the row (-1 between chunks) and the chunk's frequency, 0 in its overlap."""

    def rows(batches):
        from pyspark import TaskContext

        base, seq, held, size = TaskContext.get().partitionId() << 32, 0, [], 0
        for b in batches:
            for k in range(0, b.num_rows, 65536):
                held.append(b.slice(k, 65536))
                size += held[-1].column(1).nbytes // 6
                if size >= row_positions:
                    yield pa.RecordBatch.from_pylist([row(held) | {"shard": base + seq}], _PARSED_ARROW)
                    held, size, seq = [], 0, seq + 1
                    pa.default_memory_pool().release_unused()
        if held:
            yield pa.RecordBatch.from_pylist([row(held) | {"shard": base + seq}], _PARSED_ARROW)

    def row(held):
        t = pa.Table.from_batches(held)
        langs = t.column("lang").combine_chunks().dictionary_encode()
        lang_at, lang_names = langs.indices.to_numpy(), langs.dictionary.to_pylist()
        order = np.argsort(lang_at, kind="stable")
        texts = pc.cast(t.column("chunk"), pa.large_string()).combine_chunks().take(pa.array(order))
        freq = t.column("freq").to_numpy()[order]
        lang_at = lang_at[order]
        raw = np.frombuffer(texts.buffers()[2], np.uint8)[: len(texts.buffers()[2])]
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[: len(texts) + 1]
        raw, offsets = raw[offsets[0] : offsets[-1]], offsets - offsets[0]
        ends = np.flatnonzero(raw == 32)  # every word has a space behind it
        starts = np.r_[0, ends[:-1] + 1]
        chunk = np.searchsorted(offsets, starts, "right") - 1
        ids, words, word_lang, trig = np.empty(len(starts), np.int64), [], [], []
        for x in range(len(lang_names)):  # words are numbered by language
            mine = np.flatnonzero(lang_at[chunk] == x)
            index, distinct = coded(raw, starts[mine], (ends - starts)[mine])
            ids[mine] = index + len(words)
            words += distinct
            trig.append(is_trigger(distinct))
            word_lang.append(np.full(len(distinct), x, np.int32))
        begin = np.flatnonzero(np.r_[True, chunk[1:] != chunk[:-1]])
        fire = np.concatenate(trig)[ids]
        fire[begin] = False
        # how many triggers come before a position in its chunk: the counted part has none, the first one included
        before = np.cumsum(fire)
        before = before - before[begin][np.cumsum(np.r_[True, chunk[1:] != chunk[:-1]]) - 1]
        weight = np.where(before == 0, freq[chunk], 0)
        gap = np.arange(len(starts)) + chunk  # a place between chunks
        all_ids, all_weights = np.full(len(starts) + len(freq), -1, np.int64), np.zeros(len(starts) + len(freq), np.int64)
        all_ids[gap], all_weights[gap] = ids, weight
        return _parsed(0, all_ids, all_weights.tobytes(), lang_names, words, np.concatenate(word_lang).tobytes())

    return materialise(dictionary.mapInArrow(rows, PARSED), "phrases-parsed")


class _Row:
    """A row of arrays at some level: ids are local, ``numbers`` (or words) are what they stand for in the whole corpus."""

    def __init__(self, r: dict):
        self.level, self.ids, self.weights = r["level"], np.frombuffer(r["ids"], np.int32), np.frombuffer(r["weights"], np.int64)
        self.langs, self.words, self.lang_of = r["langs"], r["words"], np.frombuffer(r["lang_of"], np.int32)
        self.numbers = np.frombuffer(r["numbers"], np.int64)

    def candidates(self):
        """Sets the places of the next level's candidates; (first parts, second parts, counts) of the distinct ones, as local ids."""
        if self.level == 0:
            at = np.flatnonzero(self.ids >= 0)
            self.places, self.which = at, self.ids[at]
            first = second = np.arange(len(self.words))
        else:
            ok = (self.ids[:-1] >= 0) & (self.ids[1:] >= 0)
            at = np.flatnonzero(ok)
            pair = self.ids[at].astype(np.int64) * (len(self.numbers) + 1) + self.ids[at + 1]
            distinct, self.which = np.unique(pair, return_inverse=True)
            self.places = at
            first, second = distinct // (len(self.numbers) + 1), distinct % (len(self.numbers) + 1)
        counts = np.zeros(len(first), np.int64)
        np.add.at(counts, self.which, self.weights[self.places])
        return first, second, counts

    def advance(self, numbers: np.ndarray):
        """To the next level: the numbers of the candidates, -1 for those that aren't frequent."""
        keep = np.flatnonzero(numbers >= 0)
        local = np.full(len(numbers), -1, np.int32)
        local[keep] = np.arange(len(keep))
        ids = np.full(len(self.ids), -1, np.int32)
        ids[self.places] = local[self.which]
        held = ids >= 0  # one place stays as a gap after each run
        held[1:] |= held[:-1]
        self.ids, self.weights, self.numbers, self.level = ids[held], self.weights[held], numbers[keep], self.level + 1
        self.words, self.langs = [], []

    def keys(self, first, second):
        """What candidates are in the whole corpus."""
        if self.level == 0:
            return [self.langs[x] for x in self.lang_of], self.words
        return self.numbers[first], self.numbers[second]

    def row(self, shard) -> dict:
        return _parsed(self.level, self.ids, self.weights.tobytes(), numbers=self.numbers.tobytes()) | {"shard": shard}


class _Sent:
    """A level's frequent phrases, for look-ups in tasks."""

    def __init__(self, level: int, table):
        self.level, self.number = level, table["number"].to_numpy()
        if level == 1:
            self.of = {(a, bytes(b)): n for a, b, n in zip(table["lang"].to_pylist(), table["word"].to_pylist(), self.number)}
        else:
            p, s = table["p"].to_numpy(), table["s"].to_numpy()
            self.known = np.unique(np.r_[p, s])
            key = np.searchsorted(self.known, p) * len(self.known) + np.searchsorted(self.known, s)
            order = np.argsort(key)
            self.key, self.number = key[order], self.number[order]

    def find(self, a, b) -> np.ndarray:
        if self.level == 1:
            return np.fromiter((self.of.get(x, -1) for x in zip(a, b)), np.int64, len(a))
        if not len(self.key) or not len(a):
            return np.full(len(a), -1, np.int64)
        x, y = (np.minimum(np.searchsorted(self.known, v), len(self.known) - 1) for v in (a, b))
        hit = (self.known[x] == a) & (self.known[y] == b)
        key = x * len(self.known) + y
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(hit & (self.key[at] == key), self.number[at], -1)


def _rows(batches, sent: list):
    """(shard, row) of the batches, one at a time, brought to the level of the last of ``sent``."""
    for b in batches:
        for k in range(b.num_rows):
            r = b.slice(k, 1).to_pylist()[0]
            own = _Row(r)
            for s in sent:
                first, second, _ = own.candidates()
                own.advance(s.value.find(*own.keys(first, second)))
            yield r["shard"], own
            del r, own
            pa.default_memory_pool().release_unused()


def count_level(parsed: DataFrame, sent: list, first_level: bool) -> DataFrame:
    """Candidates of the next level in each row: shard, local, lang and word or p and s, n."""

    def run(batches):
        for shard, own in _rows(batches, sent):
            a, b, n = own.candidates()
            keys = own.keys(a, b)
            for k in range(0, len(n), 1 << 16):
                e = min(len(n), k + (1 << 16))
                cut = [pa.array(x[k:e], t) for x, t in zip(keys, (pa.string(), pa.binary()) if first_level else (pa.int64(), pa.int64()))]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(e - k, shard)), pa.array(np.arange(k, e)), *cut, pa.array(n[k:e])], ["shard", "local", *names, "n"])

    names = ("lang", "word") if first_level else ("p", "s")
    return parsed.mapInArrow(run, f"shard bigint, local bigint, {'lang string, word binary' if first_level else 'p bigint, s bigint'}, n bigint")


def _advance(parsed: DataFrame, sent: list) -> DataFrame:
    """The rows at the level of the last of ``sent``, written; only what may still grow is left of them."""

    def run(batches):
        for shard, own in _rows(batches, sent):
            if len(own.ids):
                yield pa.RecordBatch.from_pylist([own.row(shard)], _PARSED_ARROW)

    return materialise(parsed.mapInArrow(run, PARSED), "phrases-rows")


def _advance_by_join(parsed: DataFrame, sent: list, found: DataFrame) -> DataFrame:
    """The rows one level on where numbers are too many to broadcast: found(shard, local, number) meets each row by its shard."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for shard, own in _rows(left.to_batches(), sent):
            numbers = np.full(len(own.candidates()[2]), -1, np.int64)
            numbers[right.column("local").to_numpy()] = right.column("number").to_numpy()
            own.advance(numbers)
            out.append(own.row(shard))
        return pa.Table.from_pylist(out, _PARSED_ARROW)

    return materialise(parsed.groupBy("shard").cogroup(found.groupBy("shard")).applyInArrow(run, PARSED), "phrases-rows")


def frequent(docs: DataFrame, least: int, text_col: str = "text", lang_col: str = "lang", longest: int = LONGEST, broadcast_rows: int = BROADCAST_ROWS, row_positions: int = ROW_POSITIONS):
    """([level 1, level 2, ...], sizes): phrases of k words that occur ``least`` times or more, and words a language.

    A level has number, lang, phrase, last (its last word), a (its occurrences), heads and tails (occurrences of its first
    and last 1, 2, ... words), and from level 2 on p and s, the numbers of its parts of one word less.
    """
    spark = docs.sparkSession
    parsed, sent, levels, sizes = arrange(parse(docs, text_col, lang_col, longest), longest, row_positions), [], [], None
    for k in range(1, longest + 1):
        by = ["lang", "word"] if k == 1 else ["p", "s"]
        counted = count_level(parsed, sent, k == 1)
        total = counted.filter("n > 0").groupBy(*by).agg(F.sum("n").alias("a"))
        if k == 1:
            total = materialise(total, "phrases-words")
            sizes = materialise(total.groupBy("lang").agg(F.sum("a").alias("n")), "phrases-sizes")
        # the number is written with the row, so it never changes after
        table = materialise(total.filter(F.col("a") >= least).withColumn("number", F.monotonically_increasing_id()), f"phrases-{k}")
        if k == 1:
            word = F.col("word").cast("string")
            levels.append(table.select("number", "lang", word.alias("phrase"), word.alias("last"), "a", F.array("a").alias("heads"), F.array("a").alias("tails")))
        else:
            head = levels[-1].select(F.col("number").alias("p"), "lang", F.col("phrase").alias("start"), "heads")
            tail = levels[-1].select(F.col("number").alias("s"), "last", "tails")
            joined = table.join(head, "p").join(tail, "s")
            levels.append(materialise(joined.select("number", "p", "s", "lang", F.concat_ws(" ", "start", "last").alias("phrase"), "last", "a", F.concat("heads", F.array("a")).alias("heads"), F.concat("tails", F.array("a")).alias("tails")), f"phrases-of-{k}"))
        if k == longest:
            break
        size = table.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("word")), F.lit(0)) if k == 1 else F.lit(0)).first()
        if size[0] <= broadcast_rows and size[1] <= BROADCAST_BYTES:
            sent = [*sent, spark.sparkContext.broadcast(_Sent(k, table.select("number", *by).toArrow()))]
            if k == 2:  # few phrases of two words are frequent: from here on the rows are short
                parsed, sent = _advance(parsed, sent), []
        else:
            found = counted.join(table.select("number", *by), by).select("shard", "local", "number")
            parsed, sent = _advance_by_join(parsed, sent, found), []
    return levels, sizes


def score_sql(j: int, k: int) -> str:
    """floor(1000 * a * n / (l * r)) of a phrase of k words cut after j, in decimals of 38 digits: a and n below 10^17."""
    return f"(1000BD * CAST(a AS DECIMAL(17,0)) * CAST(n AS DECIMAL(17,0))) div (CAST(heads[{j - 1}] AS DECIMAL(19,0)) * CAST(tails[{k - j - 1}] AS DECIMAL(19,0)))"


def collocations(docs: DataFrame, least: int = 100, top: int = 2000, text_col: str = "text", lang_col: str = "lang", longest: int = LONGEST, **how) -> DataFrame:
    """The ``top`` phrases of each language by cohesion: lang, rank, phrase, a, l, r, n, score.

    a: occurrences; the cut into two parts with l and r occurrences that scores least, floor(1000 * a * n / (l * r)),
    counts (ties: the shortest first part). Phrases inside a longer one that occurs as often are dropped. Null texts are
    empty, a null language is ``und``, long texts are read whole, repeated rows count each time, an empty table gives an
    empty result; other columns don't matter. A piece of text without punctuation is held in memory whole.
    """
    levels, sizes = frequent(docs, least, text_col, lang_col, longest, **how)
    scored = None
    for k, level in enumerate(levels[1:], 2):
        if k < longest:  # a longer phrase that covers it holds one that is longer by a word and occurs as often
            over = levels[k].select(F.col("p").alias("number"), F.col("a").alias("over")).unionByName(levels[k].select(F.col("s").alias("number"), F.col("a").alias("over")))
            level = level.join(over.groupBy("number").agg(F.max("over").alias("over")), "number", "left").filter(F.col("over").isNull() | (F.col("over") < F.col("a")))
        some = level.join(sizes, "lang")
        cuts = []
        for j in range(1, k):
            left, right = F.col("heads")[j - 1], F.col("tails")[k - j - 1]
            cuts.append(F.struct(F.expr(score_sql(j, k)).alias("score"), F.lit(j).alias("cut"), left.alias("l"), right.alias("r")))
        best = F.array_min(F.array(*cuts)).alias("best")
        found = some.select("lang", "phrase", "a", best, "n").select("lang", "phrase", "a", "best.l", "best.r", "n", "best.score")
        scored = found if scored is None else scored.unionByName(found)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return scored.withColumn("rank", rank.cast("bigint")).filter(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_phrase_collocations(spark, sf_dir):
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP13_SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, doc_id, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p),
t AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w WHERE len(ws) > 0),
g AS (SELECT lang, k, ws[i : i + k - 1] AS g FROM t, range(1, 6) r(k) WHERE i + k - 1 <= len(ws)),
f AS (SELECT lang, k, g, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 100),
n AS (SELECT lang, count(*) AS n FROM t GROUP BY lang),
c AS (
  SELECT x.lang, x.k, x.g, x.a, l.a AS l, r.a AS r, n.n, CAST(1000::HUGEINT * x.a * n.n // (l.a::HUGEINT * r.a) AS BIGINT) AS score, l.k AS cut
  FROM f x JOIN n ON n.lang = x.lang JOIN f l ON l.lang = x.lang AND l.k < x.k AND l.g = x.g[1 : l.k] JOIN f r ON r.lang = x.lang AND r.k = x.k - l.k AND r.g = x.g[l.k + 1 : x.k]),
b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, cut) = 1),
o AS (SELECT DISTINCT y.lang, y.g[s : s + j - 1] AS g, y.a FROM f y, range(2, 5) q(j), range(1, 5) z(s) WHERE j < y.k AND s + j - 1 <= y.k),
d AS (SELECT b.* FROM b ANTI JOIN o ON o.lang = b.lang AND o.g = b.g AND 100 * o.a >= 100 * b.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) AS rank, array_to_string(g, ' ') AS phrase, a, l, r, n, score
FROM d QUALIFY rank <= 2000
"""
