"""SentencePiece models on the tokenizers library: encoding, decoding and a check against the reference encoder.

The model file is parsed on the driver and rebuilt: normaliser (character map, dummy prefix, white space as the
metaspace mark), Unigram scores or, for BPE models, merges in the order of their scores, byte fallback, and decoder.
Texts are encoded in batches of segments by the library's own threads. Where no piece holds a mark inside, texts are
cut before marks: the cuts can't change the result, they bound memory and let the library cache words.
"""

from __future__ import annotations

import os
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
MAX_MODEL_BYTES = 64 << 20
#: Fixed texts on which every rebuilt model is compared with the reference encoder.
PROBES = ["", " ", "a", " two  spaces ", "Line\nbreak\tand tab\r\n", "café über straße 你好 \U0001f600", "<s> </s> <unk> <0x0A>", MARK + " mark " + MARK + MARK, "aaaa aaaaa 1234567890 12.5%", "é ﬁ   ​"]


def rebuild(model: bytes) -> dict:
    """Model protobuf -> {"tokenizer": JSON of the tokenizers library, ...} with what the worker needs besides."""
    from sentencepiece import sentencepiece_model_pb2 as pb
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    if len(model) > MAX_MODEL_BYTES:
        raise ValueError("the model is too large to be sent to every task")
    m = pb.ModelProto()
    m.ParseFromString(model)
    if any(p.type == USER_DEFINED for p in m.pieces):
        raise ValueError("user-defined pieces aren't supported")
    if m.trainer_spec.treat_whitespace_as_suffix or not m.normalizer_spec.escape_whitespaces:
        raise ValueError("only models with a white space prefix mark are supported")
    unk = next(i for i, p in enumerate(m.pieces) if p.type == UNKNOWN)
    fallback = m.trainer_spec.byte_fallback
    if m.trainer_spec.model_type == 1:
        # the least score also sets that of unknown characters, so other pieces must not lower it
        floor = min(p.score for p in m.pieces if p.type == NORMAL)
        scores = [(p.piece, p.score if p.type == NORMAL else floor) for p in m.pieces]
        tok = Tokenizer(models.Unigram(scores, unk_id=unk, byte_fallback=fallback))
    elif m.trainer_spec.model_type == 2:
        normal = {p.piece: (i, p.score) for i, p in enumerate(m.pieces) if p.type == NORMAL}
        merges = []
        for piece, (i, score) in normal.items():
            cuts = [(piece[:k], piece[k:]) for k in range(1, len(piece)) if piece[:k] in normal and piece[k:] in normal]
            merges += [(-score, i, normal[a][0], normal[b][0], (a, b)) for a, b in cuts]
        tok = Tokenizer(models.BPE({p.piece: i for i, p in enumerate(m.pieces)}, [x[-1] for x in sorted(merges)], unk_token=m.pieces[unk].piece, fuse_unk=True, byte_fallback=fallback))
    else:
        raise ValueError("only Unigram and BPE models are supported")
    # the unigram backend would take the names of control and byte pieces from a text, too: such texts go another way
    literals = [p.piece for p in m.pieces if p.type != NORMAL] if m.trainer_spec.model_type == 1 else []
    cuttable = not any(a != MARK and b == MARK for p in m.pieces for a, b in zip(p.piece, p.piece[1:]))
    if cuttable and m.trainer_spec.model_type == 2:
        tok.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}*[^{MARK}]+|{MARK}+"), "isolated")
    spec, parts = m.normalizer_spec, []
    if len(spec.precompiled_charsmap) > 8:  # shorter ones hold an empty map
        parts.append(normalizers.Precompiled(spec.precompiled_charsmap))
    if spec.remove_extra_whitespaces:
        parts += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Strip()]
    parts.append(normalizers.Replace(" ", MARK))
    norm = Tokenizer(models.BPE())
    norm.normalizer = normalizers.Sequence(parts)
    ends = [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
    tok.decoder = decoders.Sequence(ends + [decoders.Strip(" ", 1, 0)] * spec.add_dummy_prefix)
    return {"tokenizer": tok.to_str(), "normalizer": norm.to_str(), "prefix": bool(spec.add_dummy_prefix), "cuttable": cuttable, "lossless": len(parts) == 1, "literals": literals, "model": model if literals else b""}


class Codec:
    """A rebuilt model in a worker."""

    def __init__(self, built: dict, threads: int = 2):
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        from tokenizers import Tokenizer

        self.tok, self.norm = Tokenizer.from_str(built["tokenizer"]), Tokenizer.from_str(built["normalizer"]).normalizer
        self.prefix, self.cuttable, self.lossless = built["prefix"], built["cuttable"], built["lossless"]
        self.literal = re.compile("|".join(map(re.escape, built["literals"]))) if built["literals"] else None
        self.model = built["model"]

    def segments(self, text: str, length: int) -> list[str]:
        text = self.norm.normalize_str(text) if text and not self.lossless else text.replace(" ", MARK)
        if not text:
            return []
        text = MARK + text if self.prefix else text
        cuts = [0]
        while self.cuttable and len(text) - cuts[-1] > length:
            at = text.find(MARK, cuts[-1] + length)
            while at > 0 and text[at - 1] == MARK:
                at = text.find(MARK, at + 1)
            if at < 0:
                break
            cuts.append(at)
        return [text[a:b] for a, b in zip(cuts, [*cuts[1:], len(text)])]

    def encode(self, texts, length: int = 16384, at_once: int = 1 << 18):
        """A list of ids for each text; None for None."""
        out, batch, size = [], [], 0
        for text in texts:
            if text is None:
                out.append(None)
                continue
            out.append(ids := [])
            if self.literal and self.literal.search(text):
                ids.extend(reference(self.model).encode(text))
                continue
            for seg in self.segments(text, length):
                batch.append((ids, seg))
                size += len(seg)
                if size >= at_once:
                    self._run(batch)
                    batch, size = [], 0
        self._run(batch)
        return out

    def _run(self, batch):
        if batch:
            for (ids, _), enc in zip(batch, self.tok.encode_batch_fast([s for _, s in batch], add_special_tokens=False)):
                ids.extend(enc.ids)

    def decode(self, lists, at_once: int = 1 << 17):
        out, batch, size = [], [], 0

        def run():
            for (k, _), text in zip(batch, self.tok.decode_batch([x for _, x in batch], skip_special_tokens=False)):
                out[k] = text

        for k, ids in enumerate(lists):
            out.append(None if ids is None else "")
            if ids is not None and len(ids):
                batch.append((k, list(ids)))
                size += len(ids)
                if size >= at_once:
                    run()
                    batch, size = [], 0
        run()
        return out


_CODECS: dict[str, Codec] = {}
_REFERENCE: dict = {}


def codec(built: dict, threads: int) -> Codec:
    if built["tokenizer"] not in _CODECS:
        _CODECS[built["tokenizer"]] = Codec(built, threads)
    return _CODECS[built["tokenizer"]]


def reference(model: bytes):
    """The reference encoder of a model, one in a worker."""
    import sentencepiece

    if model not in _REFERENCE:
        _REFERENCE[model] = sentencepiece.SentencePieceProcessor(model_proto=model)
    return _REFERENCE[model]


def differing(model: bytes, built: dict, texts) -> list[str]:
    """Texts that the reference encoder encodes in another way."""
    theirs, own = reference(model), codec(built, 2)
    return [t for t, ids in zip(texts, own.encode(texts)) if list(theirs.encode(t)) != ids]


def public_model() -> str:
    """Path of the public 32k-piece model; the default of the queries below."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode_documents(docs: DataFrame, model: bytes, text_col: str = "text", out: str = "encoded", threads: int = 2, verify_every: int = 64) -> DataFrame:
    """All rows of ``docs`` with a struct column ``out``: ids, n_ids, round_trip (the ids decode to the text again).

    Null texts have null ids and round_trip, empty texts no ids; a column named ``out`` is replaced. ``round_trip`` is
    about the text itself: models that normalise, and texts that hold the mark U+2581, may give false. Whatever ``verify_every``, all rows are encoded;
    texts whose crc32 it divides are also encoded by the reference encoder, and a difference ends the job.
    """
    built = rebuild(model)
    if bad := differing(model, built, PROBES):
        raise ValueError(f"the rebuilt model differs on {bad[:3]}")
    sent = small_batches(docs.sparkSession).sparkContext.broadcast({"built": built, "model": model})

    @F.arrow_udf("ids array<int>, n_ids int, round_trip boolean")
    def run(text: pa.Array) -> pa.Array:
        own = codec(sent.value["built"], threads)
        ids, same = [], []
        for k in range(0, len(text), 64):  # Python's integers are large: a few texts at a time, then arrays
            texts = text.slice(k, 64).to_pylist()
            some = own.encode(texts)
            probe = [t for t in texts if t is not None and verify_every and zlib.crc32(t.encode("utf-8", "surrogatepass")) % verify_every == 0]
            if probe and (bad := differing(sent.value["model"], sent.value["built"], probe)):
                raise ValueError(f"encoded in another way than by the reference encoder: {bad[0][:200]!r}")
            same += [None if t is None else t == b for t, b in zip(texts, own.decode(some))]
            ids += [None if x is None else np.array(x, np.int32) for x in some]
        sizes = np.array([0 if x is None else len(x) for x in ids], np.int32)
        ends = pa.array(np.r_[np.int32(0), np.cumsum(sizes, dtype=np.int32)], pa.int32(), mask=np.array([x is None for x in ids] + [False]))
        lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate([x for x in ids if x is not None] or [np.empty(0, np.int32)]), pa.int32()))
        counts = pa.array(sizes, pa.int32(), mask=np.array([x is None for x in ids], bool))
        return pa.StructArray.from_arrays([lists, counts, pa.array(same, pa.bool_())], ["ids", "n_ids", "round_trip"])

    return docs.withColumn(out, run(F.col(text_col)))


def decode_documents(encoded: DataFrame, model: bytes, ids_col: str = "ids", out: str = "text") -> DataFrame:
    """All rows with their ids decoded to a text column; null ids give null."""
    sent = encoded.sparkSession.sparkContext.broadcast(rebuild(model))

    @F.arrow_udf("string")
    def run(ids: pa.Array) -> pa.Array:
        return pa.array(codec(sent.value, 2).decode(ids.to_pylist()), pa.string())

    return encoded.withColumn(out, run(F.col(ids_col)))


def encode_rows(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Pipeline form and query op8: doc_id, ids, n_ids, round_trip of every row."""
    with open(path or public_model(), "rb") as f:
        model = f.read()
    return encode_documents(docs.select("doc_id", "text"), model).select("doc_id", "encoded.*")


def op8_sentencepiece(spark, sf_dir):
    return encode_rows(spark.read.parquet(f"{sf_dir}/documents.parquet"))
