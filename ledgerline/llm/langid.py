"""Language identification by rank-order profiles.

A profile is the list of the ``top`` most frequent character 1- to 3-grams of a language (or of one document), most
frequent first. A document goes to the language whose profile has the least out-of-place distance: the sum over the
document's profile of the difference of ranks, or ``top`` for an n-gram that the language lacks. N-grams are taken
inside lower-cased runs of letters, with one boundary mark on each side.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import crc_mod, small_batches

TOP = 400
EDGE = np.uint64(1)  # boundary mark; letters are their code points, all above 1
_B1, _B2 = np.uint64(21), np.uint64(42)  # three code points of 21 bits fill a 64-bit n-gram
_LETTERS = None


def _letters() -> np.ndarray:
    """Code point -> lower-cased code point for letters, EDGE for anything else; built once in a worker."""
    global _LETTERS
    if _LETTERS is None:
        _LETTERS = np.fromiter((ord(c.lower()[0]) if (c := chr(i)).isalpha() else 1 for i in range(0x110000)), np.uint64, 0x110000)
    return _LETTERS


def _codes(text: str) -> np.ndarray:
    """The text's letters, each run of other characters as one EDGE, EDGE at both ends."""
    c = _letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")]
    c = np.concatenate(([EDGE], c, [EDGE]))
    keep = np.ones(len(c), bool)
    keep[1:] = (c[1:] != EDGE) | (c[:-1] != EDGE)
    return c[keep]


def ngram_counts(text: str, block: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams (ascending) and their counts; long texts in blocks, so that memory stays bounded."""
    if len(text) > block:
        cut = [0]
        while cut[-1] < len(text):  # cut at non-letters, else n-grams would be lost at the seams
            at = min(cut[-1] + block, len(text))
            while at < len(text) and text[at].isalpha():
                at += 1
            cut.append(at)
        return merged([ngram_counts(text[a:b], 1 << 62) for a, b in zip(cut, cut[1:])])
    c = _codes(text)
    if len(c) < 3:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    a, b, d = c[:-2], c[1:-1], c[2:]
    inner = b != EDGE
    grams = np.concatenate((c[c != EDGE], c[:-1] | c[1:] << _B1, (a | b << _B1 | d << _B2)[inner]))
    return np.unique(grams, return_counts=True)


def merged(parts) -> tuple[np.ndarray, np.ndarray]:
    parts = [p for p in parts if len(p[0])]
    if not parts:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    grams, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return grams, np.bincount(at, np.concatenate([p[1] for p in parts])).astype(np.int64)


def top_grams(grams: np.ndarray, counts: np.ndarray, top: int) -> np.ndarray:
    """The most frequent n-grams, ties to the smaller n-gram (``grams`` are ascending)."""
    return grams[np.argsort(-counts, kind="stable")[:top]]


class Profiles:
    """Ranks of the languages' n-grams over their union."""

    def __init__(self, ranked: dict[str, list[int]], top: int):
        self.langs, self.top = sorted(ranked, key=lambda s: s.encode("utf-8", "surrogatepass")), top
        self.place = {lang: k for k, lang in enumerate(self.langs)}
        self.grams = np.unique(np.array([g for v in ranked.values() for g in v], np.uint64))
        self.ranks = np.full((len(self.langs), len(self.grams)), -1, np.int32)
        for k, lang in enumerate(self.langs):
            own = np.array(ranked[lang], np.uint64)
            self.ranks[k, np.searchsorted(self.grams, own)] = np.arange(len(own))

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and 1 - distance / greatest distance. ``und`` and 0 for null, no letter, or nothing learned."""
        return self.judge(text)[:2]

    def judge(self, text: str | None, label: str | None = None) -> tuple[str, float, float, float]:
        """As ``predict``, the share of the text's n-grams that any profile has, and the score of ``label`` (of the language found, if none was learned for it)."""
        if text is None or not self.langs:
            return "und", 0.0, 0.0, 0.0
        doc = top_grams(*ngram_counts(text), self.top)
        if not len(doc):
            return "und", 0.0, 0.0, 0.0
        at = np.minimum(np.searchsorted(self.grams, doc), len(self.grams) - 1)
        rank = np.arange(len(doc), dtype=np.int32)
        theirs = np.where(self.grams[at] == doc, self.ranks[:, at], -1)
        far = np.where(theirs < 0, self.top, np.abs(theirs - rank)).sum(axis=1)
        best = int(np.argmin(far))  # ties: the first by code point
        score = lambda k: float(max(0.0, 1 - far[k] / (self.top * len(doc))))
        return self.langs[best], score(best), float((self.grams[at] == doc).mean()), score(self.place.get(label, best))


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", top: int = TOP, max_languages: int = 5000) -> Profiles:
    """Profiles of all labels over all of ``labelled`` (rows with null text or label are left out).

    Tasks count n-grams by label before the shuffle. What reaches the driver is ``top`` n-grams for each label; more
    than ``max_languages`` labels are an error, as the profiles are sent to every task.
    """

    def count(batches):
        held: dict[str, list] = {}
        size = 0

        def rows():
            for lang, parts in held.items():
                grams, counts = merged(parts)
                if not len(grams):
                    continue
                yield pd.DataFrame({"lang": [lang] * len(grams), "gram": grams.astype(np.int64), "n": counts})

        for pdf in batches:
            for lang, text in zip(pdf["lang"], pdf["text"]):
                parts = held.setdefault(lang, [])
                parts.append(ngram_counts(text))
                size += len(parts[-1][0])
            if size > 4_000_000:
                held = {k: [merged(v)] for k, v in held.items()}
                size = sum(len(v[0][0]) for v in held.values())
                if size > 2_000_000:
                    yield from rows()
                    held, size = {}, 0
        yield from rows()

    small_batches(labelled.sparkSession)
    used = labelled.filter(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    counts = used.mapInPandas(count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    best = counts.withColumn("rank", rank).filter(F.col("rank") <= top).groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("rank", "gram"))).alias("best"))
    found = best.limit(max_languages + 1).collect()
    if len(found) > max_languages:
        raise ValueError(f"more than {max_languages} labels: raise max_languages if they are meant")
    return Profiles({r.lang: [x.gram for x in r.best] for r in found}, top)


def predict(docs: DataFrame, profiles: Profiles, text_col: str = "text", out: str = "language") -> DataFrame:
    """All rows of ``docs`` with a struct column ``out`` (lang_pred, score); a column of that name is replaced.

    Null texts and texts without letters are ``und``; ties go to the first language by code point; texts of any length are read whole.
    """
    model = small_batches(docs.sparkSession).sparkContext.broadcast(profiles)  # at most max_languages x top ranks

    @F.pandas_udf("lang_pred string, score double")
    def judge(text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([model.value.predict(t) for t in text], columns=["lang_pred", "score"])

    return docs.withColumn(out, judge(F.col(text_col)))


def keep_known(docs: DataFrame, min_score: float = 0.05, min_known: float = 0.3, max_lead: float = 0.02) -> DataFrame:
    """Pipeline form: profiles learned from the rows' own labels; rows without a letter, far from every profile, or in another language than their label says, go.

    A row is judged only if at least ``min_known`` of its n-grams are in some profile: where fewer are,
    nothing was learned about what it is written in (an unlabelled script, with or without some words of a labelled one),
    and it stays. Of the others those go that score less than ``min_score``, and those that another learned language is nearer to
    than their label's, by more than ``max_lead`` of the score: wrongly labelled ones, and texts with most of another language inside.
    Rows without label, or with one that nothing was learned for, aren't held against it.
    Where nothing was learned at all (no label, or labelled texts without letters) every row that has a
    letter stays. Needs text and lang; other columns may have any name. Null and blank texts go, rows of equal text and label fare
    alike, texts of any length are read whole, an empty table gives an empty one.
    """
    learned = fit(docs)
    if not learned.langs:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    model = small_batches(docs.sparkSession).sparkContext.broadcast(learned)

    @F.pandas_udf("boolean")
    def stays(text: pd.Series, label: pd.Series) -> pd.Series:
        judged = map(model.value.judge, text, label)
        return pd.Series([lang != "und" and (known < min_known or (score >= min_score and score - own <= max_lead)) for lang, score, known, own in judged], dtype=bool)

    return docs.filter(stays(F.col("text"), F.col("lang").cast("string"))).select(*[F.col(f"`{c}`") for c in docs.columns])


def op9_language_id(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = crc_mod(F.col("doc_id"), 4) == 2
    profiles = fit(docs.filter(~held).select("text", "lang"))
    judged = predict(docs.select("doc_id", "text"), profiles)
    return judged.select("doc_id", held.alias("held_out"), F.col("language.lang_pred").alias("lang_pred"), F.col("language.score").alias("score"))
