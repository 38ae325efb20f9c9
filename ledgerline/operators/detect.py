"""Layout detection: rule tables against document texts."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: A rule table is joined as a broadcast only up to this many rows; a longer one is an error.
MAX_RULES = 10_000


def sample_texts(lines: DataFrame, cells: DataFrame | None = None, pages: int | None = None, header_lines: int | None = None, tables: int = 2, rows: int = 4, top_lines: int = 12) -> DataFrame:
    """file, top, header, body: all lines of a document, or those of its first ``pages`` and ``header_lines``, blanks removed; ``top`` has the first few lines.

    With ``cells``, the first rows of the first tables are added to the body. The page filter reaches the scan.
    """
    first = (lines if pages is None else lines.filter(F.col("page_no") <= pages)).select("file", F.struct("page_no", "line_no", "text").alias("x"))
    text = first.groupBy("file").agg(F.array_sort(F.collect_list("x")).alias("x"))
    strip = lambda c: F.regexp_replace(c, r"[\s　]+", "")
    first_lines = lambda n: strip(F.array_join(F.transform(F.col("x") if n is None else F.slice("x", 1, n), lambda r: r["text"]), "\n"))
    out = text.select("file", first_lines(top_lines).alias("top"), first_lines(header_lines).alias("header"), strip(F.array_join(F.transform("x", lambda r: r["text"]), "\n")).alias("body"))
    if cells is None:
        return out
    top = cells.filter((F.lit(True) if pages is None else F.col("page_no") <= pages) & (F.col("table_no") <= tables) & (F.col("row_no") <= rows)).select("file", F.struct("page_no", "table_no", "row_no", F.array_join("cells", "").alias("t")).alias("y"))
    more = top.groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list("y")), lambda r: r["t"]), "").alias("cells_text"))
    return out.join(more, "file", "full").select("file", F.coalesce("top", F.lit("")).alias("top"), F.coalesce("header", F.lit("")).alias("header"), F.concat(F.coalesce("body", F.lit("")), strip(F.coalesce("cells_text", F.lit("")))).alias("body"))


def first_match(docs: DataFrame, rules: DataFrame, key: str = "file", max_rules: int = MAX_RULES, loop_rules: int = 64) -> DataFrame:
    """The first rule, by ``ord``, all of whose markers are in the rule's scope (a column of ``docs``: header, top, else body): bank_id, label, confidence, reason; unrecognised otherwise.

    Rules may have ``header_markers``, which must all be in the header besides. Up to ``loop_rules`` rules are broadcast
    and each text meets all of them in the JVM; more go as one automaton that reads a text once, whatever their number;
    more than ``max_rules`` are an error, as the rules are sent to every task.
    """
    n = rules.limit(max_rules + 1).count()
    if n > max_rules:
        raise ValueError(f"more than {max_rules} detection rules")
    if "header_markers" not in rules.columns:
        rules = rules.withColumn("header_markers", F.array().cast("array<string>"))
    rule = ["bank_id", "label", "confidence", "reason"]
    if n > loop_rules:
        first = _automaton(docs, rules)
        met = docs.select(key, first.alias("_ord")).join(F.broadcast(rules.select(F.col("ord").alias("_ord"), F.struct(*rule).alias("r"))), "_ord", "left")
    else:
        scope = F.when(F.col("scope") == "header", F.col("header"))
        if "top" in docs.columns:
            scope = scope.when(F.col("scope") == "top", F.col("top"))
        scope = scope.otherwise(F.col("body"))
        hit = F.forall("markers", lambda m: F.contains(scope, m)) & F.forall("header_markers", lambda m: F.contains(F.col("header"), m))
        met = docs.join(F.broadcast(rules), hit, "left").groupBy(key).agg(F.min_by(F.struct(*rule), "ord").alias("r"))
    return met.select(key, F.coalesce("r.bank_id", F.lit("unknown")).alias("bank_id"), F.coalesce("r.label", F.lit("unrecognised")).alias("label"), F.coalesce("r.confidence", F.lit(0)).alias("confidence"), F.col("r.reason").alias("reason"))


def _automaton(docs: DataFrame, rules: DataFrame):
    """The least ``ord`` of the rules that fit, null for none: every text is read once by an automaton of all markers."""
    table = []  # (ord, [(scope, marker)])
    for r in rules.orderBy("ord").collect():  # at most ``max_rules``
        scope = r.scope if r.scope == "header" or (r.scope == "top" and "top" in docs.columns) else "body"
        table.append((r.ord, [(scope, m) for m in set(r.markers or [])] + [("header", m) for m in set(r.header_markers or [])]))
    sent, name = docs.sparkSession.sparkContext.broadcast(table), uuid.uuid4().hex
    scopes = [c for c in ("header", "top", "body") if c in docs.columns]

    @F.pandas_udf("int")
    def first(*texts: pd.Series) -> pd.Series:
        find, needs = _compiled(name, sent.value)
        return pd.Series([_least(find, needs, dict(zip(scopes, row))) for row in zip(*texts)], dtype="Int32")

    return first(*[F.col(c) for c in scopes])


_BUILT: dict = {}


def _compiled(name: str, table: list):
    """(automaton of all markers with the rules that want them, rules by what they want), built once in a worker."""
    import ahocorasick

    if name not in _BUILT:
        wants: dict[str, list] = {}
        for k, (_, parts) in enumerate(table):
            for scope, marker in parts:
                wants.setdefault(marker, []).append((scope, k))
        find = ahocorasick.Automaton()
        for marker, who in wants.items():
            if marker:  # an empty marker is in every text
                find.add_word(marker, (marker, who))
        if len(find):
            find.make_automaton()
        _BUILT.clear()
        _BUILT[name] = (find if len(find) else None, [(o, {x for x in parts if x[1]}) for o, parts in table])
    return _BUILT[name]


def _least(find, needs, texts: dict) -> int | None:
    left: dict[int, set] = {}
    for scope, text in texts.items():
        seen = set()
        for _, (marker, who) in find.iter(text) if find is not None and text else ():
            if marker not in seen:
                seen.add(marker)
                for of, k in who:
                    if of == scope:
                        left.setdefault(k, set()).add((scope, marker))
    whole = [k for k, got in left.items() if len(got) == len(needs[k][1])]
    free = next((k for k, (_, parts) in enumerate(needs) if not parts), None)  # a rule that wants nothing fits all
    best = min([*whole, *([] if free is None else [free])], default=None)
    return None if best is None else needs[best][0]


def keyword_score(docs: DataFrame, keywords: DataFrame, text: str = "text", key: str = "file", by_length: bool = False, max_rules: int = MAX_RULES) -> DataFrame:
    """keywords(bank_id, keyword): the bank with the most keywords (or the longest, summed) in the text, case ignored; ties to the smaller id. Texts without any are left out."""
    if keywords.limit(max_rules + 1).count() > max_rules:
        raise ValueError(f"more than {max_rules} keywords")
    met = docs.join(F.broadcast(keywords), F.contains(F.lower(text), F.lower("keyword")))
    score = F.sum(F.length("keyword")) if by_length else F.count("*")
    scores = met.groupBy(key, "bank_id").agg(score.cast("bigint").alias("score"))
    best = Window.partitionBy(key).orderBy(F.desc("score"), "bank_id")
    return scores.withColumn("_n", F.row_number().over(best)).filter("_n = 1").drop("_n")


def image_only(pages: DataFrame) -> DataFrame:
    """Files with images but no text: pages(file, n_chars, n_images)."""
    return pages.groupBy("file").agg(F.sum("n_chars").alias("chars"), F.sum("n_images").alias("images")).filter("chars = 0 AND images > 0")


def route(statements: DataFrame, layouts: DataFrame) -> DataFrame:
    """Each file with the shapes that its layout can be read from, in order of the alphabet; files of unknown layouts get an error.

    ``shape`` is the first of them, null for unknown layouts.
    """
    shapes = layouts.groupBy("bank_id").agg(F.array_sort(F.collect_set("shape")).alias("shapes"))
    out = statements.join(shapes, "bank_id", "left").withColumn("shape", F.col("shapes")[0])
    return out.withColumn("error", F.when(F.col("shapes").isNull(), "unknown_layout"))


def agreed_label(rows: DataFrame, label: str = "bank_label", key: str = "source_file") -> DataFrame:
    """The label on which all of a file's rows that have one agree; null otherwise."""
    return rows.groupBy(key).agg(F.when(F.count_distinct(label) == 1, F.max(label)).alias("label"))


def file_flags(lines: DataFrame, markers: dict[str, str], key: str = "file") -> DataFrame:
    """One boolean a marker: the file's text holds it."""
    return lines.groupBy(key).agg(*[F.max(F.contains("text", F.lit(m))).alias(n) for n, m in markers.items()])


def with_flags(rows: DataFrame, flags: DataFrame, key: str = "source_file", flag_key: str = "file") -> DataFrame:
    """Rows with the flags of their file; false where the file has none."""
    names = [c for c in flags.columns if c != flag_key]
    return rows.join(flags.withColumnRenamed(flag_key, key), key, "left").fillna(False, names)
