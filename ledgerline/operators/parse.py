"""From extracted lines, cells and words to ledger rows; a layout is a row of a table, not code.

Shapes: L text lines by pattern, C table cells by position or header role, M cells that hold several lines, P positioned words.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.money import MONEY, sheet_money, to_money, zero
from ledgerline.functions.text import compact_cell, sheet_timestamp
from ledgerline.operators import chain

NO_CODES = "array<string>"


# -- rows from lines ------------------------------------------------------------------------------------------------


def in_order(*by) -> Window:
    return Window.partitionBy("file").orderBy(*(by or ("page_no", "line_no")))


def line_pairs(lines: DataFrame, first: str, second: str) -> DataFrame:
    """A line like ``first`` and the next one, if like ``second``, become one; a line is used once."""
    df = lines.withColumns({"_next": F.lead("text").over(in_order()), "_a": F.regexp_like("text", F.lit(first))})
    df = df.withColumn("_pair", F.col("_a") & F.regexp_like(F.coalesce("_next", F.lit("")), F.lit(second)))
    # in a run of lines that fit both patterns every second one opens a pair
    run = F.sum((~F.col("_pair")).cast("int")).over(in_order().rowsBetween(Window.unboundedPreceding, -1))
    df = df.withColumn("_run", F.coalesce(run, F.lit(0)))
    df = df.withColumn("_k", F.row_number().over(Window.partitionBy("file", "_run").orderBy("page_no", "line_no")))
    df = df.withColumn("_open", F.col("_pair") & (F.col("_k") % 2 == 1)).withColumn("_used", F.coalesce(F.lag("_open").over(in_order()), F.lit(False)))
    return df.filter(~F.col("_used")).withColumn("text", F.when(F.col("_open"), F.concat_ws(" ", "text", "_next")).otherwise(F.col("text"))).drop("_next", "_a", "_pair", "_run", "_k", "_open", "_used")


def continuation_blocks(lines: DataFrame, start: str) -> DataFrame:
    """Lines that don't look like a row's start go to the row before; one row a block."""
    df = lines.withColumn("_block", F.sum(F.regexp_like("text", F.lit(start)).cast("int")).over(in_order().rowsBetween(Window.unboundedPreceding, 0)))
    agg = df.filter("_block > 0").groupBy("file", "_block").agg(F.array_sort(F.collect_list(F.struct("page_no", "line_no", "text"))).alias("x"))
    return agg.select("file", F.col("x")[0]["page_no"].alias("page_no"), F.col("x")[0]["line_no"].alias("line_no"), F.array_join(F.transform("x", lambda r: r["text"]), " ").alias("text"))


def by_pattern(lines: DataFrame, fields: dict[str, int], rx: Column | str = "rx") -> DataFrame:
    """Named groups of the layout's pattern (a column of the joined layout); lines that don't match are left out."""
    pattern = F.col(rx) if isinstance(rx, str) else rx
    out = lines.filter(F.regexp_like("text", pattern))
    return out.select("*", *[F.nullif(F.call_function("regexp_extract", F.col("text"), pattern, F.lit(i)), F.lit("")).alias(n) for n, i in fields.items()])


# -- rows from cells ------------------------------------------------------------------------------------------------


#: Words of table headers by role, the first word that a cell holds counts most.
ROLE_WORDS = {
    "date": ["交易日期", "记账日期", "日期", "Date", "交易时间"],
    "time": ["交易时间", "时间"],
    "amount": ["交易金额", "金额", "发生额", "交易额"],
    "credit": ["收入金额", "贷方金额", "进账金额", "收入", "贷方"],
    "debit": ["支出金额", "借方金额", "出账金额", "支出", "借方"],
    "direction": ["收支方向", "借贷标志", "进出标志", "方向", "借贷"],
    "counterparty": ["对方名称", "对方户名", "交易对手", "对方", "收款人", "付款人", "户名"],
    "counterparty_account": ["对方账号", "对方账户", "对方帐号"],
    "type": ["摘要", "交易类型", "用途", "备注", "交易摘要"],
    "balance": ["余额", "账户余额", "当前余额"],
    "account": ["账号", "账户", "卡号"],
    "currency": ["币种", "货币"],
}
#: What wallets call the direction's column.
WALLET_WORDS = ROLE_WORDS | {"direction": [*ROLE_WORDS["direction"], "收/支", "收入/支出"]}
#: These roles leave a column to any other role that fits it.
GIVE_WAY = ("amount", "time")
MAX_WORDS = 2_000


def role_words(keywords: DataFrame) -> dict[str, list[str]]:
    """keywords(role, ord, keyword) as words by role, in order; more than ``MAX_WORDS`` are an error, as each row meets all of them."""
    rows = keywords.limit(MAX_WORDS + 1).collect()
    if len(rows) > MAX_WORDS:
        raise ValueError(f"more than {MAX_WORDS} header words")
    out: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: (r.role, r.ord)):
        out.setdefault(r.role, []).append(r.keyword)
    return out


def roles_of(cells: Column, words: dict[str, list[str]], least: int = 2) -> Column:
    """Map of role -> column position (from 0) of a header row; null for rows with fewer than ``least`` roles.

    An exact match counts before one inside the cell, then the word's order, then the column; a column has one role and
    a role one column, roles of ``GIVE_WAY`` last. All of it happens inside the row: one list of words is held against
    each cell, so the plan doesn't grow with the words; one pattern rules out rows without any header word.
    """
    entry = lambda role, k, w: F.struct(F.lit(w).alias("word"), F.lit(role).alias("role"), F.lit(int(role in GIVE_WAY)).alias("late"), F.lit(k).alias("ord"))
    known = F.array(*[entry(role, k, w) for role, some in words.items() for k, w in enumerate(some)])

    def in_cell(c, pos, some):
        hit = lambda w: F.struct(w["late"].alias("late"), (c != w["word"]).cast("int").alias("inside"), w["ord"].alias("ord"), pos.alias("pos"), w["role"].alias("role"))
        return F.transform(F.filter(some, lambda w: F.contains(c, w["word"])), hit)

    def take(acc, h):
        # by rank; a role's later hits don't count, and one on a column that is taken goes
        taken = F.exists(acc["kept"], lambda o: o["pos"] == h["pos"])
        kept = F.when(taken, acc["kept"]).otherwise(F.array_append(acc["kept"], F.struct(h["role"].alias("role"), h["pos"].alias("pos"))))
        return F.when(F.array_contains(acc["seen"], h["role"]), acc).otherwise(F.struct(kept.alias("kept"), F.array_append(acc["seen"], h["role"]).alias("seen")))

    none = F.struct(F.array().cast("array<struct<role:string,pos:int>>").alias("kept"), F.array().cast("array<string>").alias("seen"))
    # an array of one element binds what is used twice to a name, so that it is computed once
    both = F.transform(F.array(F.transform(cells, compact_cell)), lambda own: F.struct(own.alias("own"), F.array_join(own, "\n").alias("all")))
    held = F.transform(both, lambda x: F.struct(x["own"].alias("own"), F.filter(known, lambda w: F.contains(x["all"], w["word"])).alias("some")))  # the row's own words, then by cell
    hits = F.array_sort(F.flatten(F.transform(held, lambda x: F.flatten(F.transform(x["own"], lambda c, pos: in_cell(c, pos, x["some"]))))))
    kept = F.array(F.aggregate(hits, none, take, lambda acc: acc["kept"]))
    roles = F.transform(kept, lambda k: F.when(F.size(k) >= least, F.map_from_entries(F.array_sort(k))))[0]
    any_word = F.regexp_like(F.array_join(cells, "\n", ""), F.lit("|".join(r"\s*".join(map(re.escape, w)) for some in words.values() for w in some)))
    return F.when(any_word, roles)


def confidence(roles: Column, words: dict[str, list[str]]) -> Column:
    """Share of the roles that a header has, two places."""
    return F.round(F.size(roles) / F.lit(float(len(words))), 2)


def header_roles(cells: DataFrame, keywords: DataFrame, least: int = 2) -> DataFrame:
    """Header rows with ``roles`` and ``confidence``. keywords(role, ord, keyword)."""
    words = role_words(keywords)
    return cells.withColumn("roles", roles_of(F.col("cells"), words, least)).filter("roles IS NOT NULL").withColumn("confidence", confidence(F.col("roles"), words))


def with_roles(cells: DataFrame, words: dict[str, list[str]], least: int = 2, weak: float = 0.3) -> DataFrame:
    """Each cell row with the roles of the last header at or before it in its file; header rows and rows before any are left out.

    A header whose confidence is under ``weak`` is read together with the row below it, column by column, if that tells
    more roles; the row below is then part of the header.
    """
    rows = in_order("page_no", "table_no", "row_no")  # one shuffle and one sort for all that follows
    below = F.lead(F.struct("page_no", "table_no", "cells")).over(rows)
    df = cells.withColumn("_below", below).withColumn("_own", roles_of(F.col("cells"), words, least))  # after the shuffle, in as many tasks as that has
    same = (F.col("_below")["page_no"] == F.col("page_no")) & (F.col("_below")["table_no"] == F.col("table_no"))
    merged = F.zip_with("cells", F.col("_below")["cells"], lambda a, b: F.concat(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))))
    df = df.withColumn("_both", F.when((confidence(F.col("_own"), words) < weak) & same, roles_of(merged, words, least)))
    df = df.withColumn("_two", F.coalesce(F.size("_both") > F.size("_own"), F.lit(False))).withColumn("_second", F.coalesce(F.lag("_two").over(rows), F.lit(False)))
    df = df.withColumn("_header", F.when(~F.col("_second"), F.when(F.col("_two"), F.col("_both")).otherwise(F.col("_own"))))
    df = df.withColumn("roles", F.last("_header", ignorenulls=True).over(rows.rowsBetween(Window.unboundedPreceding, 0)))
    return df.filter("_header IS NULL AND NOT _second AND roles IS NOT NULL").drop("_below", "_own", "_both", "_two", "_second", "_header")


def sub_layout(cells: DataFrame, rules: list[tuple[str, list[str]]]) -> DataFrame:
    """Each cell row with the layout that the last header at or before it in its file stands for; header rows and rows before any are left out.

    rules: (layout, words that the header's cells must all hold), the first one that fits wins.
    """
    joined = F.array_join(F.transform("cells", compact_cell), "|", "")
    found = None
    for layout, words in rules:
        hit = F.lit(True)
        for w in words:
            hit = hit & F.contains(joined, F.lit(w))
        found = F.when(hit, layout) if found is None else found.when(hit, layout)
    upto = in_order("page_no", "table_no", "row_no").rowsBetween(Window.unboundedPreceding, 0)
    df = cells.withColumn("_header", found)
    return df.withColumn("layout", F.last("_header", ignorenulls=True).over(upto)).filter("_header IS NULL AND layout IS NOT NULL").drop("_header")


def cell(role: str) -> Column:
    """The cell of a role, null where the table lacks it."""
    return F.nullif(F.trim(F.try_element_at("cells", (F.element_at("roles", role) + 1).cast("int"))), F.lit(""))


def unpack_cells(cells: DataFrame) -> DataFrame:
    """Cells that hold several lines: line i of every cell becomes a row of its own, row_no * 1000 + i."""
    lines = F.transform("cells", lambda c: F.split(F.coalesce(c, F.lit("")), "\n"))
    n = F.array_max(F.transform(lines, F.size))
    df = cells.withColumns({"_lines": lines, "_n": F.coalesce(n, F.lit(1))}).withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    one = F.transform("_lines", lambda x: F.try_element_at(x, F.col("_i")))
    return df.withColumns({"cells": one, "row_no": F.col("row_no") * 1000 + F.col("_i") - 1}).drop("_lines", "_n", "_i")


def html_cells(pages: DataFrame, html: str = "html", key: str = "file") -> DataFrame:
    """Table rows of HTML texts: file, table_no, row_no, cells; tags inside cells are dropped, the basic entities decoded."""
    some = lambda c, rx: F.regexp_extract_all(c, F.lit(rx), 1)
    tables = pages.select(F.col(key).alias("file"), F.posexplode(some(F.col(html), r"(?is)<table\b[^>]*>(.*?)</table>")).alias("table_no", "t"))
    rows = tables.select("file", "table_no", F.posexplode(some(F.col("t"), r"(?is)<tr\b[^>]*>(.*?)</tr>")).alias("row_no", "r"))
    plain = lambda c: F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"(?is)<[^>]*>", ""), "&nbsp;", " "), "&lt;", "<"), "&gt;", ">"), "&amp;", "&"))
    return rows.select("file", "table_no", "row_no", F.transform(some(F.col("r"), r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]>"), plain).alias("cells"))


def best_table(rows: DataFrame, table: str = "table_no", key: str = "file") -> DataFrame:
    """Rows of the table (or sheet) with the most parsed rows; the first wins ties."""
    n = F.count("*").over(Window.partitionBy(key, table))
    df = rows.withColumn("_n", F.struct(n.alias("n"), (-F.col(table)).alias("t")))
    return df.withColumn("_best", F.max("_n").over(Window.partitionBy(key))).filter("_n = _best").drop("_n", "_best")


# -- rows from words ------------------------------------------------------------------------------------------------


#: Words whose tops differ by less stand on one line.
SAME_LINE = 2.0


def _lines_text(words: Column) -> Column:
    """Words (top, x0, text) of one cell as text: a word within ``SAME_LINE`` of a line's first word is on that line; lines from left to right, one below the other."""
    start = F.struct(F.lit(None).cast("double").alias("top"), F.array().cast("array<struct<line:double,x0:double,text:string>>").alias("done"))

    def put(acc, w):
        line = F.when(w["top"] - acc["top"] < SAME_LINE, acc["top"]).otherwise(w["top"])
        return F.struct(line.alias("top"), F.array_append(acc["done"], F.struct(line.alias("line"), w["x0"].alias("x0"), w["text"].alias("text"))).alias("done"))

    placed = F.array_sort(F.aggregate(F.array_sort(words), start, put, lambda acc: acc["done"]))
    seen = F.struct(F.lit(None).cast("double").alias("line"), F.lit("").alias("text"))
    gap = lambda acc, w: F.when(acc["line"].isNull() | (acc["line"] == w["line"]), "").otherwise("\n")
    return F.aggregate(placed, seen, lambda acc, w: F.struct(w["line"].alias("line"), F.concat(acc["text"], gap(acc, w), w["text"]).alias("text")), lambda acc: acc["text"])


def band_cells(words: DataFrame, anchors: DataFrame, columns: DataFrame, slack: float = 3.0) -> DataFrame:
    """Positioned words to cells: a row's band reaches from ``slack`` above its anchor to the next one's; a word is in a column if its middle is.

    words(file, page_no, x0, x1, top, text), anchors(file, page_no, top, row_no and, if rows differ, slack), columns(file,
    name, left, right). Columns may also have ``page_no`` (edges that differ by page), ``at`` (which edge of a word counts:
    left, right, else the middle), ``above`` and ``below``: how far from the anchor their words lie at most, and ``rx``: what is
taken of a word, and words without it aren't in the column.
    A cell's lines are joined by line ends. Bands are looked up as-of in one sorted pass, so a page with many anchors costs no more than its words.
    """
    own = F.coalesce("slack", F.lit(slack)) if "slack" in anchors.columns else F.lit(slack)
    marks = anchors.select("file", "page_no", (F.col("top") - own).alias("top"), F.struct(F.col("row_no"), F.col("top").alias("from")).alias("band"), *[F.lit(None).cast(t).alias(c) for c, t in (("x0", "double"), ("x1", "double"), ("text", "string"))])
    both = words.select("file", "page_no", "top", F.lit(None).cast(marks.schema["band"].dataType).alias("band"), "x0", "x1", "text").unionByName(marks)
    upto = Window.partitionBy("file", "page_no").orderBy("top", F.col("band").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    placed = both.withColumn("band", F.last("band", ignorenulls=True).over(upto)).filter("text IS NOT NULL AND band IS NOT NULL")
    has = lambda c, t: F.col(c) if c in columns.columns else F.lit(None).cast(t)
    where = F.when(has("at", "string") == "left", F.col("x0")).when(has("at", "string") == "right", F.col("x1")).otherwise((F.col("x0") + F.coalesce("x1", "x0")) / 2)
    put = placed.join(columns.hint("merge"), ["file", "page_no"] if "page_no" in columns.columns else "file").filter((where >= F.col("left")) & (where < F.col("right")))
    off = F.col("top") - F.col("band")["from"]
    put = put.filter((off >= -F.coalesce(has("above", "double"), F.lit(1e9))) & (off < F.coalesce(has("below", "double"), F.lit(1e9))))
    if "rx" in columns.columns:
        part = F.when(F.col("rx").isNull(), F.col("text")).otherwise(F.call_function("regexp_extract", F.col("text"), F.col("rx"), F.lit(0)))
        put = put.withColumn("text", part).filter("rx IS NULL OR text <> ''")
    cells = put.groupBy("file", "page_no", F.col("band.row_no").alias("row_no"), "name").agg(F.collect_list(F.struct("top", "x0", "text")).alias("w"))
    return cells.select("file", "page_no", "row_no", "name", _lines_text(F.col("w")).alias("text"))


def word_anchors(words: DataFrame, layouts: DataFrame) -> DataFrame:
    """Where rows of positioned words start: file, bank_id, page_no, top, row_no, slack. words(file, bank_id, page_no, x0, x1, top, text).

    A layout's ``anchor`` says which words start a row: their left edge from ``left`` to ``right``, their text like
    ``rx``, below its heading (``head``, by ``head_gap``) if the page shows one. ``slack``: how far above them their row begins.
    """
    own = with_layout(words, layouts.filter("shape = 'P' AND anchor IS NOT NULL").select("bank_id", "anchor"))
    page = Window.partitionBy("file", "page_no")
    heading = F.min(F.when(F.col("text") == F.col("anchor.head"), F.col("top"))).over(page)
    hit = (F.col("x0") >= F.col("anchor.left")) & (F.col("x0") < F.col("anchor.right")) & F.regexp_like("text", F.col("anchor.rx")) & (F.col("top") > F.coalesce(F.col("_heading") + F.col("anchor.head_gap"), F.lit(-1.0)))
    found = own.withColumn("_heading", heading).filter(hit)
    return found.select("file", "bank_id", "page_no", "top", F.row_number().over(page.orderBy("top", "x0")).alias("row_no"), F.col("anchor.slack").alias("slack"))


MAX_LAYOUTS = 10_000


def bounded(layouts: DataFrame) -> bool:
    """Whether a table of layouts is small enough to be sent to every task."""
    return layouts.limit(MAX_LAYOUTS + 1).count() <= MAX_LAYOUTS


def with_layout(rows: DataFrame, layouts: DataFrame) -> DataFrame:
    """Rows with the columns of their bank's layouts. The layouts go to every task: Spark would send the rows there if their files look small, else deal them by bank,
    and either way a bank's rows would be read in one task."""
    return rows.join(F.broadcast(layouts) if bounded(layouts) else layouts.hint("merge"), "bank_id")


def header_columns(words: DataFrame, layouts: DataFrame) -> DataFrame:
    """Columns of pages by their header words: file, page_no, name, left, right. words as for ``word_anchors``.

    A page's header is the first line that shows two or more of its layout's ``heads`` (field -> word). A column reaches
    half way to the words beside it in that line. A page without header has those of the last page before it that has one.
    """
    heads = layouts.filter("shape = 'P' AND heads IS NOT NULL").select("bank_id", F.explode("heads").alias("name", "text")).groupBy("bank_id", "text").agg(F.collect_list("name").alias("names"))
    few = F.broadcast if bounded(heads) else lambda df: df.hint("merge")  # words are never sent to every task, however small their files look
    own = words.join(few(heads.select("bank_id").distinct()), "bank_id").join(few(heads), ["bank_id", "text"], "left")
    # all of a page in one shuffle: where its header is, then the words beside each other in that line
    page = Window.partitionBy("file", "page_no")
    near = page.orderBy((F.col("top") * 1000).cast("bigint")).rangeBetween(int(-1000 * SAME_LINE), int(1000 * SAME_LINE))
    several = F.size(F.array_distinct(F.flatten(F.collect_set("names").over(near)))) >= 2
    tops = own.withColumn("_top", F.when(F.col("names").isNotNull() & several, F.col("top")))
    line = tops.withColumn("_line", F.coalesce(F.abs(F.col("top") - F.min("_top").over(page)) < SAME_LINE, F.lit(False)))
    side = Window.partitionBy("file", "page_no", "_line").orderBy("x0")
    edge = line.withColumns({"left": F.coalesce((F.lag("x1").over(side) + F.col("x0")) / 2, F.lit(0.0)), "right": F.coalesce((F.lead("x0").over(side) + F.col("x1")) / 2, F.lit(1e9))})
    columns = F.transform("names", lambda n: F.struct(n.alias("name"), F.col("left"), F.col("right")))
    found = F.flatten(F.collect_list(F.when(F.col("_line"), columns)))
    pages = edge.groupBy("file", "page_no").agg(found.alias("found")).withColumn("found", F.when(F.size("found") > 0, F.col("found")))
    upto = Window.partitionBy("file").orderBy("page_no").rowsBetween(Window.unboundedPreceding, 0)
    return pages.withColumn("found", F.last("found", ignorenulls=True).over(upto)).filter("found IS NOT NULL").select("file", "page_no", F.inline("found"))


# -- amounts --------------------------------------------------------------------------------------------------------


def _sides(income: Column, expense: Column) -> dict[str, Column]:
    return {"income": F.coalesce(income, zero()).cast(MONEY), "expense": F.coalesce(expense, zero()).cast(MONEY)}


def sign_mode(amount: Column) -> dict[str, Column]:
    return _sides(F.greatest(amount, zero()), F.greatest(-amount, zero()))


def separate_mode(credit: Column, debit: Column, signed: bool = False) -> dict[str, Column]:
    """Two columns. A negative debit is income and a negative credit expense, unless ``signed`` keeps them as reversals."""
    c, d = F.coalesce(credit, zero()), F.coalesce(debit, zero())
    if signed:
        return _sides(c, d)
    return _sides(F.greatest(c, zero()) + F.greatest(-d, zero()), F.greatest(d, zero()) + F.greatest(-c, zero()))


def direction_of(text: Column, words: dict[str, str]) -> Column:
    """The value of the first key that the text holds; null otherwise."""
    found = None
    for k, v in words.items():
        hit = F.contains(F.coalesce(text, F.lit("")), F.lit(k))
        found = F.when(hit, v) if found is None else found.when(hit, v)
    return found if found is not None else F.lit(None).cast("string")


def direction_mode(amount: Column, text: Column, words: dict[str, str]) -> dict[str, Column]:
    side = direction_of(text, words)
    return _sides(F.when(side == "income", F.abs(amount)), F.when(side == "expense", F.abs(amount)))


def flag_mode(amount: Column, flag: Column, credit: str = "C", debit: str = "D") -> dict[str, Column]:
    """Credit or debit flag; a negative amount is a reversal and goes to the other side."""
    f = F.upper(F.substring(F.regexp_replace(F.coalesce(flag, F.lit("")), r"[^A-Za-z一-鿿]", ""), 1, 1))
    up = ((f == credit) & (amount >= 0)) | ((f == debit) & (amount < 0))
    down = ((f == debit) & (amount >= 0)) | ((f == credit) & (amount < 0))
    return _sides(F.when(up, F.abs(amount)), F.when(down, F.abs(amount)))


def named_reversal_mode(amount: Column, text: Column, word: str = "冲正") -> dict[str, Column]:
    """Negative amounts named as reversals count as income."""
    return sign_mode(F.when((amount < 0) & F.contains(F.coalesce(text, F.lit("")), F.lit(word)), -amount).otherwise(amount))


def wallet_mode(amount: Column, direction: Column, neutral=("不计收支", "中性", "/"), income=("收入",), expense=("支出",)) -> dict[str, Column]:
    """Wallet rows: neutral words first, then income, then expense; anything else is neutral."""
    side = direction_of(direction, {**{w: "neutral" for w in neutral}, **{w: "income" for w in income}, **{w: "expense" for w in expense}})
    return _sides(F.when(side == "income", amount), F.when(side == "expense", amount)) | {"neutral": F.coalesce(side, F.lit("neutral")) == "neutral"}


def sheet_mode(credit: Column, debit: Column, amount: Column, direction: Column, words: dict[str, str]) -> dict[str, Column]:
    """Spreadsheet rows: columns if filled, else direction, else sign; a blank direction of a direction column is 0 on both sides and an issue."""
    by_column = credit.isNotNull() | debit.isNotNull()
    side = direction_of(direction, words)
    signed = sign_mode(amount)
    pick = lambda own, word, sign: F.when(by_column, F.coalesce(own, zero())).when(side == word, F.abs(amount)).when(direction.isNull(), sign)
    unknown = ~by_column & direction.isNotNull() & side.isNull()
    return _sides(pick(credit, "income", signed["income"]), pick(debit, "expense", signed["expense"])) | {"issue_codes": F.when(unknown, F.array(F.lit("direction_unknown"))).otherwise(F.array().cast(NO_CODES))}


def told_sides(amount: Column, text: Column, told: Column, words: str = "direction_map") -> dict[str, Column]:
    """What ``by_layout`` asks for many times: the sides that the text and the direction cell name, and that of a flag."""
    first = lambda c: F.try_element_at(F.filter(F.map_entries(words), lambda e: F.contains(F.coalesce(c, F.lit("")), e["key"])), F.lit(1))["value"]
    by_cell = first(told)
    letter = F.upper(F.substring(F.regexp_replace(F.coalesce(told, F.lit("")), r"[^A-Za-z一-鿿]", ""), 1, 1))
    flag = F.coalesce(F.when(letter == "C", "income").when(letter == "D", "expense"), by_cell)
    other = F.when(flag == "income", "expense").when(flag == "expense", "income")
    return {"by_text": first(text), "by_cell": by_cell, "flag": F.when(amount < 0, other).otherwise(flag)}  # a negative amount is a reversal


def by_layout(amount: Column, credit: Column, debit: Column, text: Column, mode: str = "amount_mode", words: str = "direction_map", told: Column | None = None, side: Column | None = None, sides: dict[str, Column] | None = None) -> dict[str, Column]:
    """income, expense, neutral and issue_codes by the joined layout row: its ``amount_mode`` and ``direction_map`` columns decide.

    Modes: sign, separate, signed (columns that keep reversals), direction, flag (C or D, or the map's), reversal (negative
    amounts named as such count as income), wallet (what the map doesn't name is neutral), sheet (columns, else direction, else sign), filtered
    (all to the side that the file was filtered by, else by sign); ``balance`` is told before, by ``line_ledger``. ``text``: what tells the direction; ``told``: the row's
    own direction cell, if that is another column; ``side``: the file's filter; ``sides``: ``told_sides``, if they are columns already. An unknown mode gives 0 and an issue.
    """
    m, none = F.col(mode), F.lit(None).cast("string")
    told, side = text if told is None else told, none if side is None else side
    by_text, by_cell, flag = (sides or told_sides(amount, text, told, words)).values()
    sheet = sheet_mode(credit, debit, amount, told, {})
    by_column = credit.isNotNull() | debit.isNotNull()
    sided = lambda of: _sides(F.when(of == "income", F.abs(amount)), F.when(of == "expense", F.abs(amount)))
    cell = F.when(by_column, none).otherwise(by_cell)
    modes = {
        "sign": sign_mode(amount), "separate": separate_mode(credit, debit), "signed": separate_mode(credit, debit, True), "direction": sided(by_text), "flag": sided(flag),
        "reversal": named_reversal_mode(amount, text), "wallet": sided(by_cell), "filtered": filtered_mode(amount, side),
        "sheet": {k: F.when(cell == k, F.abs(amount)).when(cell.isNotNull(), zero()).otherwise(sheet[k]) for k in ("income", "expense")},
    }
    out = {}
    for k in ("income", "expense"):
        c = None
        for name, cols in modes.items():
            c = F.when(m == name, cols[k]) if c is None else c.when(m == name, cols[k])
        out[k] = F.coalesce(c, zero()).cast(MONEY)
    lost = F.when(m == "direction", by_text.isNull()).when(m == "flag", flag.isNull()).when(m == "sheet", ~by_column & told.isNotNull() & by_cell.isNull())
    codes = [F.when(~m.isin(list(modes)) | m.isNull(), "mode_unknown"), F.when(lost, "direction_unknown")]
    return out | {"neutral": (m == "wallet") & F.coalesce(~by_cell.isin("income", "expense"), F.lit(True)), "issue_codes": F.array_compact(F.array(*codes)).cast(NO_CODES)}


def filter_direction(cells: DataFrame, rows: int = 120) -> DataFrame:
    """Exports that were filtered by direction say so in their first rows: file, direction (income, expense, null for neither); other files are left out."""
    top = cells.filter(F.col("row_no") <= rows).select("file", compact_cell(F.array_join("cells", "")).alias("t")).filter(F.contains("t", F.lit("按收支筛选")))
    says = lambda word: F.max(F.regexp_like("t", F.lit(f"按收支筛选[:：]{word}")))
    return top.groupBy("file").agg(F.when(says("收入"), "income").when(says("支出"), "expense").alias("direction"))


def filtered_mode(amount: Column, direction: Column) -> dict[str, Column]:
    """All of a filtered export's amounts go to its side; others go by sign."""
    sides = sign_mode(amount)
    return _sides(F.when(direction == "income", F.abs(amount)).when(direction == "expense", zero()).otherwise(sides["income"]), F.when(direction == "expense", F.abs(amount)).when(direction == "income", zero()).otherwise(sides["expense"]))


def perspective(own: Column, payer: Column, payer_name: Column, payee: Column, payee_name: Column) -> Column:
    """Name of the account's owner: the payer's where the own account paid, the payee's where it was paid."""
    return F.when(own == payer, payer_name).when(own == payee, payee_name)


def row_codes(balance_needed: bool = True) -> Column:
    """Issue codes of a parsed row."""
    codes = [F.when((F.col("income") != 0) & (F.col("expense") != 0), "both_sides"), F.when((F.col("income") == 0) & (F.col("expense") == 0), "no_amount"), F.when(F.col("transaction_time").isNull(), "no_date")]
    if balance_needed:
        codes.append(F.when(F.col("balance").isNull(), "balance_missing"))
    return F.array_compact(F.array(*codes))


def sheet_ledger(cells: DataFrame, keywords: DataFrame | dict[str, list[str]] | None = None) -> DataFrame:
    """Spreadsheet rows to ledger rows by header roles (date, time, credit, debit, amount, direction, balance)."""
    rows = with_roles(cells, role_words(keywords) if isinstance(keywords, DataFrame) else keywords or ROLE_WORDS)
    # read once into columns of their own: the modes refer to them many times
    rows = rows.withColumns({f"_{c}": sheet_money(cell(c)) for c in ("credit", "debit", "amount")} | {"_direction": cell("direction")})
    amounts = sheet_mode(F.col("_credit"), F.col("_debit"), F.col("_amount"), F.col("_direction"), {"收": "income", "贷": "income", "支": "expense", "借": "expense"})
    out = rows.select(F.col("file").alias("source_file"), "page_no", "table_no", "row_no", sheet_timestamp(cell("date"), cell("time")).alias("transaction_time"), cell("date").alias("raw_time"), *[c.alias(n) for n, c in amounts.items()], sheet_money(cell("balance")).alias("balance"), F.coalesce(cell("amount"), cell("credit"), cell("debit")).alias("raw_amount"), cell("balance").alias("raw_balance"), F.array_join("cells", " ").alias("raw_text"), F.col("cells").alias("raw_fields"))
    return best_table(out.filter("transaction_time IS NOT NULL"), "table_no", "source_file")


def _by_layout_rows(rows: DataFrame, row_no: str) -> DataFrame:
    """Ledger rows from text fields (raw_time, raw_clock, raw_amount, raw_credit, raw_debit, raw_direction, raw_balance, raw_text) and the joined layout."""
    clock = F.regexp_replace("raw_clock", r"^(\d{2})(\d{2})(\d{2})$", "$1:$2:$3")
    told = F.coalesce("raw_direction", "raw_text")
    read = {"_amount": sheet_money(F.col("raw_amount")), "_credit": sheet_money(F.col("raw_credit")), "_debit": sheet_money(F.col("raw_debit")), "_told": told, "balance": sheet_money(F.col("raw_balance")), "transaction_time": sheet_timestamp(F.col("raw_time"), clock)}
    # generated, not projected: the condition on the time would be told twice
    df = rows.drop(*read).select("*", F.inline(F.array(F.struct(*[v.alias(c) for c, v in read.items()])))).filter("transaction_time IS NOT NULL")
    side = F.col("filter_direction") if "filter_direction" in rows.columns else None
    wallet = F.when(F.col("amount_mode") == "sheet", F.col("raw_direction")).otherwise(F.col("_told"))
    sides = told_sides(F.col("_amount"), F.col("_told"), wallet)
    amounts = by_layout(F.col("_amount"), F.col("_credit"), F.col("_debit"), F.col("_told"), told=wallet, side=side, sides={k: F.col(f"_{k}") for k in sides})
    flags = [c for c in ("preserve_signed", "balance_optional", "balance_tolerance", "order_policy", "shape") if c in rows.columns]
    out = df.select("*", F.inline(F.array(F.struct(*[v.alias(f"_{k}") for k, v in sides.items()])))).withColumns(amounts)
    # a neutral row moves nothing by rule, so it isn't one without an amount
    seen = F.array_except(row_codes(False), F.when(F.col("neutral"), F.array(F.lit("no_amount"))).otherwise(F.array().cast(NO_CODES)))
    missing = F.when(F.col("balance").isNull() & ~F.col("balance_optional"), F.array(F.lit("balance_missing"))).otherwise(F.array().cast(NO_CODES)) if "balance_optional" in rows.columns else F.array().cast(NO_CODES)
    codes = F.array_distinct(F.concat("issue_codes", seen, missing)).alias("issue_codes")
    return out.select(F.col("file").alias("source_file"), "bank_id", "page_no", F.col(row_no).alias("row_no"), "transaction_time", "raw_time", F.coalesce("raw_amount", "raw_credit", "raw_debit").alias("raw_amount"), "raw_balance", "raw_text", "income", "expense", "balance", "neutral", codes, *flags)


#: A layout's field -> the text column that it fills.
FIELDS = {"date": "raw_time", "time": "raw_clock", "amount": "raw_amount", "credit": "raw_credit", "debit": "raw_debit", "direction": "raw_direction", "balance": "raw_balance", "text": "raw_text"}


def row_blocks(lines: DataFrame, layouts: DataFrame, look=chain.beside) -> DataFrame:
    """Rows of several lines, one text a row with its layout's columns: lines from one like ``block.start`` to the next, without those like ``block.skip``.

    Lines before a file's first start belong to no row. Only one row's lines must fit a task; where a whole file doesn't,
    ``look`` is ``carry.beside``.
    """
    own = with_layout(lines, layouts.select("bank_id", F.col("rx").alias("_rx"), "block", "skip_keywords"))
    own = own.filter(~F.exists("skip_keywords", lambda k: F.contains("text", k))).withColumn("text", F.trim("text"))
    own = own.filter(~F.regexp_like("text", F.col("block.skip"))).withColumn("_start", F.when(F.regexp_like("text", F.col("block.start")), F.struct("page_no", "line_no")))
    of = ["file", "bank_id", "_rx"]
    placed = look(own.select(*of, "page_no", "line_no", "text", "_start"), of, order=["page_no", "line_no"], known=["_start"])
    placed = placed.withColumn("_at", F.coalesce("_start", "_known__start")).filter("_at IS NOT NULL")
    whole = placed.groupBy(*of, "_at").agg(F.array_sort(F.collect_list(F.struct("page_no", "line_no", "text"))).alias("_lines"))
    text = F.array_join(F.transform("_lines", lambda r: r["text"]), " ").alias("text")
    rows = whole.select("file", "bank_id", "_rx", F.col("_at.page_no").alias("page_no"), F.col("_at.line_no").alias("line_no"), text)
    return with_layout(rows, layouts).filter(F.col("_rx").eqNullSafe(F.col("rx"))).drop("_rx")


def line_ledger(lines: DataFrame, layouts: DataFrame, look=chain.beside) -> DataFrame:
    """Text lines to ledger rows by the layout's pattern; ``columns`` tell which group is what (without: 1 date, 2 amount, 3 balance, 4 text); skip words drop lines.

    Layouts with a ``block`` are read from ``row_blocks``, those with ``parts`` by these.
    """
    known = layouts.filter("shape = 'L' AND rx IS NOT NULL")
    alone = known.filter("block IS NULL") if "block" in layouts.columns else known
    joined = with_layout(lines, alone).filter(~F.exists("skip_keywords", lambda k: F.contains("text", k)))
    if alone is not known:
        joined = joined.unionByName(row_blocks(lines, known.filter("block IS NOT NULL"), look), allowMissingColumns=True)
    hit = joined.filter(F.regexp_like("text", F.col("rx")))
    if "columns" not in layouts.columns:
        hit = hit.withColumn("columns", F.create_map(*[x for k, v in {"date": 1, "amount": 2, "balance": 3, "text": 4}.items() for x in (F.lit(k), F.lit(v))]))
    group = lambda f: F.nullif(F.call_function("regexp_extract", F.col("text"), F.col("rx"), F.coalesce(F.try_element_at("columns", F.lit(f)), F.lit(0))), F.lit(""))
    found = {c: F.when(F.map_contains_key("columns", f), group(f)) for f, c in FIELDS.items()}
    if "parts" in layouts.columns:
        nth = lambda p: F.struct(p["name"], F.try_element_at(F.regexp_extract_all(F.col("text"), p["rx"], F.lit(0)), p["at"]))
        hit = hit.withColumn("_parts", F.map_from_entries(F.transform("parts", nth)))
        found = {c: F.coalesce(F.try_element_at("_parts", F.lit(f)), found[c]) for f, c in FIELDS.items()}
    # generated, not projected: a condition on what is made of a field would carry the field's patterns below, as often as it is written
    read = hit.select("*", F.inline(F.array(F.struct(*[v.alias(c) for c, v in found.items()]))))
    if layouts.filter("amount_mode = 'balance'").isEmpty():
        return _by_layout_rows(read, "line_no")
    return _by_layout_rows(read.filter("amount_mode <> 'balance'").unionByName(_told_by_balance(read.filter("amount_mode = 'balance'"))), "line_no")


def _told_by_balance(rows: DataFrame) -> DataFrame:
    """Rows without sign or direction: down if the balance fell by the amount since the file's row before, else up; a row that fits neither breaks the balance chain and is found there."""
    amount, balance = sheet_money(F.col("raw_amount")), sheet_money(F.col("raw_balance"))
    moved = balance - F.lag(balance).over(in_order())
    side = F.when(moved == -amount, "expense").otherwise("income")
    return rows.withColumns({"raw_direction": side, "amount_mode": F.lit("direction"), "direction_map": F.create_map(*[F.lit(x) for x in ("income", "income", "expense", "expense")])})


def cell_ledger(cells: DataFrame, layouts: DataFrame, words: dict[str, list[str]] | None = None) -> DataFrame:
    """Cell rows (shapes C and M) to ledger rows by the layout's amount mode; columns are found by header words.

    cells(file, bank_id, page_no, table_no, row_no, cells). Cells of shape M hold several rows each. Exports of mode
    ``filtered`` tell in their first rows which side they were filtered by.
    """
    known = layouts.filter("shape IN ('C', 'M')")
    rows = with_layout(cells, known)
    sides = filter_direction(rows.filter("amount_mode = 'filtered'").select("file", "row_no", "cells")).withColumnRenamed("direction", "filter_direction")
    single = rows.filter("shape = 'C'")
    many = unpack_cells(rows.filter("shape = 'M'"))
    headed = with_roles(single.unionByName(many), words or WALLET_WORDS).join(sides, "file", "left")
    found = {c: cell({"text": "type"}.get(f, f)) for f, c in FIELDS.items()}
    kept = headed.filter(~F.exists("skip_keywords", lambda k: F.contains(F.array_join("cells", ""), k)))
    # generated, not projected, as in line_ledger
    return _by_layout_rows(kept.select("*", F.inline(F.array(F.struct(*[v.alias(c) for c, v in found.items()])))), "row_no")


def word_ledger(words: DataFrame, anchors: DataFrame | None, layouts: DataFrame) -> DataFrame:
    """Positioned words (shape P) to ledger rows by the layout's boxes, or by its header words where it has no boxes.

    anchors(file, bank_id, page_no, top, row_no): where rows start; without them words(file, bank_id, ...) are matched
    with each layout's own ``anchor``.
    """
    own = words if anchors is None else None
    if anchors is None:
        anchors = word_anchors(words, layouts)
    layouts = layouts.filter("shape = 'P'")
    files = anchors.select("file", "bank_id").distinct()
    boxed = with_layout(files, layouts.filter("boxes IS NOT NULL").select("bank_id", F.inline("boxes"))).drop("bank_id")
    boxed = boxed if "rx" in boxed.columns else boxed.withColumn("rx", F.lit(None).cast("string"))
    starts = anchors.select("file", "page_no", "top", "row_no", *[c for c in ("slack",) if c in anchors.columns])
    put = band_cells(words, starts, boxed)
    if not layouts.filter("boxes IS NULL AND heads IS NOT NULL").isEmpty():
        named = words.drop("bank_id").join(files.hint("merge"), "file") if own is None else own
        put = put.unionByName(band_cells(words, starts, header_columns(named, layouts.filter("boxes IS NULL"))))
    # one map a row: what a field holds, in one shuffle
    wide = put.groupBy("file", "page_no", "row_no").agg(F.map_from_entries(F.collect_list(F.struct("name", "text"))).alias("fields"))
    named = wide.select("file", "page_no", "row_no", *[F.try_element_at("fields", F.lit(f)).alias(c) for f, c in FIELDS.items()])
    return _by_layout_rows(named.join(with_layout(files, layouts.drop("columns", "boxes", "anchor", "heads", "rx", "block", "parts")).hint("merge"), "file"), "row_no")
