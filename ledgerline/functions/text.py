"""Date, text and array columns of statement rows (JVM expressions only)."""

from __future__ import annotations

import re
from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values: (name, pattern whose groups are the parts, Spark format of the parts joined by a blank).
DATE_FORMATS = [
    ("datetime", r"(\d{4}-\d{1,2}-\d{1,2})\s*(\d{1,2}:\d{2}:\d{2})", "yyyy-M-d H:mm:ss"),
    ("iso", r"(\d{4}-\d{1,2}-\d{1,2})", "yyyy-M-d"),
    ("slash", r"(\d{4}/\d{1,2}/\d{1,2})", "yyyy/M/d"),
    ("dot", r"(\d{4}\.\d{1,2}\.\d{1,2})", "yyyy.M.d"),
    ("compact8", r"(?<!\d)(\d{8})(?!\d)", "yyyyMMdd"),
    ("compact6", r"(?<!\d)(\d{6})(?!\d)", "yyMMdd"),
]
#: Words of corporate account names.
CORPORATE_WORDS = ["公司", "有限", "企业", "个体工商户", "经营部", "商行", "店", "厂", "合作社", "工作室", "事务所", "中心"]
#: Words of salary rows in documents, words that rule a row out there, and words of salary rows in listings.
SALARY_WORDS = ["工资", "薪资", "薪酬", "奖金", "奖", "代发工资"]
SALARY_EXCLUDED = ["补助", "补贴", "补增资", "报销", "退款"]
SALARY_LISTING_WORDS = ["工资", "代发", "薪资", "薪酬", "奖金"]
#: Words dropped from a bank's label, and display names of what is left.
BANK_WORDS = ["银行", "个人", "对公", "流水", "导入"]
BANK_NAMES = {"上海浦东发展": "浦发", "spdb": "浦发", "spdb_corp": "浦发", "中国邮政储蓄": "邮政", "邮储": "邮政", "psbc": "邮政"}
#: Labels of account numbers, and of wallet names that stand for them; lines about the other side.
NUMBER = r"([0-9][0-9\s\-*＊]{6,30}[0-9])"
ACCOUNT_LABELS = [
    r"客户账号\s*(?:Account No\.?|Account Number)?\s*[:：]?\s*", r"账号/卡号\s*(?:Account/Card No\.?)?\s*[:：]?\s*", r"Account/Card\s*No\.?\s*[:：]?\s*",
    r"账号\s*(?:Account No\.?|Account Number)?\s*[:：]?\s*", r"账户\s*(?:Account No\.?|Account Number)?\s*[:：]?\s*", r"卡号\s*[:：]?\s*", r"银行卡号\s*[:：]?\s*", r"Account\s*(?:No\.?|Number)\s*[:：]?\s*",
]
WALLET_LABEL = r"微信号\s*[:：]\s*([A-Za-z0-9_.@-]+)"
OTHER_SIDE = ["对方账号", "对手账号"]
#: Characters that text recognition takes for digits.
OCR_FROM, OCR_TO = "OoIlSB", "001158"


def parse_date(text: Column) -> Column:
    """struct(ts, format): the first format that reads a date in the text."""
    found = []
    for name, rx, fmt in DATE_FORMATS:
        parts = [F.regexp_extract(text, rx, k + 1) for k in range(re.compile(rx).groups)]
        found.append((name, F.try_to_timestamp(F.concat_ws(" ", *parts), F.lit(fmt))))
    ts = F.coalesce(*[t for _, t in found])
    name = F.coalesce(*[F.when(t.isNotNull(), F.lit(n)) for n, t in found])
    return F.struct(ts.alias("ts"), name.alias("format"))


def first_format(text: Column, formats: list[str]) -> Column:
    """The first of several formats that reads the whole text."""
    return F.coalesce(*[F.try_to_timestamp(F.trim(text), F.lit(f)) for f in formats])


def sheet_timestamp(day: Column, clock: Column | None = None) -> Column:
    """Spreadsheet date with CJK marks, glued clock or a clock column of its own; digits misread as letters are put right."""
    t = F.translate(day, "年月日　" + OCR_FROM, "//  " + OCR_TO)
    t = F.regexp_replace(F.regexp_replace(t, r"[.\-]", "/"), r"/\s*(?=\d{1,2}:)|/$", " ")
    ymd = F.regexp_extract(t, r"(\d{4}/\d{1,2}/\d{1,2}|\d{8})", 1)
    rest = F.regexp_extract(t, r"(\d{1,2}:\d{2}(:\d{2})?)", 1)
    hms = F.coalesce(*([clock] if clock is not None else []), F.nullif(rest, F.lit("")), F.lit("0:00:00"))
    hms = F.when(F.length(hms) - F.length(F.regexp_replace(hms, ":", "")) == 1, F.concat(hms, F.lit(":00"))).otherwise(hms)
    whole = F.concat_ws(" ", ymd, hms)
    return F.coalesce(F.try_to_timestamp(whole, F.lit("yyyy/M/d H:mm:ss")), F.try_to_timestamp(whole, F.lit("yyyyMMdd H:mm:ss")))


def repair_clock(text: Column) -> Column:
    """hmm:ss and the like to h:mm:ss; an impossible clock becomes midnight."""
    t = F.regexp_replace(text, r"^(\d{1,2})(\d{2}):(\d{2})$", "$1:$2:$3")
    return F.when(F.regexp_like(t, F.lit(r"^([01]?\d|2[0-3]):[0-5]\d:[0-5]\d$")), t).otherwise("0:00:00")


def end_of_day(day: Column, clock: str = "23:59:59") -> Column:
    return F.try_to_timestamp(F.concat_ws(" ", F.date_format(day, "yyyy-MM-dd"), F.lit(clock)), F.lit("yyyy-MM-dd HH:mm:ss"))


def joined_timestamp(text: Column) -> Column:
    """Timestamps broken by stray characters or a split year: the digits count."""
    return F.try_to_timestamp(F.substring(F.regexp_replace(text, r"\D", ""), 1, 14), F.lit("yyyyMMddHHmmss"))


def month_key(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def month_shown(month: Column) -> Column:
    return F.regexp_replace(month, "-", ".")


def has_clock(raw_time: Column) -> Column:
    t = F.coalesce(raw_time, F.lit(""))
    return F.contains(t, F.lit(":")) | (F.length(F.regexp_replace(t, r"\D", "")) >= 14)


def month_range(text: str) -> tuple[str | None, str | None]:
    """Job parameter such as ``2025-11~2026-04``, ``25年11月-26年4月``, ``2511-2604``, one month, or ``all`` -> first and last month."""
    text = text.strip().lower()
    if text in ("", "all", "全部"):
        return None, None
    whole = re.fullmatch(r"(\d{6}|\d{4})(?:\s*[-~至]\s*(\d{6}|\d{4}))?", text)
    found = [(x[:-2], x[-2:]) for x in whole.groups() if x] if whole else re.findall(r"(\d{4}|\d{2})\s*[年./-]\s*(\d{1,2})", text)
    months = [f"{int(y) + 2000 * (len(y) == 2):04d}-{int(m):02d}" for y, m in found]
    if not months or len(months) > 2 or any(not 1 <= int(m[5:]) <= 12 for m in months):
        raise ValueError(f"not a range of months: {text!r}")
    return min(months), max(months)


def default_months(today: date, n: int = 6, from_day: int | None = None) -> tuple[str, str]:
    """The last n months; this month counts from a day on only, if one is given."""
    last = today.year * 12 + today.month - 1 - (from_day is not None and today.day < from_day)
    return tuple(f"{k // 12:04d}-{k % 12 + 1:02d}" for k in (last - n + 1, last))


def clean_cell(c: Column) -> Column:
    """Full-width blanks, line breaks and runs of blanks to one blank."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"[\s　]+", " "))


def compact_cell(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"[\s　]+", "")


def account_number(c: Column, lines: int = 80) -> Column:
    """Account number in the first lines of a text: a wallet's name, else the first labelled number of 8 to 22 digits or masks that isn't a date.

    Blank lines and lines about the other side don't count; of each label the first number counts.
    """
    head = F.slice(F.split(F.coalesce(c, F.lit("")), "\r?\n"), 1, lines)
    head = F.array_join(F.filter(F.transform(head, lambda x: F.trim(x)), lambda x: (x != "") & ~has_any(x, OTHER_SIDE)), "\n")
    found = []
    for label in ACCOUNT_LABELS:
        t = F.translate(F.regexp_replace(F.regexp_extract(head, "(?i)" + _wide(label + NUMBER), 1), r"[^0-9*＊]", ""), "＊", "*")
        found.append(F.when(F.length(t).between(8, 22) & ~F.regexp_like(t, F.lit(r"^20\d{6}$")) & F.regexp_like(t, F.lit(r"\d")), t))
    return F.coalesce(F.nullif(F.regexp_extract(head, "(?i)" + WALLET_LABEL, 1), F.lit("")), *found)


def _wide(pattern: str) -> str:
    """A pattern whose white space takes the full-width blank, too, which Java's doesn't."""
    return pattern.replace(r"\s*", r"[\s　]*").replace(r"\s+", r"[\s　]+").replace(r"[^\s", r"[^\s　").replace(r"[0-9\s", r"[0-9\s　")


#: Patterns of account holders' names, the first that matches counts.
OWNER_PATTERNS = [
    r"兹证明\s*[:：]\s*([^\s（(，,]+)\s*[（(]",
    r"户名\s*(?:Account Name)?\s*[:：]\s*([^\s，,]+)",
    r"客户姓名\s*[:：]\s*([^\s，,]+)",
    r"客户名称\s*[:：]\s*([^\s，,]+)",
    r"账户名称\s*[:：]\s*([^\s，,]+)",
    r"户主\s*[:：]\s*([^\s，,]+)",
    r"Account Name\s*[:：]\s*([^\s，,]+)",
    r"账户\s+[0-9][0-9\s\-*＊]{6,30}[0-9]\s+([^\s，,]+)",
]


def owner_name(c: Column) -> Column:
    """Name of the account's holder in a statement's text; null where no label names one."""
    return first_label(c, ["(?i)" + _wide(p) for p in OWNER_PATTERNS])


def first_label(c: Column, patterns: list[str]) -> Column:
    """Group 1 of the first pattern that matches."""
    return F.coalesce(*[F.nullif(F.trim(F.regexp_extract(c, p, 1)), F.lit("")) for p in patterns])


def bank_name(label: Column, layout: Column | None = None, names: dict[str, str] | None = None) -> Column:
    """Short display name of a bank from its label, else its layout; spreadsheets have none but one; unknown ones are blank."""
    layout = F.lit("") if layout is None else F.coalesce(layout, F.lit(""))
    t = F.trim(F.coalesce(F.nullif(label, F.lit("")), layout))
    t = F.when(F.regexp_like(t, F.lit(r"^\?*$")), "").otherwise(F.trim(F.regexp_replace(t, "|".join(BANK_WORDS), "")))
    pairs = [F.lit(x) for kv in (BANK_NAMES if names is None else names).items() for x in kv]
    t = F.coalesce(F.try_element_at(F.create_map(*pairs), t), t) if pairs else t
    sheet = F.when(F.contains(F.coalesce(label, F.lit("")), F.lit("中国银行")), "中国").otherwise("")
    return F.when(layout == "excel", sheet).when(F.startswith(t, F.lit("Excel")), "").otherwise(t)


def has_any(c: Column, words: list[str]) -> Column:
    return F.regexp_like(F.coalesce(c, F.lit("")), F.lit("|".join(map(re.escape, words))))


def is_salary(income: Column, raw_text: Column, fields: Column, raw_amount: Column | None = None, words: list[str] = SALARY_WORDS, excluded: list[str] | None = SALARY_EXCLUDED) -> Column:
    """Income whose text, fields or amount cell name a salary, and nothing that rules it out. Listings take ``SALARY_LISTING_WORDS`` and exclude nothing."""
    t = F.concat(F.coalesce(raw_text, F.lit("")), F.lit(" | "), F.array_join(F.coalesce(fields, F.array().cast("array<string>")), " | ", ""), F.lit(" | "), F.coalesce(raw_amount, F.lit("")) if raw_amount is not None else F.lit(""))
    return (F.coalesce(income, F.lit(0)) > 0) & has_any(t, words) & (~has_any(t, excluded) if excluded else F.lit(True))


def safe_name(c: Column) -> Column:
    return F.left(F.regexp_replace(F.coalesce(c, F.lit("")), r'[\\/:*?"<>|\s]+', "_"), F.lit(30))


def right_of(cells: Column, label: str) -> Column:
    """The cell right of the first cell that equals the label."""
    at = F.array_position(cells, label)
    return F.when(at > 0, F.nullif(F.trim(F.try_element_at(cells, (at + 1).cast("int"))), F.lit("")))


def ordered_chars(text: Column, phrase: str, max_gap: int = 80) -> Column:
    """The phrase's characters occur in order, each at most ``max_gap`` after the one before; first occurrences only, no backtracking."""
    chars = F.array(*[F.lit(c) for c in phrase])
    start = F.struct(F.lit(0).alias("at"), F.lit(True).alias("ok"))

    def step(s, c):
        here = F.position(c, text, s["at"] + 1)
        near = (here > 0) & ((s["at"] == 0) | (here - s["at"] <= max_gap))
        return F.struct(F.when(s["ok"] & near, here).otherwise(s["at"]).cast("int").alias("at"), (s["ok"] & near).alias("ok"))

    return F.aggregate(chars, start, step, lambda s: s["ok"])
