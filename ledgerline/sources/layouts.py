"""The registry of layouts: how each issuer's lines, cells or words become ledger rows. Adding a layout adds a row.

``columns`` are pattern groups of lines (L), of which those of one ``block`` are joined first: lines that don't look like its
``start`` go to the row before, lines like ``skip`` to none. ``parts`` name fields by what matches them in such a row, from
the left (1, 2, ...) or from the right (-1, -2, ...); cells (C, M) find their columns by header words. Words (P) have ``boxes``
(which edge of a word counts, from where to where, how far above and below the row's anchor, which part of a word is taken) or ``heads`` (header words
that show where columns are), and an ``anchor``: which words start a row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BOX = "struct<name:string,at:string,left:double,right:double,above:double,below:double,rx:string>"
BLOCK = "struct<start:string,skip:string>"
PART = "struct<name:string,rx:string,at:int>"
ANCHOR = "struct<rx:string,left:double,right:double,head:string,head_gap:double,slack:double>"
SCHEMA = (
    f"bank_id string, shape string, rx string, columns map<string,int>, boxes array<{BOX}>, anchor {ANCHOR}, heads map<string,string>, amount_mode string, direction_map map<string,string>, order_policy string, "
    f"skip_keywords array<string>, preserve_signed boolean, balance_optional boolean, balance_tolerance decimal(18,2), block {BLOCK}, parts array<{PART}>"
)
_SIDES = {"收入": "income", "支出": "expense"}
_BOOKS = {"贷": "income", "借": "expense"}
#: What wallets call the sides; what isn't named is neutral.
_WALLET = {"其他": "neutral", "不计收支": "neutral", "中性": "neutral", "收入": "income", "收款": "income", "转入": "income", "退款": "income", "支出": "expense", "付款": "expense", "转出": "expense", "提现": "expense"}
#: What sheets call the sides.
_SHEET = {"收": "income", "贷": "income", "支": "expense", "借": "expense"}
_TOTALS = ["合计", "总计", "小计"]
_DATE = r"^20\d{2}[-./]?\d{2}[-./]?\d{2}"
_ISO, _CLOCK = r"^20\d{2}-\d{2}-\d{2}$", r"^\d{2}:\d{2}:\d{2}$"
_MONEY = r"\d[\d,]*\.\d{2}"
#: A row of three amounts of the generic layout; rows with one amount and a balance are all others.
_THREE = r"(20\d{2}[/-]\d{1,2}[/-]\d{1,2}\s+\d{1,2}:\d{2}:\d{2})\s+(\d[\d,]*(?:\.\d{1,2})?)\s+(\d[\d,]*(?:\.\d{1,2})?)\s+(\d[\d,]*(?:\.\d{1,2})?)\b"
_ONE = r"(20\d{2}[/-]\d{1,2}[/-]\d{1,2}\s+\d{1,2}:\d{2}:\d{2})\s+(.*?)\s+([+-]?\d[\d,]*\.\d{2})\s+(\d[\d,]*\.\d{2})\b"
GENERIC = [("separate", r"^(?:卡\s+\S+\s+)?" + _THREE, {"date": 1, "credit": 2, "debit": 3, "balance": 4}), ("sign", rf"^(?!(?:卡\s+\S+\s+)?{_THREE})(?:卡\s+\S+\s+)?" + _ONE, {"date": 5, "text": 6, "amount": 7, "balance": 8})]

_ANY, _GROUPED = r"[\d,]+\.\d{2}", r"(?:\d{1,3}(?:,\d{3})+|\d+)\.\d{2}"
# Line patterns and their groups.
LINES = [
    ("changsha", r"^(20\d{2}-\d{2}-\d{2})\s+([+-]\d[\d,]*\.\d{2})\s+(\d[\d,]*\.\d{2})(?:\s+(.*))?$", {"date": 1, "amount": 2, "balance": 3, "text": 4}, "sign", {}, "source"),
    ("shengjing", r"^(20\d{6})\s+人民币\s+([+-]?\d[\d,]*\.\d{2})\s+(\d[\d,]*\.\d{2})\s+(.*)$", {"date": 1, "amount": 2, "balance": 3, "text": 4}, "sign", {}, "source"),
    ("shanghai", r"^(\d{8})\s+(.+?)\s+CNY\s+([+-]?\d[\d,]*\.\d{2})\s+([+-]?\d[\d,]*\.\d{2})(.*)$", {"date": 1, "text": 2, "amount": 3, "balance": 4}, "sign", {}, "reverse_time"),
    ("xingtai", r"^(20\d{2}-\d{2}-\d{2})\s+(收入|支出)\s+(\d[\d,]*\.\d{2})\s+(\d[\d,]*\.\d{2})\s+(.*)$", {"date": 1, "direction": 2, "amount": 3, "balance": 4, "text": 5}, "direction", _SIDES, "source"),
    ("everbright_corp", r"^(\d+)\s+(20\d{6})\s+(\d{6})\s+(借方|贷方)\s+(\d[\d,]*\.\d{2})\s+(\d[\d,]*\.\d{2})(?:\s+(.*))?$", {"date": 2, "time": 3, "direction": 4, "amount": 5, "balance": 6, "text": 7}, "direction", _BOOKS, "reverse_time"),
    ("cmb", r"^(\d{4}-\d{2}-\d{2})\s+CNY\s+([+-]?\d[\d,]*\.?\d{0,2})\s+(\d[\d,]*\.?\d{0,2})(?:\s+(\S+)(?:\s+.*)?)?$", {"date": 1, "amount": 2, "balance": 3, "text": 4}, "sign", {}, "source"),
    ("chaoyang_corp", r"^(20\d{2}-\d{2}-\d{2})\s+(\d{2}:\d{2}:\d{2})\s+(收入|支出)\s+([+-]?[\d,]+\.\d{2})\s+([\d,]+\.\d{2})(?:\s+(.*))?$", {"date": 1, "time": 2, "direction": 3, "amount": 4, "balance": 5, "text": 6}, "direction", _SIDES, "reverse_time"),
    ("hebei_personal", r"^(\d{8})\s+([借贷])\s+(-?(?:\d{1,3}(?:,\d{3})+|\d+)\.\d{2})\s+((?:\d{1,3}(?:,\d{3})+|\d+)\.\d{2})\s+(.*)$", {"date": 1, "direction": 2, "amount": 3, "balance": 4, "text": 5}, "direction", _BOOKS, "reverse_day"),
    ("abc", r"^(\d{8})(?:\s+(\d{6}))?\s+(\S+)\s+([+-]?\d[\d,]*\.\d{2})\s+(\d[\d,]*\.\d{2})(?:\s+(.*))?$", {"date": 1, "time": 2, "text": 3, "amount": 4, "balance": 5}, "sign", {}, "source"),
    ("boc_corp", r"(20\d{6})(\d{2}:\d{2}:\d{2})\s+CNY\s+(-?[\d,]+\.\d{2})([\d,]+\.\d{2})\s+20\d{6}", {"date": 1, "time": 2, "amount": 3, "balance": 4}, "sign", {}, "print_order"),
    ("citic", r"^(20\d{6})\s+RMB\s+([\d,]+\.\d{2})\s+RMB\s+([\d,]+\.\d{2})\s+(.*)$", {"date": 1, "amount": 2, "balance": 3, "text": 4}, "balance", {}, "source"),
    ("cmbc_corp", rf"^(\d{{4}}/\d{{2}}/\d{{2}})\s+.*?\s+({_MONEY})\s+({_MONEY})\s+({_MONEY})\s+", {"date": 1, "debit": 2, "credit": 3, "balance": 4}, "separate", {}, "source"),
    ("customer_detail_corp", r"(20\d{6})\s+([+-][\d,]+\.\d{2})\s+([\d,]+\.\d{2})\s+(.+)$", {"date": 1, "amount": 2, "balance": 3, "text": 4}, "sign", {}, "source"),
    ("cmb_corp", rf"^(20\d{{6}})\s*\S+\s+(?:.*?\s+)?(-?{_ANY})\s+({_ANY}).*$", {"date": 1, "amount": 2, "balance": 3, "text": 0}, "sign", {}, "source"),
    ("bazhou_shunfeng_corp", rf"^\d{{4}}-\d{{2}}-\d{{2}}\b(?:.*?{_GROUPED}){{3}}.*$", {"text": 0}, "separate", {}, "source"),
    ("rural_commercial", r"^\s*(\d+)\s+(.+?)\s+人民币元\s+钞\s+(20\d{6})\s+(-?\d[\d,]*\.\d{2})\s+(\d[\d,]*\.\d{2})(?:\s+(.*))?$", {"text": 2, "date": 3, "amount": 4, "balance": 5}, "sign", {}, "reverse_all"),
]
# Rows of several lines: how a row starts, and what lines belong to none.
BLOCKS = {
    "bazhou_shunfeng_corp": (r"^\d{4}-\d{2}-\d{2}\b", r"^(?:提示|第|$)"),
    "cmb_corp": (rf"^20\d{{6}}\s*\S+\s+(?:.*?\s+)?-?{_ANY}\s+{_ANY}", r"^(?:第|特别提示|If |若|$)"),
    "customer_detail_corp": (r"20\d{6}\s+[+-][\d,]+\.\d{2}\s+[\d,]+\.\d{2}\s+.+$", r"^(?:对公客户账户明细|打印日期|打印时间|账 号|客户名称|起始日期|交易日期|借方合计|贷方合计|$)"),
}
# Fields of such rows by their place among what matches.
PARTS = {"bazhou_shunfeng_corp": [("date", r"^\d{4}-\d{2}-\d{2}\b", 1), ("time", r"\b\d{2}:\d{2}:\d{2}\b", 1), ("debit", _GROUPED, -3), ("credit", _GROUPED, -2), ("balance", _GROUPED, -1)]}
# Edges of word columns, which column is what, and the heading of the date column.
EDGES = [
    ("guangxi_rural", [20, 50, 104, 190, 280, 360, 400, 475, 548, 620, 685, 746, 815], {"date": 1, "amount": 6, "balance": 7, "text": 9}, "交易时间", "sign", "trail"),
    ("hengfeng", [65, 125, 165, 230, 300, 420, 545], {"date": 0, "amount": 2, "balance": 3, "text": 4}, "记账日期", "sign", "trail_reverse"),
    ("tiantai_rural", [35, 75, 100, 140, 180, 215, 280, 385, 465, 500, 560], {"date": 0, "amount": 3, "balance": 4, "text": 2}, "交易日期", "sign", "trail"),
    ("mintai", [0, 48, 103, 157, 213, 392, 470, 556], {"date": 0, "credit": 1, "debit": 2, "balance": 3, "text": 6}, "交易日期", "separate", "trail_reverse"),
    ("yongxing_rural", [40, 122, 195, 248, 335, 425, 480, 570], {"date": 0, "amount": 1, "balance": 2, "text": 5}, "交易时间", "sign", "trail_reverse"),
    ("mengshang", [20, 70, 198, 250, 268, 330, 412, 473, 675, 835], {"date": 4, "amount": 5, "balance": 6, "text": 1}, "交易日期", "sign", "trail"),
    ("qingdao_rural_corp", [45, 125, 195, 265, 350, 555], {"date": 0, "amount": 1, "balance": 2, "text": 3}, "记账日期", "sign", "trail"),
]
#: How far below a row's date its date cell and its amounts reach, how far above it the row begins, and the gap below the heading.
DATE_BELOW, MONEY_BELOW, ROW_ABOVE, HEAD_GAP = 18.0, 7.0, 2.0, 8.0
_PLAIN = r"(?:\d{1,3}(?:,\d{3})*|\d+)\.\d{2}"
# Boxes of words: (field, which edge, from, to, above, below and, if not the whole word, what is taken of it); the anchor: (pattern, from, to, above).
BOXES = [
    ("dezhou_corp", [("date", "left", 45, 100, 12, 0), ("time", "left", 45, 90, 1, 1), ("credit", "right", 170, 174.01, 1, 1.01), ("debit", "right", 215, 219.01, 1, 1.01), ("balance", "right", 283, 287.01, 1, 1.01)], (_CLOCK, 45, 90, 12), "signed", "same_time_score"),
    ("huishang", [("date", "left", 0, 70, 1, 1), ("amount", "left", 125, 190, 1, 45), ("balance", "left", 190, 260, 1, 45)], (_ISO, 0, 70, 1), "sign", "reverse_all"),
    ("huishang_corp", [("date", "left", 10, 65.01, 1, 1), ("time", "left", 15, 60.01, None, None), ("credit", "left", 55, 98, None, None), ("debit", "left", 98, 140, None, None), ("balance", "left", 140, 190, None, None)], (_ISO, 10, 65.01, 3), "signed", "same_time_score"),
    ("cib", [("date", "left", 45, 140, 16, -3.99), ("time", "left", 45, 140, 1, 1), ("debit", "left", 200, 270, 24, None), ("credit", "left", 270, 350, 24, None), ("balance", "left", 350, 415, 24, None)], (r"^\d{2}:\d{2}:\d{2}", 45, 140, 20), "separate", "reverse_all"),
    ("mybank_corp", [("date", "left", 190, 245, None, None), ("credit", "left", 300, 382, None, None), ("debit", "left", 382, 455, None, None), ("balance", "left", 455, 520, None, None)], (r"^0*[1-9]\d{0,2}$", 35, 50.01, 18), "signed", "reverse_time"),
    ("cmb_corp", [("date", "left", 0, 80, None, None, _ISO), ("time", "left", 0, 80, None, None, _CLOCK), ("debit", "left", 85, 170.01, None, None, f"^{_PLAIN}$"), ("credit", "left", 175, 255.01, None, None, f"^{_PLAIN}$"), ("balance", "left", 260, 350.01, None, None, f"^{_PLAIN}")], (_ISO, 0, 80, 2), "separate", "source"),
    ("generic_words", [("date", "left", 0, 70, None, None), ("debit", "left", 70, 135, None, None), ("credit", "left", 135, 205, None, None), ("balance", "left", 205, 285, None, None), ("text", "left", 285, 368, None, None)], (r"^20\d{2}[-/]\d{1,2}[-/]\d{1,2}$", 0, 70.01, 2), "separate", "source"),
]
# Header words of layouts whose columns stand elsewhere on each page.
HEADS = [("guilin_corp", {"date": "交易日期", "credit": "收入", "debit": "支出", "balance": "余额"}, (_ISO, 0, 1e9, 3), "signed", "reverse_time")]
# Layouts of cells and of cells that hold several lines: columns by header words.
CELLS = [
    ("abc", "C", "sign", "source"), ("abc_corp", "C", "separate", "linked"), ("abc_history", "C", "separate", "trail"), ("boc", "C", "reversal", "reverse_time"), ("boc_corp_v2", "C", "signed", "print_order"), ("bocom", "C", "flag", "source"),
    ("bocom_corp", "C", "separate", "source"), ("hebei_corp_detail", "C", "flag", "reverse_time"), ("ccb", "C", "sign", "source"), ("chengdu_corp", "C", "separate", "reverse_time"), ("chongqing", "C", "sign", "source"), ("citic_corp", "C", "signed", "source"),
    ("customer_account_corp", "C", "signed", "source"), ("everbright", "C", "separate", "reverse_time"), ("foshan_rural", "C", "sheet", "reverse_time"), ("jiujiang", "C", "sheet", "reverse_time"), ("lanzhou", "C", "sheet", "reverse_time"),
    ("ningbo", "C", "sheet", "reverse_time"), ("nanjing_corp", "C", "sheet", "reverse_time"), ("fuxin_corp", "C", "separate", "same_time_proven"), ("gansu", "C", "direction", "same_time_proven"), ("guilin", "C", "signed", "reverse_time"),
    ("hebei_rural", "C", "sign", "greedy"), ("huaxia", "C", "sheet", "reverse_time"), ("hubei_rural", "C", "sign", "source"), ("icbc", "C", "sign", "source"), ("icbc_corp", "C", "flag", "same_time_score"), ("jinan_rural_corp", "C", "sign", "source"),
    ("shouguang_rural_corp", "C", "sign", "source"), ("luzhou", "C", "sign", "reverse_time"), ("ordos", "C", "separate", "trail"), ("pingan", "C", "sign", "source"), ("psbc", "C", "sign", "same_time_proven"), ("qingdao_corp", "C", "separate", "source"),
    ("rural_credit", "C", "direction", "reverse_time"), ("shanghai_corp", "C", "separate", "reverse_time"), ("shanxi_bank_corp", "C", "sign", "reverse_time"), ("shanxi_rural_corp", "C", "separate", "same_time_score"), ("sichuan_rural", "C", "sign", "source"),
    ("spdb", "C", "sign", "source"), ("spdb_corp", "C", "separate", "source"), ("tianjin_corp", "C", "separate", "trail"), ("tianjin_rural_corp", "C", "signed", "source"), ("zhongyuan", "C", "direction", "reverse_time"),
    ("wechat", "C", "wallet", "source"), ("alipay", "C", "wallet", "source"), ("ccb_corp", "M", "separate", "source"), ("mengshang_corp", "M", "separate", "source"), ("chengdu_rural_corp", "M", "signed", "reverse_time"),
    ("excel", "C", "sheet", "source"), ("excel_boc", "C", "filtered", "reverse_time"), ("excel_hkb", "C", "signed", "source"), ("excel_boc_online", "C", "sign", "source"),
]
#: Layouts without balances, layouts whose columns keep negative amounts, and those with a tolerance.
NO_BALANCE = ["wechat", "alipay", "excel_boc_online"]
TOLERANCE = {"generic_pdf": "0.99", "cmbc": "0.99", "excel": "0.99", "generic_words": "0.99"}
_MAPS = {"direction": _SIDES | _BOOKS, "flag": _BOOKS, "wallet": _WALLET, "sheet": _SHEET}


def rows() -> list[tuple]:
    from decimal import Decimal

    number = lambda x: None if x is None else float(x)
    box = lambda name, at, left, right, above, below, rx=None: (name, at, *map(number, (left, right, above, below)), rx)
    none = (None, None, None)
    out = [(b, "L", rx, cols, *none, mode, words, order) for b, rx, cols, mode, words, order in LINES]
    out += [(b, "L", rx, cols, *none, mode, {}, "source") for b in ("cmbc", "generic_pdf") for mode, rx, cols in GENERIC]
    for b, edges, cols, head, mode, order in EDGES:
        below = {"date": DATE_BELOW, "text": None}
        boxes = [box(f, "middle", edges[k], edges[k + 1], None, below.get(f, MONEY_BELOW)) for f, k in cols.items()]
        k = cols["date"]
        out.append((b, "P", None, None, boxes, (_DATE, float(edges[k]), float(edges[k + 1]), head, HEAD_GAP, ROW_ABOVE), None, mode, {}, order))
    out += [(b, "P", None, None, [box(*x) for x in boxes], (rx, float(a), float(e), None, 0.0, float(up)), None, mode, {}, order) for b, boxes, (rx, a, e, up), mode, order in BOXES]
    out += [(b, "P", None, None, None, (rx, float(a), float(e), None, 0.0, float(up)), heads, mode, {}, order) for b, heads, (rx, a, e, up), mode, order in HEADS]
    out += [(b, s, None, None, *none, mode, _MAPS.get(mode, {}), order) for b, s, mode, order in CELLS]
    return [(*r, _TOTALS, r[7] == "signed", r[0] in NO_BALANCE, Decimal(TOLERANCE.get(r[0], "0.00")), *((BLOCKS.get(r[0]), PARTS.get(r[0])) if r[1] == "L" else (None, None))) for r in out]


def layouts(spark: SparkSession) -> DataFrame:
    """The registry as a table; one small row a layout and shape."""
    return spark.createDataFrame(rows(), SCHEMA)


#: What layouts print as totals: layout, figure, pattern over text without blanks.
PRINTED = [
    ("abc_history", "income_cnt", r"总收入笔数(\d+)"), ("abc_history", "expense_cnt", r"总支出笔数(\d+)"), ("abc_history", "income", r"总收入金额([\d,.]+)"), ("abc_history", "expense", r"总支出金额([\d,.]+)"),
    ("ordos", "cnt", r"共(\d+)条"), ("ordos", "income_cnt", r"总收入笔数[:：](\d+)"), ("ordos", "expense_cnt", r"总支出笔数[:：](\d+)"), ("ordos", "income", r"总收入金额[:：]([\d,.]+)"), ("ordos", "expense", r"总支出金额[:：]([\d,.]+)"),
    ("guangxi_rural", "income_cnt", r"收入笔数[:：](\d+)"), ("guangxi_rural", "expense_cnt", r"支出笔数[:：](\d+)"), ("guangxi_rural", "income", r"收入合计[:：]([\d,.]+)"), ("guangxi_rural", "expense", r"支出合计[:：]([\d,.]+)"),
    ("rural_commercial", "income", r"总收入[:：]([\d,.]+)"), ("rural_commercial", "income_cnt", r"总收入笔数[:：](\d+)"), ("rural_commercial", "expense", r"总支出[:：](-?[\d,.]+)"), ("rural_commercial", "expense_cnt", r"总支出笔数[:：](\d+)"),
    ("chengdu_corp", "cnt", r"汇总笔数[:：](\d+)"), ("chengdu_corp", "income", r"收入总计[:：]([\d,.]+)"), ("chengdu_corp", "expense", r"支出总计[:：]([\d,.]+)"),
    ("psbc", "income", r"收入总金额([\d,.]+)"), ("psbc", "expense", r"支出总金额([\d,.]+)"), ("psbc", "income_cnt", r"收入总笔数(\d+)笔"), ("psbc", "expense_cnt", r"支出总笔数(\d+)笔"), ("hebei_rural", "cnt", r"总条数[:：]?(\d+)"),
    ("excel_boc", "cnt", r"交易笔数[:：](\d+)"), ("excel_boc", "income", r"贷方交易合计金额[:：]([\d,.]+)"), ("excel_boc", "expense", r"借方交易合计金额[:：]([\d,.]+)"), ("excel_boc_online", "cnt", r"总笔数[:：](\d+)"),
]


def printed_patterns(spark: SparkSession) -> DataFrame:
    """bank_id, figure, rx; one small row a figure of a layout."""
    return spark.createDataFrame(PRINTED, "bank_id string, figure string, rx string")
