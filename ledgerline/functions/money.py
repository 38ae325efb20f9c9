"""Money columns: noisy text to DECIMAL(18,2), candidate readings, units (JVM expressions only)."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"
MONEY_RX = r"[+-]?\d[\d,]*\.\d{2}"
MONEY_ARRAY = "array<decimal(18,2)>"


def zero() -> Column:
    return F.lit(0).cast(MONEY)


def half_even(c: Column) -> Column:
    """Two places, half to even: how amounts are read."""
    return F.bround(c, 2).cast(MONEY)


def half_up(c: Column) -> Column:
    """Two places, half away from zero: how figures are shown in documents."""
    return F.round(c, 2).cast(MONEY)


def to_money(text: Column) -> Column:
    """Thousands-separated text; null on anything else."""
    return half_even(F.translate(F.trim(text), ",", "").try_cast("decimal(28,6)"))


def bound(value: Column, use) -> Column:
    """``use`` of a value that is computed once: inside lambdas Spark evaluates an expression as often as it is written."""
    return F.transform(F.array(value), use)[0]


def compact(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), "\n ", "")


def digits_only(text: Column) -> Column:
    return F.regexp_replace(text, r"[^0-9,+.\-]", "")


def money_matches(text: Column) -> Column:
    """All amounts in a text and in what is left of it without other characters, in order, each once."""
    plain = compact(text)
    return F.array_distinct(F.concat(*[F.regexp_extract_all(t, F.lit(MONEY_RX), 0) for t in (plain, digits_only(plain))]))


def is_signed(m: Column) -> Column:
    return F.substring(m, 1, 1).isin("+", "-")


def signed_amount(text: Column) -> Column:
    """The rightmost signed amount, else the rightmost one."""
    last = lambda some: F.try_element_at(some, F.lit(-1))
    return bound(money_matches(text), lambda found: to_money(F.coalesce(last(F.filter(found, is_signed)), last(found))))


def sheet_money(text: Column) -> Column:
    """Spreadsheet cell: currency marks and full-width characters are allowed around the amount."""
    t = F.translate(text, "０１２３４５６７８９．，－＋￥¥元 ", "0123456789.,-+")
    read = F.coalesce(to_money(t), signed_amount(t), half_even(F.nullif(F.regexp_replace(t, r"[^0-9.\-]", ""), F.lit("")).try_cast("decimal(28,6)")))
    return F.when(text.isNotNull(), read)  # else every reading would be tried on nothing


def strict_money(text: Column, optional: bool = False) -> Column:
    """struct(value, error): nothing but one amount is accepted; a blank is an error, or 0 where it is optional."""
    t = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), "[￥¥]", ""))
    good = F.regexp_like(t, F.lit(r"^[+-]?(\d{1,3}(,\d{3})+|\d+)(\.\d{1,2})?$"))
    value = F.when(good, to_money(t)).when((t == "") & F.lit(optional), zero())
    error = F.when(value.isNotNull(), None).when(t == "", F.lit("money_blank")).otherwise(F.lit("money_invalid"))
    return F.struct(value.alias("value"), error.alias("error"))


def clean_number(text: Column) -> Column:
    """Signed decimal, else decimal, else signed integer, else the longest run of digits."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), "[, ]", "")
    first = lambda rx: F.nullif(F.regexp_extract(t, rx, 0), F.lit("")).try_cast("decimal(28,6)")
    runs = F.regexp_extract_all(t, F.lit(r"\d+"), 0)
    longest = F.array_max(F.transform(runs, lambda r, i: F.struct(F.length(r).alias("n"), (-i).alias("i"), r.alias("r"))))["r"]
    return half_even(F.coalesce(first(r"[+-]\d+\.\d+"), first(r"\d+\.\d+"), first(r"[+-]\d+"), longest.try_cast("decimal(28,6)")))


def implied_cents(text: Column) -> Column:
    """Amounts printed without their point: the last two digits are cents."""
    t = F.regexp_replace(text, "[, ]", "")
    return to_money(F.regexp_replace(t, r"^([+-]?)(\d+)(\d{2})$", "$1$2.$3"))


def balance_with_trust(text: Column) -> Column:
    """struct(value, reliable): a clean amount, or one picked from noise."""
    t = F.trim(text)
    clean = F.regexp_like(t, F.lit(r"^[+-]?[\d,]+\.\d{1,2}$"))
    return F.struct(F.when(clean, to_money(t)).otherwise(clean_number(text)).alias("value"), F.coalesce(clean, F.lit(False)).alias("reliable"))


def _suffixes(whole: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(whole), F.lit(1))), lambda k: F.substr(whole, k))


#: Digits before the point of figures whose cents fit a bigint (readings of longer ones are made as text), and places of digits in cents.
LONGEST = 16
PLACES = [10**n for n in range(LONGEST + 1, 1, -1)]


def _dropped(cents: Column, place: Column) -> Column:
    """The figure without its digit at a place."""
    return F.call_function("div", cents, place * 10) * place + cents % place


def _endings(x: Column) -> Column:
    return F.transform(x["places"], lambda p: x["cents"] % (p * 10))


def _one_dropped(x: Column, places: Column) -> Column:
    return F.transform(places, lambda p: _dropped(x["cents"], p))


def _two_dropped(x: Column) -> Column:
    later = lambda k: F.slice(x["places"], k + 2, x["n"])
    return F.flatten(F.transform(x["places"], lambda p, k: bound(_dropped(x["cents"], p), lambda rest: F.transform(later(k), lambda q: _dropped(rest, q)))))


def _only(where: Column, cents: Column) -> Column:
    return F.when(where, cents).otherwise(F.array().cast("array<bigint>"))


def _counted(whole: Column, cents: Column) -> list[Column]:
    """n, cents and places of a figure, for a struct; only n where it is too long."""
    n = F.length(whole)
    return [n.alias("n"), F.when(n <= LONGEST, F.concat(whole, cents).cast("bigint")).alias("cents"), F.when(n <= LONGEST, F.slice(F.lit(PLACES), LONGEST + 1 - n, n)).alias("places")]


def _as_text(wholes: Column, cents: Column) -> Column:
    read = F.transform(F.array_distinct(wholes), lambda w: to_money(F.concat(w, F.lit("."), cents)))
    return F.transform(F.array_compact(read), lambda v: (v * 100).cast("bigint"))


def _in_money(cents: Column) -> Column:
    return F.transform(cents, lambda c: (c.cast("decimal(18,0)") * F.lit(Decimal("0.01"))).cast(MONEY)).cast(MONEY_ARRAY)


def amount_candidates(text: Column) -> Column:
    """Plausible signed amounts of a noisy cell, most plausible first: suffixes of the digits, one digit dropped
    (up to five digits), an over-long last group of thousands repaired, three decimals cut to two."""
    return _in_money(amount_cents(text))


def amount_cents(text: Column) -> Column:
    """``amount_candidates`` in cents."""
    plain = compact(text)
    three = F.flatten(F.transform(F.regexp_extract_all(plain, F.lit(r"[+-][\d,]*\d\.\d{3}"), 0), _three_places))
    matches = F.concat(F.filter(money_matches(text), is_signed), three)

    def parts(m):
        body = F.split(F.substr(m, F.lit(2)), "\\.")
        return F.struct(F.substring(m, 1, 1).alias("sign"), F.element_at(body, 1).alias("grouped"), F.element_at(body, -1).alias("cents"))

    def split(p):
        last = F.element_at(F.split(p["grouped"], ","), -1)
        whole = F.translate(p["grouped"], ",", "")
        long = (F.length(last) > 3) & (F.length(last) < F.length(p["grouped"]))
        return F.struct(F.when(p["sign"] == "-", -1).otherwise(1).alias("sign"), whole.alias("whole"), p["cents"].alias("after"), F.when(long, F.length(last)).alias("last"), *_counted(whole, p["cents"]))

    def counted(x):
        long_group = _only(x["last"].isNotNull(), _one_dropped(x, F.slice(x["places"], x["n"] - x["last"] + 1, x["n"])))
        return F.concat(long_group, _endings(x), _only((x["n"] > 1) & (x["n"] <= 5), _one_dropped(x, x["places"])))

    def long(x):
        head = x["n"] - x["last"]
        long_group = F.when(x["last"].isNotNull(), F.transform(F.sequence(F.lit(1), x["last"]), lambda k: F.concat(F.substr(x["whole"], F.lit(1), head + k - 1), F.substr(x["whole"], head + k + 1)))).otherwise(F.array().cast("array<string>"))
        return _as_text(F.concat(long_group, _suffixes(x["whole"])), x["after"])

    def readings(m):
        return bound(parts(m), lambda p: bound(split(p), lambda x: F.transform(F.when(x["n"] <= LONGEST, counted(x)).otherwise(long(x)), lambda c: c * x["sign"])))

    found = F.array_distinct(F.filter(F.flatten(F.transform(matches, readings)), lambda c: c != 0))
    return bound(found, lambda values: F.when(F.size(values) > 0, values).otherwise(F.array_compact(F.array((signed_amount(text) * 100).cast("bigint")))))


def _three_places(m: Column) -> Column:
    t = F.regexp_replace(m, ",", "")
    return F.array(*[F.regexp_replace(t, r"^(.*\.)(\d)(\d)(\d)$", to) for to in ("$1$2$3", "$1$2$4", "$1$3$4")])


def balance_candidates(text: Column) -> Column:
    """Plausible balances of a noisy cell, most plausible first: suffixes, then one or two digits dropped (up to nine digits)."""
    return _in_money(balance_cents(text))


def balance_cents(text: Column) -> Column:
    """``balance_candidates`` in cents."""
    plain = compact(text)
    three = [F.flatten(F.transform(F.regexp_extract_all(t, F.lit(r"[+-]?\d[\d,]*\.\d{3}"), 0), lambda m: _three_places(F.regexp_replace(m, "^[+-]", "")))) for t in (plain, digits_only(plain))]
    matches = F.concat(money_matches(text), *three)

    def split(p):
        whole, cents = F.element_at(p, 1), F.element_at(p, -1)
        return F.struct(whole.alias("whole"), cents.alias("after"), *_counted(whole, cents))

    def told(x):
        short = x["n"] <= 9
        counted = F.concat(_endings(x), _only(short & (x["n"] > 1), _one_dropped(x, x["places"])), _only(short & (x["n"] > 2), _two_dropped(x)))
        return F.when(x["n"] <= LONGEST, counted).otherwise(_as_text(_suffixes(x["whole"]), x["after"]))

    def readings(m):
        return bound(F.split(F.regexp_replace(F.translate(m, ",", ""), "^[+-]", ""), "\\."), lambda p: bound(split(p), told))

    return F.array_distinct(F.flatten(F.transform(matches, readings)))


def directed_candidates(text: Column, direction: Column) -> Column:
    """Amounts of a cell signed by a direction text (or a minus of its own): whole numbers with decimals first, then endings of all digits before the last point."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), ",", "")
    found = F.regexp_extract_all(F.regexp_replace(t, r"[^0-9.]", " "), F.lit(r"\d+\.\d{1,2}"), 0)
    plain = F.regexp_replace(t, r"[^0-9.]", "")
    whole = F.regexp_replace(F.regexp_extract(plain, r"^(.*)\.[^.]*$", 1), r"\.", "")
    cents = F.substring(F.regexp_extract(plain, r"^.*\.([^.]*)$", 1), 1, 2)
    digits = F.struct(whole.alias("whole"), cents.alias("cents"))
    endings = bound(digits, lambda d: F.when((d["whole"] != "") & (d["cents"] != ""), F.transform(_suffixes(d["whole"]), lambda w: F.concat(w, F.lit("."), d["cents"]))).otherwise(F.array().cast("array<string>")))
    sign = F.when(F.contains(F.coalesce(direction, F.lit("")), F.lit("支")) | F.contains(t, F.lit("-")), -1).otherwise(1)
    told = F.struct(F.array_distinct(F.array_compact(F.transform(F.array_distinct(F.concat(found, endings)), to_money))).alias("values"), sign.alias("sign"))

    def signed(x):
        values = F.when(F.size(x["values"]) > 0, x["values"]).otherwise(F.array_compact(F.array(clean_number(text))))
        return F.transform(values, lambda v: (F.abs(v) * x["sign"]).cast(MONEY)).cast(MONEY_ARRAY)

    return bound(told, signed)


def parted_candidates(text: Column, signed: bool = False, most: int = 24) -> Column:
    """Candidates of a cell of several parts (between bars), 0 first where the cell shows 0.00 or nothing can be read; the first ``most``."""
    part_values = lambda p: F.transform(balance_candidates(F.regexp_replace(p, "-", "")), lambda v: F.when(v == 0, zero()).otherwise((v * F.when(F.lit(signed) & F.contains(F.substring(p, 1, 3), F.lit("-")), -1).otherwise(1)).cast(MONEY)))
    shows_zero = F.contains(F.coalesce(text, F.lit("")), F.lit("0.00"))

    def with_zero(values):
        empty = (F.size(values) == 0) | (shows_zero & ~F.array_contains(values, zero()))
        return F.slice(F.when(empty, F.concat(F.array(zero()), values)).otherwise(values), 1, most)

    return bound(F.array_distinct(F.flatten(F.transform(F.split(F.coalesce(text, F.lit("")), "\\|"), part_values))).cast(MONEY_ARRAY), with_zero)


def ocr_candidates(text: Column) -> Column:
    """Balances of a cell whose digits were read as letters; without a point and with over four digits the last two are cents."""
    t = F.translate(F.coalesce(text, F.lit("")), "OoIlSB", "001158")
    digits = F.regexp_replace(t, r"\D", "")
    implied = F.when(~F.contains(t, F.lit(".")) & (F.length(digits) > 4), to_money(F.regexp_replace(digits, r"^(\d+)(\d{2})$", "$1.$2")))
    whole = to_money(F.nullif(F.regexp_extract(t, r"[+-]?\d[\d,]*(\.\d+)?", 0), F.lit("")))
    all_ = F.concat(F.array(whole), balance_candidates(t), F.array(implied))
    return F.array_distinct(F.filter(all_, lambda v: v.isNotNull() & (v >= 0))).cast(MONEY_ARRAY)


def cents_text(value: Column) -> Column:
    return F.regexp_replace(F.abs(value).cast(MONEY).cast("string"), "\\.", "")


def is_suffix(expected: Column, candidate: Column) -> Column:
    """The candidate's digits end the expected value's, and are fewer."""
    return F.endswith(cents_text(expected), cents_text(candidate)) & (cents_text(expected) != cents_text(candidate))


def is_subsequence(needle: Column, haystack: Column) -> Column:
    """All characters of the needle occur in the haystack in order."""
    chars = F.filter(F.split(haystack, ""), lambda c: c != "")
    at = F.aggregate(chars, F.lit(1), lambda k, c: F.when(F.substr(needle, k, F.lit(1)) == c, k + 1).otherwise(k))
    return at > F.length(needle)


def supported_by(amount: Column, raw: Column) -> Column:
    """The raw cell shows the amount's sign and, in order, its digits."""
    t = compact(raw)
    sign = F.when(amount > 0, F.contains(t, F.lit("+"))).when(amount < 0, F.contains(t, F.lit("-"))).otherwise(F.lit(True))
    digits = F.regexp_replace(t, r"\D", "")
    return sign & (digits != "") & is_subsequence(cents_text(amount), digits)


def label_money(text: Column, label: str, within: int = 80) -> Column:
    """First amount within so many characters after a label."""
    return to_money(F.nullif(F.regexp_extract(text, rf"(?s)\Q{label}\E.{{0,{within}}}?([+-]?\d[\d,]*\.\d{{2}})", 1), F.lit("")))


def label_int(text: Column, label: str, within: int = 30) -> Column:
    return F.nullif(F.regexp_extract(text, rf"(?s)\Q{label}\E.{{0,{within}}}?(\d+)", 1), F.lit("")).try_cast("bigint")


def last_label_int(text: Column, label: str) -> Column:
    """The last printed value, e.g. a page number."""
    return F.try_element_at(F.regexp_extract_all(text, F.lit(rf"\Q{label}\E\s*(\d+)"), 1), F.lit(-1)).try_cast("bigint")


def in_ten_thousands(c: Column, up: bool = True) -> Column:
    return (half_up if up else half_even)(c.cast("decimal(28,6)") / 10000)


def shown(c: Column) -> Column:
    return F.when(c.isNull(), "").otherwise(F.format_number(c, 2))


def non_negative(text: Column) -> Column:
    """Percent or amount text; 0 for errors and negative values."""
    return F.greatest(F.coalesce(half_even(F.regexp_replace(text, "[%, ]", "").try_cast("decimal(28,6)")), zero()), zero())
