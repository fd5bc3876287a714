"""Typed values as column functions: numbers, quantities, money, percents, dates, yes/no, short text.

Numbers travel as canonical decimal text (no leading or trailing zeros), so keys never depend on float rendering.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed
from .memo import built_once
from .text import let, squeeze, strip

VALUE = "struct<key:string,display:string,family:string>"


def _matches(text: Column, pattern: str, names: tuple[str, ...]) -> Column:
    """array<struct> of the named groups of every match: one pass over the text, then the groups of each short match."""
    return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.struct(
        *[F.regexp_extract(m, pattern, i).alias(n) for i, n in enumerate(names, 1)]))


def _lookup(table: dict, key: Column) -> Column:
    """Value of a small fixed table as text, or NULL. One literal keeps the plan short; it is folded to a map once."""
    pairs = F.str_to_map(F.lit(";".join(f"{k}={v}" for k, v in table.items())), F.lit(";"), F.lit("="))
    return F.try_element_at(pairs, key)


def number_text(digits: Column) -> Column:
    """Canonical decimal text of plain digits (commas allowed)."""
    plain = F.regexp_replace(F.regexp_replace(digits, ",", ""), r"^\+|^(-?)0+(?=\d)", "$1")
    return F.when(F.contains(plain, F.lit(".")), F.regexp_replace(plain, r"\.?0*$", "")).otherwise(plain)


def _scaled(acc, w) -> Column:
    return F.try_multiply(F.greatest(acc["cur"], F.lit(1).cast("bigint")), w["scale"])


def words_number(text: Column) -> Column:
    """'forty-five', 'two hundred' ... as decimal text; NULL when any word is not a number word."""
    words = F.split(F.lower(strip(text)), rf"(?:{fixed.WS}|-)+")
    zero = F.lit(0).cast("bigint")

    def add(acc, word):
        return let(F.struct(_lookup(fixed.UNIT_WORDS, word).cast("bigint").alias("unit"), _lookup(fixed.SCALE_WORDS, word).cast("bigint").alias("scale")), lambda w: F.struct(
            F.when(w["scale"] >= 1000, F.try_add(acc["total"], _scaled(acc, w))).otherwise(acc["total"]).alias("total"),
            F.when(w["unit"].isNotNull(), acc["cur"] + w["unit"]).when(w["scale"] >= 1000, zero).when(w["scale"].isNotNull(), _scaled(acc, w))
             .otherwise(acc["cur"]).alias("cur"),
            (acc["seen"] | w["unit"].isNotNull() | w["scale"].isNotNull()).alias("seen"),
            (acc["bad"] | ((word != "") & w["unit"].isNull() & w["scale"].isNull())).alias("bad")))

    start = F.struct(zero.alias("total"), zero.alias("cur"), F.lit(False).alias("seen"), F.lit(False).alias("bad"))
    return F.aggregate(words, start, add, lambda a: F.when(
        a["seen"] & ~a["bad"], F.try_add(a["total"], a["cur"]).cast("string")))


def number(text: Column) -> Column:
    """Digits, number words, or words with the digits in parentheses -> decimal text or NULL."""
    def parse(t):
        inner = F.regexp_extract(t, rf"\(\s*({fixed.DIGITS})\s*\)", 1)
        raw = strip(F.regexp_replace(F.when(inner != "", inner).otherwise(t), ",", ""))
        return F.when(raw.rlike(r"^[+-]?(?:\d+\.?\d*|\.\d+)$"), number_text(raw)).otherwise(
            words_number(F.regexp_replace(t, r"\(.*?\)", "")))
    return let(text, parse)


def singular(word: Column) -> Column:
    w = F.lower(word)
    return F.when((F.length(w) > 3) & w.rlike("[^s]s$"), F.substring(w, F.lit(1), F.length(w) - 1)).otherwise(w)



def quantities(text: Column) -> Column:
    """array<struct<num,unit>>: 'net N' first, then every number with its noun; weeks become days."""
    net = F.transform(F.regexp_extract_all(text, F.lit(fixed.NET_DAYS), F.lit(1)),
                      lambda n: F.struct(number_text(n).alias("num"), F.lit("day").alias("unit")))

    def unit_of(m):
        qualified = F.when(F.lower(m["w2"]).isin("day", "days"), _lookup(fixed.DAY_QUALIFIERS, F.lower(m["w1"])))
        return F.coalesce(qualified, singular(m["w1"]))

    def one(m):
        return let(F.struct(number(m["num"]).alias("num"), unit_of(m).alias("unit")), lambda q: F.when(
            q["unit"] == "week", F.struct(_weeks(q["num"]).alias("num"), F.lit("day").alias("unit"))).otherwise(q))

    found = F.transform(_matches(text, fixed.QUANTITY, ("num", "w1", "w2")), one)
    return F.filter(F.concat(net, found), lambda q: q["num"].isNotNull())


def _weeks(num: Column) -> Column:
    """Seven times a decimal text, digit by digit from the right, so of any length."""
    places = F.length(F.regexp_extract(num, r"\.(\d*)$", 1))
    digits = F.filter(F.split(F.reverse(num), ""), lambda c: c.rlike("[0-9]"))
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("carry"))
    product = F.aggregate(digits, start, lambda acc, c: let(c.cast("int") * 7 + acc["carry"], lambda n: F.struct(
        F.concat((n % 10).cast("string"), acc["out"]).alias("out"), F.floor(n / 10).cast("int").alias("carry"))), lambda acc: F.concat(acc["carry"].cast("string"), acc["out"]))
    sign = F.regexp_extract(num, "^-?", 0)
    return let(product, lambda p: number_text(F.concat(sign, F.left(p, F.length(p) - places), F.when(places > 0, F.concat(F.lit("."), F.right(p, places))).otherwise(""))))


def _shifted(digits: Column, zeros: Column, places: Column) -> Column:
    """A decimal text with its point moved to the right, with at least `places` decimals; exact for any length."""
    fraction = F.regexp_extract(digits, r"\.(\d+)$", 1)
    whole = F.concat(F.substring_index(digits, ".", 1), F.rpad(F.substr(fraction, F.lit(1), zeros), zeros, F.lit("0")))
    return F.concat(whole, F.lit("."), F.rpad(F.substr(fraction, zeros + 1), F.greatest(places, F.length(fraction) - zeros, F.lit(1)), F.lit("0")))


def money(text: Column) -> Column:
    """array<struct<currency,amount,shown>>: currency-first matches, then currency-last matches."""
    def matches(pattern, order):
        return F.transform(_matches(text, pattern, order), lambda m: F.struct(
            _lookup(fixed.CURRENCIES, F.lower(m["cur"])).alias("currency"),
            F.regexp_replace(m["amt"], ",", "").alias("digits"),
            _lookup(fixed.MULTIPLIERS, F.lower(m["suf"])).alias("factor")))

    def finish(m):
        decimals = F.length(F.regexp_extract(m["digits"], r"\.(\d+)$", 1))
        # all multipliers are powers of ten
        scaled = _shifted(m["digits"], F.length(m["factor"].cast("string")) - 1, decimals)
        # the shown amount keeps as many decimals as were written
        full = F.when(m["factor"].isNull(), m["digits"]).otherwise(
            F.concat(F.substring_index(scaled, ".", 1),
                     F.when(decimals > 0, F.concat(F.lit("."), F.substring(F.substring_index(scaled, ".", -1), F.lit(1), decimals)))
                      .otherwise("")))
        whole = F.regexp_replace(F.substring_index(full, ".", 1), r"^0+(?=\d)", "")
        fraction = F.regexp_extract(full, r"(\.\d+)$", 1)
        return F.struct(
            m["currency"], number_text(F.when(m["factor"].isNull(), m["digits"]).otherwise(scaled)).alias("amount"),
            F.concat(F.regexp_replace(whole, r"(?<=\d)(?=(?:\d{3})+$)", ","), fraction).alias("shown"))

    both = F.concat(matches(fixed.MONEY_PREFIX, ("cur", "amt", "suf")), matches(fixed.MONEY_SUFFIX, ("amt", "suf", "cur")))
    return F.transform(F.filter(both, lambda m: m["currency"].isNotNull()), finish)


def percents(text: Column) -> Column:
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(fixed.PERCENT), F.lit(1)), number), lambda n: n.isNotNull())


def dates(text: Column) -> Column:
    """array<string> of YYYY-MM-DD: ISO first, then day-month-year, then month-day-year wordings."""
    def wordings(pattern, order):
        return F.transform(_matches(text, pattern, order), lambda m: F.concat_ws(
            "-", m["y"], F.lpad(_lookup(fixed.MONTH_NUMBERS, F.lower(m["m"])), 2, "0"), F.lpad(m["d"], 2, "0")))
    return F.concat(F.regexp_extract_all(text, F.lit(fixed.DATE_ISO), F.lit(1)),
                    wordings(fixed.DATE_DMY, ("d", "m", "y")), wordings(fixed.DATE_MDY, ("m", "d", "y")))


def polarity(text: Column, bare: bool) -> Column:
    """'yes', 'no' or NULL. Bare yes/no/true/false count only when `bare`."""
    def cue(words):
        return rf"(?<!{fixed.WORD_CHAR})(?:{'|'.join(words)})(?!{fixed.WORD_CHAR})"

    def decide(t):
        result = F.when(t.rlike(cue(fixed.NEGATIVE_CUES)), "no").when(t.rlike(cue(fixed.POSITIVE_CUES)), "yes")
        return F.when(t.isin("no", "false"), "no").when(t.isin("yes", "true"), "yes").otherwise(result) if bare else result
    return let(squeeze(F.lower(text)), decide)


def text_key(value: Column) -> Column:
    """Lower-cased words without punctuation and one leading article; '' when nothing is left."""
    words = squeeze(F.regexp_replace(F.lower(value), r"[^\p{L}\p{N}_\s]", " "))
    return F.regexp_replace(words, r"^(the|a|an)\s+", "")


def _value(key, display, family) -> Column:
    return F.struct(F.concat(F.lit(f"{family}:"), key).alias("key"), display.alias("display"), F.lit(family).alias("family"))


def _first(values: Column, shape) -> Column:
    return let(values, lambda v: F.when(F.size(v) > 0, shape(F.try_element_at(v, F.lit(1)))))


def quantity_value(text: Column) -> Column:
    return _first(quantities(text), lambda q: _value(
        F.concat(q["num"], F.lit("|"), q["unit"]),
        strip(F.concat(q["num"], F.lit(" "), q["unit"], F.when((q["unit"] != "") & (q["num"] != "1"), "s").otherwise(""))),
        "quantity"))


def money_value(text: Column) -> Column:
    return _first(money(text), lambda m: _value(
        F.concat(m["currency"], F.lit("|"), m["amount"]), F.concat(m["currency"], F.lit(" "), m["shown"]), "money"))


def percent_value(text: Column) -> Column:
    def shape(n):
        return _value(n, F.concat(n, F.lit("%")), "percent")
    return F.coalesce(_first(percents(text), shape), let(number(text), lambda n: F.when(n.isNotNull(), shape(n))))


def date_value(text: Column) -> Column:
    def shape(d):
        month = F.try_element_at(F.array(*[F.lit(m[:3]) for m in fixed.MONTHS]), F.substring(d, 6, 2).try_cast("int"))
        return _value(d, F.concat_ws(" ", F.regexp_replace(F.substring(d, 9, 2), "^0", ""),
                                     F.coalesce(month, F.substring(d, 6, 2)), F.substring(d, 1, 4)), "date")
    return _first(F.filter(dates(text), lambda d: F.substring(d, 6, 2) != "00"), shape)


def boolean_value(text: Column) -> Column:
    return let(polarity(text, bare=True), lambda p: F.when(p.isNotNull(), _value(p, F.initcap(p), "boolean")))


def text_value(text: Column) -> Column:
    return let(text_key(text), lambda k: F.when(k != "", _value(k, strip(text), "text")))


def normalize(value: Column, value_type: Column) -> Column:
    """struct<key,display,family>; NULL for an empty value or type 'none'; unparsable typed values become text."""
    def dispatch(v):
        typed = (F.when(value_type.isin("duration", "number"), quantity_value(v)).when(value_type == "money", money_value(v))
                 .when(value_type == "percent", percent_value(v)).when(value_type == "date", date_value(v))
                 .when(value_type == "boolean", boolean_value(v)))
        return F.when((v != "") & (F.coalesce(value_type, F.lit("text")) != "none"), F.coalesce(typed, text_value(v)))
    return let(strip(F.coalesce(value, F.lit(""))), dispatch)


def quote_supports(norm: Column, quote: Column) -> Column:
    """True when the normalised value can be read again from the quote; text values always pass."""
    def check(n):
        payload = F.regexp_replace(n["key"], "^[a-z]+:", "")
        num, unit = F.substring_index(payload, "|", 1), F.substring_index(payload, "|", -1)
        return (F.when(n["family"] == "quantity", F.exists(quantities(quote), lambda q: (q["num"] == num) & (
                    (unit == "") | (q["unit"] == "") | (q["unit"] == unit))))
                .when(n["family"] == "money", F.exists(money(quote), lambda m: F.concat_ws("|", m["currency"], m["amount"]) == payload))
                .when(n["family"] == "percent", F.array_contains(percents(quote), payload))
                .when(n["family"] == "date", F.array_contains(dates(quote), payload))
                .when(n["family"] == "boolean", F.coalesce(polarity(quote, bare=False) == payload, F.lit(False)))
                .otherwise(F.lit(True)))
    return let(norm, check)


@built_once
def normalized(value: str, value_type: str) -> Column:
    return normalize(F.col(value), F.col(value_type))


@built_once
def supported(norm: str, quote: str) -> Column:
    return quote_supports(F.col(norm), F.col(quote))


def scope(raw: Column) -> Column:
    return let(squeeze(F.lower(F.coalesce(raw, F.lit("")))), lambda s: F.when(~s.isin(*fixed.NO_SCOPE), s))


def family_of(key: Column) -> Column:
    return F.substring_index(key, ":", 1)


def unit_of(key: Column) -> Column:
    return F.when(F.contains(key, F.lit("|")), F.substring_index(key, "|", -1)).otherwise(F.lit(""))
