"""Column functions over text: whitespace, hashes, numbers, tokens, vectors.

Whitespace and line breaks are explicit classes, since engines differ in what
their shorthand classes hold.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The whitespace of the Unicode database.
SPACE = "\t-\r\x1c-\x20\x85\xa0  -     　"
#: What ends a line.
BREAK = "\n\r\x0b\x0c\x1c-\x1e\x85  "
CJK = "一-鿿"


def compact(c: Column) -> Column:
    """Without any whitespace."""
    return F.regexp_replace(c, f"[{SPACE}]+", "")


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, f"^[{SPACE}]+|[{SPACE}]+$", "")


def collapsed(c: Column) -> Column:
    """Runs of whitespace as single spaces, none at the ends."""
    return F.regexp_replace(F.regexp_replace(c, f"[{SPACE}]+", " "), "^ | $", "")


def lines(c: Column) -> Column:
    return F.split(c, f"\r\n|[{BREAK}]", -1)


def garbled_ratio(c: Column) -> Column:
    """Share of replacement marks; 0 for an empty text."""
    marks = F.length(c) - F.length(F.replace(c, F.lit("�"), F.lit("")))
    return F.when(F.length(c) > 0, marks / F.length(c)).otherwise(F.lit(0.0))


def normalized_page(c: Column) -> Column:
    """Lines with their whitespace collapsed, blank lines dropped."""
    return F.array_join(F.filter(F.transform(lines(c), collapsed), lambda x: x != ""), "\n")


def without_thousands(c: Column) -> Column:
    """Thousands separators between digits removed."""
    return F.regexp_replace(c, r"(?<=\d),(?=\d{3}(?:\D|$))", "")


def normalized_number(c: Column) -> Column:
    """Separators and one trailing .0 dropped."""
    return F.regexp_replace(F.replace(c, F.lit(","), F.lit("")), r"\.0$", "")


def stable_id(namespace: str, c: Column) -> Column:
    return F.concat(F.lit(namespace.replace("/", "-") + "-"), F.sha2(F.concat(F.lit(namespace + ":"), c), 256))


def basename(c: Column) -> Column:
    return F.element_at(F.split(F.replace(c, F.lit("\\"), F.lit("/")), "/"), -1)


def hash_vector(c: Column, size: int = 8) -> Column:
    """`size` numbers from 0 to 1: the 32-bit words of the text's hash."""
    h = F.sha2(c, 256)
    return F.array(*[F.conv(F.substring(h, 1 + 8 * i, 8), 16, 10).cast("double") / F.lit(4294967295.0) for i in range(size)])


def ascii_tokens(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit("([A-Za-z0-9]+)"), F.lit(1))


def cjk_characters(c: Column) -> Column:
    """The characters one by one; an empty array where there are none."""
    return F.filter(F.split(F.regexp_replace(c, f"[^{CJK}]+", ""), ""), lambda x: x != "")


def lexical_tokens(c: Column, terms: list[str] = ()) -> Column:
    """Tokens for lexical search: lexicon terms present (once each), ASCII runs, CJK characters, adjacent CJK pairs (over what stands between)."""
    present = [F.filter(F.array(*map(F.lit, terms)), lambda t: F.contains(c, t))] if terms else []

    def joined(cjk):
        n = F.greatest(F.size(cjk) - 1, F.lit(0))
        return F.concat(*present, ascii_tokens(c), cjk, F.zip_with(F.slice(cjk, 1, n), F.slice(cjk, 2, n), lambda a, b: F.concat(a, b)))

    return F.get(F.transform(F.array(cjk_characters(c)), joined), 0)  # the characters are made once


#: Chinese digits and units.
DIGITS, UNITS = {c: i for i, c in enumerate("零一二三四五六七八九")} | {"两": 2, "〇": 0}, {"十": 10, "百": 100, "千": 1000, "万": 10000}


def chinese_number(c: Column) -> Column:
    """A Chinese numeral as a whole number; digits stay digits; null if it's neither."""
    digit = F.create_map(*[F.lit(x) for p in DIGITS.items() for x in p])
    unit = F.create_map(*[F.lit(x) for p in UNITS.items() for x in p])
    zero = F.struct(F.lit(0).cast("bigint").alias("total"), F.lit(0).cast("bigint").alias("section"), F.lit(-1).cast("bigint").alias("number"))

    def step(s, x):
        d, u = digit[x], unit[x]
        n = F.greatest(s["number"], F.lit(0))
        # a unit without a digit before it counts one of it
        one = F.when((s["number"] < 0) & (s["section"] == 0), F.lit(1)).otherwise(n)
        is_wan = u == 10000
        return F.struct(
            F.when(is_wan, (s["total"] + s["section"] + n) * 10000).otherwise(s["total"]).alias("total"),
            F.when(is_wan, F.lit(0)).when(u.isNotNull(), s["section"] + F.when(s["number"] < 0, F.lit(1)).otherwise(one) * u).otherwise(s["section"]).cast("bigint").alias("section"),
            F.when(u.isNotNull(), F.lit(-1)).otherwise(d).cast("bigint").alias("number"),
        )

    value = F.aggregate(F.filter(F.split(c, ""), lambda x: x != ""), zero, step, lambda s: s["total"] + s["section"] + F.greatest(s["number"], F.lit(0)))
    return F.when(c.rlike("^[0-9]+$"), F.try_to_number(c, F.lit("9" * 18)).cast("bigint")).when(c.rlike("^[零〇一二两三四五六七八九十百千万]+$"), value)


def small_number(c: Column) -> Column:
    """A number of up to 99 with tens, or of single digits one after the other; other numerals are null."""
    digit = F.create_map(*[F.lit(x) for p in DIGITS.items() for x in p])
    left, right = F.substring_index(c, "十", 1), F.substring_index(c, "十", -1)
    tens = F.when(left == "", 1).otherwise(F.coalesce(F.try_element_at(digit, left), F.lit(1)))
    ones = F.when(right == "", 0).otherwise(F.coalesce(F.try_element_at(digit, right), F.lit(0)))
    each = F.array_join(F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x: F.try_element_at(digit, x).cast("string")), "")
    every = f"^[{''.join(DIGITS)}]+$"
    return (
        F.when(c.rlike("^[0-9]+$"), F.try_to_number(c, F.lit("9" * 18)).cast("bigint"))
        .when(c.rlike(f"^[{''.join(DIGITS)}]*十[{''.join(DIGITS)}]*$"), (tens * 10 + ones).cast("bigint"))
        .when(c.rlike(every), F.try_to_number(each, F.lit("9" * 18)).cast("bigint"))
    )


def replaced(c: Column, aliases: dict[str, str]) -> Column:
    """`c` with each alias replaced by what it stands for, in the order given."""
    for old, new in aliases.items():
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def before_any(c: Column, marks) -> Column:
    """What stands before the first of the marks; the whole text where none stands."""
    at = F.array_min(F.filter(F.array(*[F.instr(c, F.lit(m)) for m in marks]), lambda i: i > 0))
    return F.when(at.isNull(), c).otherwise(F.substring(c, F.lit(1), at - 1))


def ratio(a: Column, b: Column) -> Column:
    """a / b; 0 / 0 is 0 and anything else over 0 infinite."""
    return F.when(b != 0, a / b).when(a == 0, F.lit(0.0)).when(a.isNotNull() & b.isNotNull(), F.lit(float("inf")))


def occurrences(c: Column, words) -> Column:
    """How often the words stand in `c`, in sum, each counted without overlaps."""
    return sum(((F.length(c) - F.length(F.replace(c, F.lit(w), F.lit("")))) / F.lit(len(w)) for w in words), F.lit(0.0)).cast("int")
