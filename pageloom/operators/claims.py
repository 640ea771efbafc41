"""Claims of a term and a number, and whether cited text supports them."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: Terms as an example lexicon; a parameter of every function that needs one.
TERMS = ("观察期", "宽限期", "给付比例", "复核期", "借款期限", "免赔额", "waiting period", "daily benefit", "co-payment", "annual limit", "Wartezeit", "Tagegeld")
#: Characters within which a number belongs to the term before it; what ends a fragment.
REACH, FRAGMENT = 18, "[。！？!?；;\n]+"
#: A number with a unit.
NUMBER = "[0-9]+(?:\\.[0-9]+)?\\s?(?:元|日|天|%|岁|年|个月|周|days|months|years)"


def term_numbers(text: Column, terms=TERMS) -> Column:
    """Distinct 'term=number' claims of a text: the first number within REACH characters after a term, in the same fragment."""
    fragments = F.split(T.without_thousands(text), FRAGMENT)

    def of(fragment):
        each = []
        for t in terms:
            after = F.substring(fragment, F.instr(fragment, F.lit(t)) + len(t), F.lit(REACH))
            number = T.normalized_number(F.regexp_replace(F.regexp_extract(after, f"({NUMBER})", 1), "\\s", ""))
            each.append(F.when(F.contains(fragment, F.lit(t)) & (number != ""), F.concat(F.lit(t + "="), F.replace(number, F.lit("日"), F.lit("天")))))
        return F.array_compact(F.array(*each))

    return F.array_distinct(F.flatten(F.transform(fragments, of)))


#: What joins two terms, and what says that both have the number that follows.
JOINING, BOTH = ("与", "和", "及", "或", " and ", " or ", " und ", " et "), ("均为", "都是", "皆为", " both ", " each ")


def term_facts(text: Column, terms=TERMS, aliases: dict[str, str] | None = None) -> Column:
    """Distinct 'term=number' facts of a text: every term with the first number after it and before the next term or joining word, in its fragment; terms that are joined share the number if a word says so.

    `aliases` maps a term to the one it's written as.
    """
    terms = sorted(terms, key=lambda t: (-len(t), t))
    known = "|".join(re.escape(t) for t in terms)
    piece = f"({known}|{NUMBER}|{'|'.join(JOINING + BOTH)})"
    none = F.expr("cast(array() as array<string>)")
    zero = F.struct(none.alias("open"), F.lit(False).alias("joined"), F.lit(False).alias("both"), none.alias("out"))

    def step(s, x):
        term, number = x.isin(*terms), x.rlike("^[0-9]")
        opened = F.when(s["joined"], F.array_append(s["open"], x)).otherwise(F.array(x))
        meant = F.when(s["both"], s["open"]).otherwise(F.slice(s["open"], -1, 1))
        value = T.normalized_number(F.regexp_replace(F.regexp_replace(x, "\\s", ""), "日$", "天"))
        facts = F.when(s["joined"] | (F.size(s["open"]) == 0), none).otherwise(F.transform(meant, lambda t: F.concat(t, F.lit("="), value)))
        return (
            F.when(term, F.struct(opened.alias("open"), F.lit(False).alias("joined"), F.lit(False).alias("both"), s["out"].alias("out")))
            .when(number, F.struct(none.alias("open"), F.lit(False).alias("joined"), F.lit(False).alias("both"), F.concat(s["out"], facts).alias("out")))
            .when(x.isin(*BOTH), F.struct(s["open"].alias("open"), s["joined"].alias("joined"), F.lit(True).alias("both"), s["out"].alias("out")))
            .otherwise(F.struct(s["open"].alias("open"), (F.size(s["open"]) > 0).alias("joined"), s["both"].alias("both"), s["out"].alias("out")))
        )

    found = F.transform(F.split(T.without_thousands(text), FRAGMENT), lambda f: F.aggregate(F.regexp_extract_all(f, F.lit(piece), F.lit(1)), zero, step, lambda s: s["out"]))
    facts = F.flatten(found)

    def named(x):
        out = x
        for old, new in (aliases or {}).items():
            out = F.when(x.startswith(old + "="), F.concat(F.lit(new), F.substring(x, F.lit(len(old) + 1), F.length(x)))).otherwise(out)
        return out

    return F.array_distinct(F.transform(facts, named))


def mentions(text: Column, terms=TERMS) -> Column:
    return F.exists(F.array(*map(F.lit, terms)), lambda t: F.contains(text, t))


def verified(claims: DataFrame, cited: DataFrame) -> DataFrame:
    """(answer_id, n_claims, n_supported, status) of answers (answer_id, text) and the texts they cite (answer_id, cited).

    supported: every claim stands in a cited text; unsupported: one doesn't;
    uncertain: no claim, but a term is mentioned; none: nothing to verify.
    """
    c = claims.select("answer_id", F.coalesce("text", F.lit("")).alias("text"))
    facts = c.select("answer_id", F.explode(term_numbers(F.col("text"))).alias("claim"))
    known = cited.select("answer_id", F.explode(term_numbers(F.coalesce("cited", F.lit("")))).alias("claim")).distinct().withColumn("found", F.lit(True))
    n = facts.join(known, ["answer_id", "claim"], "left").groupBy("answer_id").agg(F.count("*").alias("n_claims"), F.count_if(F.coalesce("found", F.lit(False))).alias("n_supported"))
    j = c.join(n, "answer_id", "left").fillna(0, ["n_claims", "n_supported"])
    status = F.when((F.col("n_claims") > 0) & (F.col("n_claims") == F.col("n_supported")), "supported").when(F.col("n_claims") > 0, "unsupported").when(mentions(F.col("text")), "uncertain").otherwise("none")
    return j.select("answer_id", "n_claims", "n_supported", status.alias("status"))


def first_match(rules: list[tuple[str, Column]], otherwise: str) -> Column:
    """The name of the first rule that holds: an ordered decision list as one expression."""
    out = F.lit(otherwise)
    for name, condition in reversed(rules):
        out = F.when(F.coalesce(condition, F.lit(False)), F.lit(name)).otherwise(out)
    return out


