"""Query expansion and re-ranking by rules held as data: twelve terms, each with a reason.

The domain's words are parameters: rule tables of triggers, added terms, title
words and weights. The tables given here are small fixed examples for the
insurance texts of the tests.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values: (intent, words that trigger it, terms it adds to the query).
RULES = (
    ("waiting", ("观察期", "等待", "waiting period", "Wartezeit", "délai de carence"), ("观察期", "waiting period")),
    ("exclusion", ("不赔", "除外", "exclusion", "not pay", "ausgeschlossen", "exclu"), ("除外", "不承担给付责任", "do not pay")),
    ("payment", ("赔", "给付", "pay", "claim", "Leistung", "prestation"), ("给付", "保险金", "benefit")),
    ("documents", ("需要", "材料", "documents", "form", "Attest", "certificat"), ("申请", "提供", "claim form")),
    ("premium", ("保费", "保险费", "premium", "Prämie", "prime"), ("保险费", "premium")),
)
#: Words of titles that fit a question's intent, and of those that don't.
TITLE_WORDS = {
    "waiting": ("观察期限", "Waiting period"), "exclusion": ("除外事项", "免赔规则", "Deductibles"), "payment": ("保障范围", "给付流程", "身故给付", "Benefits"),
    "documents": ("给付流程", "病史告知", "Disclosure"), "premium": ("缴费方式", "缴费宽限", "保费豁免", "Grace period"), "definition": ("名词解释", "病种释义", "Definitions"),
}
WRONG_TITLES = {"exclusion": ("保障范围", "Benefits"), "payment": ("除外事项", "免赔规则"), "waiting": ("缴费宽限", "Grace period"), "premium": ("观察期限", "Waiting period")}
#: Words that trigger intents of re-ranking only.
MORE_INTENTS = (("definition", ("什么是", "定义", "解释", "meaning", "definition", "Definition", "définition")),)
#: Words of texts that exclude and that grant, and the persons a text may be about.
EXCLUDING = ("不承担", "除外", "do not pay", "not covered", "no benefit", "aucune prestation", "keine Leistung")
GRANTING = ("给付", "承担", "we pay", "benefit", "prestation", "Leistung")
PERSONS = ("投保人", "被保险人", "受益人", "policyholder", "insured person", "beneficiary", "Versicherungsnehmer", "bénéficiaire")
#: Weights of the terms of the re-ranking score.
WEIGHTS = {
    "title_intent": 2.0, "wrong_title": -1.5, "definition_title": -1.5, "excluding": 1.5, "granting": 1.0, "exact_term": 0.5,
    "same_person": 1.0, "other_person": -2.0, "number": 0.25, "clause_heading": 0.25, "low_confidence": -0.5, "directory": -1.0,
}
#: Letters of an expansion at most to count as a term that stands in the text; letters in which a clause's heading is looked for.
TERM, HEAD = 12, 40
#: Weight of a re-ranking score in the combined one, its bound, and the penalty of pages that look like a table of contents.
RERANK_WEIGHT, RERANK_BOUND, DIRECTORY_PENALTY = 0.017, 1.5, 0.05


def has_any(c: Column, terms) -> Column:
    return F.exists(F.array(*map(F.lit, terms)), lambda t: F.contains(c, t))


def intents(question: Column, rules=RULES) -> Column:
    """The intents whose triggers the question holds, in the order of the rules."""
    return F.array_compact(F.array(*[F.when(has_any(question, triggers), F.lit(name)) for name, triggers, _ in rules]))


def expansions(question: Column, rules=RULES) -> Column:
    """The question, then the terms of its intents; the first of equal ones stays. Blank questions give none."""
    added = F.flatten(F.array(*[F.when(has_any(question, triggers), F.array(*map(F.lit, terms))).otherwise(F.expr("cast(array() as array<string>)")) for _, triggers, terms in rules]))
    q = F.trim(question)
    return F.when(q != "", F.array_distinct(F.concat(F.array(q), added))).otherwise(F.expr("cast(array() as array<string>)"))


def directory_like(text: Column) -> Column:
    """At least three lines of which half (three at least) look like entries of a table of contents."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    entry = F.size(F.filter(lines, lambda x: x.rlike(r"(\.{3,}|…)\s*[0-9]+\s*$") | x.rlike(r"^\s*(第[一二三四五六七八九十百0-9]+[条章节]|[0-9]+(\.[0-9]+)+)[^。.;；]{0,30}$")))
    n = F.size(lines)
    return (n >= 3) & (entry >= F.greatest(F.lit(3), F.floor(n / 2)))


HEADING = "^第 *[零〇一二三四五六七八九十百千万两0-9]+ *条"


def rerank_terms(question: Column, title: Column, text: Column, confidence: Column, rules=RULES) -> list[tuple[str, Column]]:
    """(reason, condition) of each term of the score, in order; a reason may have several."""
    title, text = F.coalesce(title, F.lit("")), F.coalesce(text, F.lit(""))
    both = F.concat(title, F.lit("\n"), text)
    asked = {name: has_any(question, words) for name, words in (*((n, t) for n, t, _ in rules), *MORE_INTENTS)}
    never = F.lit(False)
    out = []
    for name, has in asked.items():
        out.append(("title_intent", has & has_any(title, TITLE_WORDS[name]) if name in TITLE_WORDS else never))
        out.append(("wrong_title", has & has_any(title, WRONG_TITLES[name]) if name in WRONG_TITLES else never))
    other = never
    for name, has in asked.items():
        other = other | has if name != "definition" else other
    out.append(("definition_title", asked["definition"] & other & has_any(title, TITLE_WORDS["definition"])))
    out.append(("excluding", asked["exclusion"] & has_any(both, EXCLUDING)))
    out.append(("granting", asked["payment"] & has_any(both, GRANTING)))
    words = {n: tuple(w for w in dict.fromkeys((*TITLE_WORDS.get(n, ()), *next((e for m, _, e in rules if m == n), ()))) if len(w) <= TERM) for n in asked}
    exact = never
    for name, has in asked.items():
        exact = exact | has & has_any(both, words[name]) if words[name] else exact
    out.append(("exact_term", exact))
    meant = {p: F.contains(question, F.lit(p)) for p in PERSONS}
    some = same = foreign = never
    for p, has in meant.items():
        some, same, foreign = some | has, same | has & F.contains(both, F.lit(p)), foreign | ~has & F.contains(both, F.lit(p))
    out += [("same_person", same), ("other_person", some & foreign)]
    numbers = F.regexp_extract_all(question, F.lit("([0-9]+)"), F.lit(1))
    out.append(("number", F.exists(numbers, lambda n: F.contains(both, n))))
    out.append(("clause_heading", title.rlike(HEADING) | F.substring(text, 1, HEAD).rlike(HEADING)))
    out += [("low_confidence", confidence == "low"), ("directory", directory_like(text))]
    return [(reason, F.coalesce(c, never)) for reason, c in out]


def rerank_score(terms: list[tuple[str, Column]]) -> Column:
    """The sum of the weights of the terms that hold."""
    return sum((F.when(c, F.lit(WEIGHTS[reason])).otherwise(F.lit(0.0)) for reason, c in terms), F.lit(0.0))


def rerank_reasons(terms: list[tuple[str, Column]]) -> Column:
    """The reasons that hold, each once, in order."""
    return F.array_distinct(F.array_compact(F.array(*[F.when(c, F.lit(reason)) for reason, c in terms])))


def combined(final: Column, rerank: Column, directory: Column) -> Column:
    bounded = F.greatest(F.lit(-RERANK_BOUND), F.least(F.lit(RERANK_BOUND), rerank))
    return final + RERANK_WEIGHT * bounded - F.when(directory, DIRECTORY_PENALTY).otherwise(0.0)


def rerank(hits: DataFrame, k: int) -> DataFrame:
    """The k best of hits (query_id, doc_id, final_score, rank, question, text, title, confidence) a query by combined score, then final score, then former rank; with the reasons."""
    from pyspark.sql import Window

    score = F.round(combined(F.col("final_score"), F.col("rerank_score"), F.col("directory")), 9)
    terms = rerank_terms(F.col("question"), F.col("title"), F.col("text"), F.col("confidence"))
    x = hits.withColumn("rerank_score", rerank_score(terms)).withColumn("reasons", rerank_reasons(terms)).withColumn("directory", F.array_contains("reasons", "directory")).withColumn("combined_score", score)
    order = Window.partitionBy("query_id").orderBy(F.desc("combined_score"), F.desc("final_score"), "rank")
    return x.withColumn("new_rank", F.row_number().over(order)).where(F.col("new_rank") <= k)
