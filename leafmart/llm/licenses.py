"""Licence detections by ordered signature rules, in DataFrame functions only (operator 3)."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmart.llm.common import unused
from leafmart.llm.license_rules import Rule, rules

#: Words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` of a text whose A-Z are not yet lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
TOP = 3
#: Another spelling, folded, that the rules of a keyword allow.
SPELLINGS = {"beerware": "beer ware"}

DETECTION = "struct<begin: int, back: int, low: int, rule: int, label: string>"


def folded(text: F.Column) -> F.Column:
    """Letters and digits in lower case, one blank for whatever parts them, one spelling of licence."""
    return F.replace(F.lower(F.regexp_replace(text, "[^0-9A-Za-z]+", " ")), F.lit("licence"), F.lit("license"))


def fold_keyword(keyword: str) -> list[str]:
    """What folded texts are searched for."""
    one = re.sub("[^0-9a-z]+", " ", keyword).strip().replace("licence", "license")
    return [one, *([SPELLINGS[keyword]] if keyword in SPELLINGS else [])]


def rule_groups(ordered: list[Rule]) -> tuple[list[str], F.Column]:
    """Keywords in the order of their first rule, and an array with the rules of each."""
    keywords = list(dict.fromkeys(r.keyword for r in ordered))
    groups = [
        F.array(*[F.struct(F.lit(i).alias("rule"), F.lit(r.priority).alias("priority"), F.lit(r.label).alias("label"), F.lit(r.pattern).alias("pattern")) for i, r in enumerate(ordered) if r.keyword == k])
        for k in keywords
    ]
    return keywords, F.array(*groups)


def places(text: F.Column, rule: F.Column) -> F.Column:
    """Detections of a rule with their offsets: what lies between the matches and the matches themselves add up.

    Fields sort as the suppression needs them: begin, longest first (`back` is minus the end), highest priority first (`low`
    is minus the priority), order of the rules.
    """
    found = F.regexp_extract_all(text, rule["pattern"], F.lit(0))
    between = F.split(text, rule["pattern"], -1)
    empty = F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as array<{DETECTION}>)").alias("out"))

    def add(acc: F.Column, pair: F.Column) -> F.Column:
        begin = acc["at"] + F.length(pair["before"])
        end = begin + F.length(pair["match"])
        one = F.struct(begin.alias("begin"), (-end).alias("back"), (-rule["priority"]).alias("low"), rule["rule"].alias("rule"), rule["label"].alias("label"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    pairs = F.zip_with(between, found, lambda b, m: F.struct(b.alias("before"), m.alias("match")))
    return F.aggregate(F.filter(pairs, lambda p: p["match"].isNotNull()), empty, add, lambda acc: acc["out"])


def uncontained(detections: F.Column) -> F.Column:
    """Detections that no other one of their priority or a higher one contains; of equal ones the first rule stays.

    In sorted order a container comes first, so the furthest end so far of each priority decides.
    """
    empty = F.struct(F.array(*[F.lit(-1)] * (TOP + 1)).alias("ends"), F.expr(f"cast(array() as array<{DETECTION}>)").alias("kept"))

    def add(acc: F.Column, d: F.Column) -> F.Column:
        end, priority = -d["back"], -d["low"]
        hidden = F.array_max(F.slice(acc["ends"], priority + 1, TOP + 1)) >= end
        ends = F.transform(acc["ends"], lambda e, i: F.when(i == priority, F.greatest(e, end)).otherwise(e))
        return F.struct(ends.alias("ends"), F.when(hidden, acc["kept"]).otherwise(F.concat(acc["kept"], F.array(d))).alias("kept"))

    return F.aggregate(F.array_sort(detections), empty, add, lambda acc: acc["kept"])


def scan_licenses(docs: DataFrame, text_col: str = "text", ordered: list[Rule] | None = None, fold: bool = False) -> DataFrame:
    """`docs` with a column `licenses` of (n_words, base, detections, score).

    detections: (begin, end, priority, rule, label) in characters, after suppression. base: (word, label) of every place where
    the words of a base phrase stand one after another, words counted from 0; the rules never suppress them. score: the
    highest priority kept, from 0.25 to 1, base phrases count as priority 1; 0 without any. Null and empty texts have no words
    and score 0; repeated rows get equal answers; an empty table stays empty; a column named `licenses` is replaced.

    The text is searched for each keyword once; rules run only where their keyword stands. With `fold` keywords are searched in
    the folded text, so that signs and line ends inside a keyword do not hide it and every match of every rule is found;
    without it a keyword has to stand letter by letter, and broken ones are missed. No shuffle, all in the row.
    """
    keywords, groups = rule_groups(ordered if ordered is not None else rules())
    docs = docs.drop("licenses")
    text, lower, flat, hits, word_list, places_of_base, kept = unused(docs, "_text", "_low", "_flat", "_hits", "_words", "_base", "_kept")
    read = docs.withColumn(text, F.coalesce(F.col(text_col), F.lit(""))).withColumn(lower, F.lower(text)).withColumn(flat, folded(F.col(text)) if fold else F.lower(text))
    low = F.col(lower)
    stands = [reduce(F.Column.__or__, [F.col(flat).contains(x) for x in (fold_keyword(k) if fold else [k])]) for k in keywords]
    gated = read.withColumn(hits, F.array_compact(F.array(*[F.when(here, F.lit(i)) for i, here in enumerate(stands)])))
    phrase = low.contains("cc") & low.contains("by") | low.contains("general") & low.contains("license") | low.contains("rights") & low.contains("reserved")
    gated = gated.withColumn(word_list, F.when(phrase, F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(WORD), F.lit(0))))
    words = F.col(word_list)

    def base_at(w: F.Column, i: F.Column) -> F.Column:
        out = F.lit(None).cast("string")
        for words_of, label in PHRASES.items():
            first, *rest = words_of.split()
            here = w == first
            for n, x in enumerate(rest, 1):
                here = here & F.coalesce(F.get(words, i + n) == x, F.lit(False))
            out = F.when(here, F.lit(label)).otherwise(out)
        return F.struct(i.cast("long").alias("word"), out.alias("label"))

    none = F.expr("cast(array() as array<struct<word: bigint, label: string>>)")
    base = F.when(phrase, F.filter(F.transform(words, base_at), lambda b: b["label"].isNotNull())).otherwise(none)
    every = F.flatten(F.transform(hits, lambda i: F.flatten(F.transform(F.element_at(groups, i + 1), lambda r: places(F.col(text), r)))))
    nothing = F.expr(f"cast(array() as array<{DETECTION}>)")
    found = gated.withColumn(places_of_base, base).withColumn(kept, F.when(F.size(hits) > 0, uncontained(every)).otherwise(nothing))
    shown = F.transform(kept, lambda d: F.struct(d["begin"].alias("begin"), (-d["back"]).alias("end"), (-d["low"]).alias("priority"), d["rule"].alias("rule"), d["label"].alias("label")))
    top = F.greatest(F.coalesce(F.array_max(F.transform(kept, lambda d: -d["low"])), F.lit(-1)), F.when(F.size(places_of_base) > 0, F.lit(1)).otherwise(F.lit(-1)))
    out = F.struct(F.regexp_count(text, F.lit(WORD)).cast("long").alias("n_words"), F.col(places_of_base).alias("base"), shown.alias("detections"), ((top + 1) / F.lit(TOP + 1.0)).alias("score"))
    return found.withColumn("licenses", out).drop(text, lower, flat, hits, word_list, places_of_base, kept)
