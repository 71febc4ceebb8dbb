"""Brand detection by a word trie, fuzzy matching and discovery of new brand names.

The dictionary is a trie of words that every task holds (its size is checked); a text walks it once, from each of its words.
A dictionary beyond the limit meets the texts by an equi join on first words instead. Similar names are found by a join on rare
positional pairs of characters within length bands, never by comparing all pairs.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Callable, Iterator
from difflib import SequenceMatcher
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmart.functions.text import CI, keep_rows
from leafmart.operators.ranking import top_per_group
from leafmart.session import cut_lineage

# Strain names and phrases that contain a brand word -> the brand they must not yield.
STRAIN_BLOCKERS = [
    (r"\b(?:ghost\s*train|super\s*(?:lemon|silver)|purple|amnesia|neville|blue|catpiss|dungeon|hawaiian|original|golden|x|double|single"
     r"|citrus|lemon|lime|mango|strawberry|peach|tropical)\s+haze\b", "Haze"),
    (r"\bhaze\s+(?:og|kush|berry|dawg|diesel|cake|cookies|dream|punch|wreck|star|pie|queen|king|widow|mac|zkittlez)\b", "Haze"),
    (r"\b(?:white|pink|gelatti|gelato|tropical|gruntz|rainbow|grape|obama|gummy|blue|apple|peach|mango|banana|melon|cherry|strawberry|lemon"
     r"|orange|potato|candy)\s+runtz\b", "Runtz"),
    (r"\bthe\s+church\b", "Church"), (r"\b5th\s+element\b", "Element"), (r"\bseche\s+select\b", "SELECT"), (r"\bselect\s+\$\d+", "SELECT"),
    (r"\bselect\s+(?:eighths?|strains?|items?|products?)\b", "SELECT"), (r"\b(?:live|cured|diamond)\s+sauce\b", "Sauce Essentials"),
    (r"\b(?:ice|variety|infused\s+ice|infused)\s+packs?\b", "PACKS"), (r"\bplus\s+(?:tax|free|more|extra|shipping|delivery)\b", "PLUS"),
    (r"\b(?:french|cinnamon)\s+toast\b", "Toast"), (r"\bterra\s+(?:cotta|firma)\b", "Terra"),
    (r"\blab\s+(?:tested|results?|reports?|analysis|verified)\b", "The Lab"),
]
FUZZY_THRESHOLD = 0.85
MIN_FUZZY_LENGTH = 4
HEAD_SPLIT = r"\s*[-|–—]\s*"


def dictionary(brands: DataFrame, variations: DataFrame | None = None, aliases: DataFrame | None = None, candidates: DataFrame | None = None) -> DataFrame:
    """Search terms: ``term`` (lower case), ``canonical``, ``brand`` (after aliases), ``is_variation``, ``n_words``.

    ``brands`` has ``brand``; ``variations`` has ``variation`` and ``canonical``; ``aliases`` has ``name`` and ``canonical``.
    ``candidates`` has ``name``, ``status`` and perhaps ``canonical_name``: approved ones that are no brand yet become brands.
    """
    names = brands.select(F.col("brand").alias("canonical"))
    if candidates is not None:
        own = F.coalesce(F.nullif("canonical_name", F.lit("")), "name") if "canonical_name" in candidates.columns else F.col("name")
        approved = candidates.filter("status = 'approved'").select(own.alias("canonical")).filter("canonical <> ''")
        # spellings that differ in case only are one brand
        approved = approved.groupBy(F.lower("canonical").alias("_low")).agg(F.min("canonical").alias("canonical"))
        names = names.unionByName(approved.join(names.select(F.lower("canonical").alias("_low")), "_low", "left_anti").select("canonical"))
    terms = names.select("canonical", F.lit(0).alias("is_variation"), F.lower("canonical").alias("term"))
    if variations is not None:
        terms = terms.unionByName(variations.select("canonical", F.lit(1).alias("is_variation"), F.lower("variation").alias("term")))
    if aliases is None:
        terms = terms.withColumn("brand", F.col("canonical"))
    else:
        a = aliases.select(F.col("name").alias("canonical"), F.col("canonical").alias("_to"))
        terms = terms.join(a, "canonical", "left").withColumn("brand", F.coalesce("_to", "canonical")).drop("_to")
    return terms.filter(F.length("term") > 0)


def blocked_brands(text: Column, blockers: list[tuple[str, str]] = STRAIN_BLOCKERS) -> Column:
    """Brands the text must not yield because it names a strain that contains the brand word."""
    return F.array_compact(F.array(*[F.when(text.rlike(CI + p), F.lit(b)) for p, b in blockers]))


#: Terms, and their bytes, that a broadcast trie may have.
TRIE_TERMS, TRIE_BYTES = 200_000, 16 << 20
WORD = re.compile(r"\w+")


class Trie:
    """Terms by their words. A term matches where it stands in a text and a word ends with it; a term that starts with a sign
    stands behind white space or at the start."""

    def __init__(self, terms: list[tuple], blockers: list[tuple[str, str]]):
        self.first: dict[str, list[tuple]] = {}
        self.signs: list[tuple] = []
        for term, canonical, brand, is_variation in terms:
            row = (term, canonical, brand, is_variation)
            found = WORD.match(term)
            if found:
                self.first.setdefault(found.group(), []).append(row)
            else:
                self.signs.append((re.compile(r"(?:^|\s)" + re.escape(term) + r"\b"), row))
        self.blockers: dict[str, list] = {}
        for pattern, brand in blockers:
            self.blockers.setdefault(brand, []).append(re.compile(pattern, re.IGNORECASE))

    def best(self, text: str | None) -> tuple[str | None, int | None]:
        low = (text or "").lower()
        if not low or low.startswith("none "):
            return None, None
        places: dict[tuple, int] = {}
        for word in WORD.finditer(low):
            for row in self.first.get(word.group(), ()):
                at = word.start()
                if row not in places and low.startswith(row[0], at) and ends_word(low, at + len(row[0])):
                    places[row] = at
        for pattern, row in self.signs:
            found = pattern.search(low)
            if found:
                places[row] = found.start()
        # the exact name or longest variation of each brand, then the best brand
        of_brand: dict[str, tuple] = {}
        for (term, canonical, brand, is_variation), at in places.items():
            score = len(term) + (100 if at < 3 else 50 if at < 10 else 0)
            rank = (-is_variation, len(term), score, brand)
            if canonical not in of_brand or rank > of_brand[canonical]:
                of_brand[canonical] = rank
        order = sorted((-score, -minus, canonical.lower(), brand, canonical) for canonical, (minus, _, score, brand) in of_brand.items())
        for minus, _, _, brand, canonical in order:
            if not any(p.search(text) for p in self.blockers.get(canonical, ())):
                return brand, -minus
        return None, None


def ends_word(text: str, at: int) -> bool:
    """A word boundary between the characters before and at a place."""
    before, after = text[at - 1], text[at : at + 1]
    return bool(WORD.match(before)) != bool(WORD.match(after))


def detect_brands(texts: DataFrame, terms: DataFrame, keys: list[str], text: str = "text",
                  blockers: list[tuple[str, str]] = STRAIN_BLOCKERS, similar: bool = False) -> DataFrame:
    """Best brand per key of ``texts`` (only keys with a match): longest term, +100 when it starts in the first
    three characters, +50 in the first ten; exact names go before variations of the same brand.

    With ``similar`` a text without any match gets the brand that resembles its head (the part before a dash or bar), with score 0.
    """
    small = fits_trie(terms)
    found = _by_trie(texts, terms, keys, text, blockers) if small else _by_join(texts, terms, keys, text, blockers)
    if not similar:
        return found.filter("brand IS NOT NULL").select(*keys, "brand", "score")
    found = found.join(texts.select(*keys, F.col(text).alias("_text")), keys, "right") if not small else found
    # read by several steps below: texts are walked once
    found = cut_lineage(found.withColumn("_head", name_head(F.col("_text"))))
    low = F.lower(F.col("_text"))
    rest = found.filter(F.col("brand").isNull() & ~F.coalesce(low.startswith("none "), F.lit(False))).select(*keys, "_text", F.col("_head").alias("name"))
    exact = terms.filter("is_variation = 0").select("canonical", F.col("brand").alias("_to"))
    near = fuzzy_brand_match(cut_lineage(rest.select("name").distinct()), exact.select(F.col("canonical").alias("brand")))
    close = rest.join(near.select("name", F.col("brand").alias("canonical")), "name").filter(~F.array_contains(blocked_brands(F.col("_text"), blockers), F.col("canonical")))
    close = close.join(exact.dropDuplicates(["canonical"]), "canonical").select(*keys, F.col("_to").alias("brand"), F.lit(0).alias("score"))
    return found.filter("brand IS NOT NULL").select(*keys, "brand", "score").unionByName(close)


def fits_trie(terms: DataFrame) -> bool:
    size = terms.agg(F.count("*"), F.sum(F.octet_length("term") + F.octet_length("canonical") + F.octet_length("brand"))).first()
    return size[0] <= TRIE_TERMS and (size[1] or 0) <= TRIE_BYTES


def _by_trie(texts: DataFrame, terms: DataFrame, keys: list[str], text: str, blockers: list[tuple[str, str]]) -> DataFrame:
    rows = [tuple(r) for r in terms.select("term", "canonical", "brand", "is_variation").distinct().collect()]  # checked by the caller
    shared = texts.sparkSession.sparkContext.broadcast((rows, blockers))

    @F.arrow_udf("struct<brand: string, score: int>")
    def walk(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        trie = Trie(*shared.value)
        for column in columns:
            brands, scores = zip(*map(trie.best, column.to_pylist()), strict=True) if len(column) else ((), ())
            yield pa.StructArray.from_arrays([pa.array(brands, pa.string()), pa.array(scores, pa.int32())], ["brand", "score"])

    return texts.select(*keys, F.col(text).alias("_text")).withColumn("_b", walk(F.col("_text"))).select(*keys, "_text", "_b.brand", "_b.score")


def _by_join(texts: DataFrame, terms: DataFrame, keys: list[str], text: str, blockers: list[tuple[str, str]]) -> DataFrame:
    """The same for a dictionary of any size: words of a text meet first words of terms, candidates are tested with the term's pattern."""
    low = F.lower(F.col(text))
    words = F.array_distinct(F.regexp_extract_all(low, F.lit(r"(?U)(\w+)"), F.lit(1)))
    usable = texts.filter(~low.startswith("none ")).select(*keys, F.col(text).alias("_text"), F.explode(words).alias("_word"))
    quoted = F.concat(F.lit(r"\Q"), F.col("term"), F.lit(r"\E\b"))
    start = F.when(F.col("term").rlike(r"(?U)^\w"), F.lit(r"(?iU)\b")).otherwise(F.lit(r"(?iU)(?:^|\s)"))
    book = terms.select("*", F.regexp_extract("term", r"(?U)(\w+)", 1).alias("_word"), F.concat(start, quoted).alias("_pattern"))
    hits = usable.join(book, "_word").filter(F.contains(F.lower("_text"), F.col("term"))).withColumn("pos", F.regexp_instr("_text", F.col("_pattern")) - 1).filter("pos >= 0")
    hits = hits.withColumn("_blocked", blocked_brands(F.col("_text"), blockers)).filter(~F.array_contains("_blocked", F.col("canonical")))
    bonus = F.when(F.col("pos") < 3, 100).when(F.col("pos") < 10, 50).otherwise(0)
    scored = hits.withColumn("score", F.length("term") + bonus)
    per_brand = scored.groupBy(*keys, "canonical").agg(
        F.max_by(F.struct("brand", "score", "is_variation"), F.struct(-F.col("is_variation"), F.length("term"), "score", "brand")).alias("r"))
    best = top_per_group(per_brand.select(*keys, "canonical", "r.*").withColumn("_low", F.lower("canonical")), keys,
                         ["score desc", "is_variation", "_low"], 1)
    return best.select(*keys, "brand", "score")


# ---------------------------------------------------------------------------
# Brand from the product address
# ---------------------------------------------------------------------------

def brands_from_url(listings: DataFrame, terms: DataFrame, key: str, url: str = "product_url") -> DataFrame:
    """Longest brand slug in the product, brand or query part of an address; store names in the path do not count.

    Parts of an address are put together up to as many as the longest brand of the dictionary has."""
    max_parts = terms.filter("is_variation = 0").agg(F.max(F.size(F.split(F.replace("term", F.lit(" "), F.lit("-")), "-")))).first()[0] or 1
    low = F.lower(F.col(url))
    tails = [F.regexp_extract(low, rf"(/{m}/.*)$", 1) for m in ("product", "products", "brands")]
    query = F.regexp_extract(low, r"(\?.*)$", 1)
    df = listings.select(key, F.concat_ws(" ", *tails, query).alias("_s")).withColumn("_s", F.regexp_replace("_s", r"\?", "/?"))
    segs = df.select(key, "_s", F.posexplode(F.split("_s", "/")).alias("_at", "_seg")).withColumn(
        "_open", F.col("_at") == F.size(F.split("_s", "/")) - 1).filter("_at > 0 AND _seg <> ''")
    parts = segs.withColumn("_p", F.split("_seg", "-"))
    pos = parts.select(key, "_open", "_p", F.posexplode("_p").alias("_i", "_w"))
    sizes = F.array(*[F.lit(n) for n in range(1, max_parts + 1)])
    grams = pos.withColumn("_n", F.explode(F.filter(sizes, lambda n: F.col("_i") + n <= F.size("_p"))))
    at_end = F.col("_i") + F.col("_n") == F.size("_p")
    fits = ~at_end | ((F.col("_i") == 0) & ~F.col("_open"))
    slug = F.array_join(F.slice("_p", F.col("_i") + 1, F.col("_n")), "-")
    value = F.regexp_extract("_seg", r"brand=([^&]*)", 1)
    by_query = segs.withColumn("_v", value).filter("_v <> ''").select(
        key, F.explode(F.transform(F.sequence(F.lit(1), F.length("_v")), lambda n: F.substr(F.col("_v"), F.lit(1), n))).alias("slug"))
    found = grams.filter(fits).select(key, slug.alias("slug")).unionByName(by_query)
    exact = terms.filter("is_variation = 0")
    slugs = exact.select(F.replace("term", F.lit(" "), F.lit("-")).alias("slug"), "term", "canonical")
    joined = found.join(slugs, "slug")
    return joined.groupBy(key).agg(F.max_by("canonical", F.struct(F.length("term"), "term")).alias("brand"))


def label_brands(listings: DataFrame, terms: DataFrame, key: str, raw: str = "raw_text") -> DataFrame:
    """Brands that stand alone on a line of the card, in order of the lines (``labels``)."""
    lines = listings.select(key, F.posexplode(F.split(F.coalesce(F.col(raw), F.lit("")), "\n")).alias("line", "_l"))
    bare = F.btrim(F.trim("_l"), F.lit(".,;:-|"))
    lines = lines.select(key, "line", F.lower(bare).alias("_l")).filter((F.length("_l") > 0) & (F.length("_l") <= 30))
    own = terms.filter((F.col("is_variation") == 0) & (F.col("brand") == F.col("canonical")))
    hits = lines.join(own.select(F.col("term").alias("_l"), "canonical"), "_l").groupBy(key, "canonical").agg(F.min("line").alias("line"))
    return hits.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("line", "canonical"))), lambda x: x["canonical"]).alias("labels"))


LINE_END = "\n\r\u0085\u2028\u2029"


class Book:
    """The dictionary as a task holds it to name the brand of a listing: trie, address parts and label lines."""

    def __init__(self, terms: list[tuple], blockers: list[tuple[str, str]]):
        self.trie = Trie(terms, blockers)
        self.slugs: dict[str, tuple] = {}
        self.lines: dict[str, list[str]] = {}
        self.most_parts = 1
        for term, canonical, brand, is_variation in terms:
            if is_variation:
                continue
            slug = term.replace(" ", "-")
            self.most_parts = max(self.most_parts, slug.count("-") + 1)
            self.slugs[slug] = max(self.slugs.get(slug, (0, "", "")), (len(term), term, canonical))
            if brand == canonical:
                self.lines.setdefault(term, []).append(canonical)
        last = rf"(?=(?:\r\n|[{LINE_END}])?\Z)"
        self.tails = [(m, re.compile(rf"{re.escape(m)}[^{LINE_END}]*{last}")) for m in ("/product/", "/products/", "/brands/", "?")]

    def of_url(self, low: str | None) -> str | None:
        """As `brands_from_url`, for one lower-case address."""
        if not low:
            return None
        tails = []
        for marker, pattern in self.tails:
            found = pattern.search(low) if marker in low else None
            tails.append(found.group() if found else "")
        best, text = (0, "", ""), " ".join(tails).replace("?", "/?")
        segments = text.split("/")
        for number, segment in enumerate(segments):
            if not number or not segment:
                continue
            parts = segment.split("-")
            whole = number < len(segments) - 1
            for i in range(len(parts)):
                slug = ""
                for n in range(i, min(len(parts), i + self.most_parts)):
                    slug = f"{slug}-{parts[n]}" if n > i else parts[n]
                    if slug in self.slugs and (n < len(parts) - 1 or (i == 0 and whole)):
                        best = max(best, self.slugs[slug])
            at = segment.find("brand=")
            if at >= 0:
                value = segment[at + 6 :].split("&", 1)[0]
                best = max([best, *(self.slugs[value[:n]] for n in range(1, len(value) + 1) if value[:n] in self.slugs)])
        return best[2] if best[0] else None

    def labels(self, raw: str | None) -> list[str]:
        """As `label_brands`, for one card."""
        first: dict[str, int] = {}
        for line, text in enumerate((raw or "").split("\n")):
            bare = text.strip(" ").strip(".,;:-|").lower()
            if 0 < len(bare) <= 30:
                for canonical in self.lines.get(bare, ()):
                    first.setdefault(canonical, line)
        return sorted(first, key=lambda c: (first[c], c))

    def brand(self, element: str | None, url: str | None, raw: str | None, name: str | None, card: str | None) -> str | None:
        """Brand of a listing, see `resolve_brand`; a text is walked only if those before it name none."""
        base = self.trie.best(element)[0] or self.of_url(url)
        if base and element:
            return base
        labels = self.labels(raw)
        base = base or (labels[0] if labels else None) or self.trie.best(name)[0] or self.trie.best(card)[0]
        if element or not base:
            return base
        return next((x for x in labels if x.lower() != base.lower()), base)


def resolve_brand(listings: DataFrame, terms: DataFrame, key: str = "id") -> DataFrame:
    """Brand per listing: scraped element, address, label line, name, card text; without a scraped element a label
    line that names another brand wins. Needs ``scraped_brand``, ``product_url``, ``raw_text``, ``name`` and ``card``.

    A dictionary that fits a trie is looked up in the row itself; only a larger one needs joins by ``key``."""
    if not fits_trie(terms):
        return _brand_by_joins(listings, terms, key)
    rows = [tuple(r) for r in terms.select("term", "canonical", "brand", "is_variation").distinct().collect()]  # checked above
    shared = listings.sparkSession.sparkContext.broadcast((rows, STRAIN_BLOCKERS))

    @F.arrow_udf("string")
    def look_up(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        book = Book(*shared.value)
        for columns in batches:
            yield pa.array(map(book.brand, *(c.to_pylist() for c in columns)), pa.string())

    return listings.withColumn("brand", look_up(F.col("scraped_brand"), F.lower("product_url"), F.col("raw_text"), F.col("name"), F.col("card")))


def _brand_by_joins(listings: DataFrame, terms: DataFrame, key: str) -> DataFrame:
    names = {"scraped_brand": "_scraped", "name": "_name", "card": "_card"}
    sources = listings.select(key, F.posexplode(F.array(*names)).alias("_src", "text")).filter(F.coalesce("text", F.lit("")) != "")
    found = detect_brands(sources, terms, [key, "_src"])
    by_source = found.groupBy(key).agg(*[F.max(F.when(F.col("_src") == i, F.col("brand"))).alias(n) for i, n in enumerate(names.values())])
    out = listings.join(by_source, key, "left")
    out = out.join(brands_from_url(listings, terms, key).withColumnRenamed("brand", "_url"), key, "left")
    out = out.join(label_brands(listings, terms, key), key, "left")
    out = out.withColumn("labels", F.coalesce("labels", F.array().cast("array<string>")))
    out = out.withColumn("_base", F.coalesce("_scraped", "_url", F.get("labels", F.lit(0)), "_name", "_card"))
    other = F.get(F.filter("labels", lambda x: F.lower(x) != F.lower("_base")), F.lit(0))
    no_element = F.coalesce("scraped_brand", F.lit("")) == ""
    brand = F.when(no_element & F.col("_base").isNotNull(), F.coalesce(other, "_base")).otherwise(F.col("_base"))
    return out.withColumn("brand", brand).drop("_scraped", "_name", "_card", "_url", "labels", "_base")


def name_head(name: Column) -> Column:
    """Text before the first dash or bar, where an unknown brand usually stands."""
    return F.trim(F.get(F.split(name, HEAD_SPLIT, 2), F.lit(0)))


# ---------------------------------------------------------------------------
# Similar names
# ---------------------------------------------------------------------------

#: From this length on `SequenceMatcher` leaves out characters that are frequent.
LONG_NAME = 200


def matched_characters(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Characters of the matching blocks of `SequenceMatcher`, for rows of code points of one length on either side: the longest
    common run (the first in `a`, then in `b`), then the same left and right of it, for all rows at once."""
    total = np.zeros(len(a), dtype=np.int64)
    row = np.arange(len(a))
    places = np.arange(b.shape[1])
    a_from, b_from = np.zeros(len(a), dtype=np.int64), np.zeros(len(a), dtype=np.int64)
    a_to, b_to = np.full(len(a), a.shape[1]), np.full(len(a), b.shape[1])
    while len(row):
        left, right = a[row], b[row]
        inside = (places >= b_from[:, None]) & (places < b_to[:, None])
        runs = np.zeros((len(row), b.shape[1] + 1), dtype=np.int16)
        size, a_at, b_at = (np.zeros(len(row), dtype=np.int64) for _ in range(3))
        for i in range(a_from.min(), a_to.max()):
            same = (left[:, i : i + 1] == right) & inside & ((i >= a_from) & (i < a_to))[:, None]
            runs[:, 1:] = np.where(same, runs[:, :-1] + 1, 0)
            j = runs.argmax(axis=1)
            run = runs[np.arange(len(row)), j].astype(np.int64)
            longer = run > size
            size, a_at, b_at = np.where(longer, run, size), np.where(longer, i + 1 - run, a_at), np.where(longer, j - run, b_at)
        total += np.bincount(row, size, len(a)).astype(np.int64)
        parts = [np.concatenate(x) for x in ((row, row), (a_from, a_at + size), (a_at, a_to), (b_from, b_at + size), (b_at, b_to), (size, size))]
        go_on = (parts[5] > 0) & (parts[1] < parts[2]) & (parts[3] < parts[4])
        row, a_from, a_to, b_from, b_to = (x[go_on] for x in parts[:5])
    return total


def ratios(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio of each pair of names, those of the same two lengths together."""
    out = np.zeros(len(a))
    a, b = a.reset_index(drop=True), b.reset_index(drop=True)
    for (n, m), at in a.groupby([a.map(len), b.map(len)]).indices.items():
        if n and m and m < LONG_NAME:
            codes = [np.array(x.iloc[at].tolist(), dtype=f"U{k}").view(np.uint32).reshape(len(at), k) for x, k in ((a, n), (b, m))]
            out[at] = 2.0 * matched_characters(*codes) / (n + m)
        else:
            out[at] = [SequenceMatcher(None, x, y).ratio() for x, y in zip(a.iloc[at], b.iloc[at], strict=True)]
    return pd.Series(out)


#: Not moved below a step that leaves fewer pairs, as a filter on a plain function would be.
similarity = F.pandas_udf(ratios, T.DoubleType()).asNondeterministic()


def _matched(total: int, threshold: float) -> int:
    """Least number of matched characters of a pair with `total` characters and a ratio of the threshold."""
    return math.ceil(threshold * total / 2 - 1e-9)


def _tokens(names: DataFrame, name: str, q: int) -> DataFrame:
    """Runs of q characters of a name with their occurrence number and place, and whether the run occurs again."""
    runs = F.transform(F.sequence(F.lit(1), F.length(name) - q + 1), lambda i: F.substr(F.col(name), i, F.lit(q)))
    grams = names.filter(F.length(name) >= q).select(name, F.length(name).alias("len"), F.posexplode(runs).alias("at", "gram"))
    own = Window.partitionBy(name, "gram")
    nth = F.row_number().over(own.orderBy("at"))
    return grams.select(name, "len", "at", F.concat_ws("#", nth.cast("string"), "gram").alias("token"), (F.count("*").over(own) > 1).alias("again"))


def _prefix_join(left: DataFrame, right: DataFrame, threshold: float, q: int, needed: dict[tuple[int, int], int]) -> DataFrame:
    """Pairs that share one of the rarest tokens each must share, for the pairs of lengths in `needed` (length, length -> common tokens)."""
    spark = left.sparkSession
    rows = [(a, b, n, max(a, b) - _matched(a + b, threshold)) for (a, b), n in needed.items()]
    lengths = F.broadcast(small_table(spark, rows, len_a=pa.int32(), len_b=pa.int32(), common=pa.int32(), shift=pa.int32()))  # a row a pair of lengths
    left = left.filter(F.length("a").isin(sorted({a for a, _ in needed})))
    right = right.filter(F.length("b").isin(sorted({b for _, b in needed})))
    freq = _tokens(right, "b", q).groupBy("token").agg(F.count("*").alias("f"))

    def prefix(names: DataFrame, name: str) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy(name).orderBy(F.coalesce("f", F.lit(0)), "token"))
        ranked = _tokens(names, name, q).join(freq, "token", "left").withColumn("r", rank)
        open_ = ranked.join(lengths, F.col("len") == F.col(f"len_{name}")).filter(F.col("r") <= F.col("len") - q + 2 - F.col("common"))
        return open_.select(name, "len_a", "len_b", "shift", "token", F.col("at").alias(f"at_{name}"), F.col("again").alias(f"again_{name}"))

    pairs = prefix(left, "a").join(prefix(right, "b").drop("shift"), ["len_a", "len_b", "token"])
    near = F.col("again_a") | F.col("again_b") | (F.abs(F.col("at_a") - F.col("at_b")) <= F.col("shift"))
    return pairs.filter(near).select("a", "b").distinct()


#: Strings that a task makes of its names, if there are enough for all cores.
STRINGS_A_TASK = 1_000_000


def spread(rows: DataFrame, *cols: str, tasks: int = 0) -> DataFrame:
    """Rows of few bytes and much work, on some tasks for each core or on more; by their bytes alone they would end up in one."""
    return rows.repartition(max(tasks, 4 * rows.sparkSession.sparkContext.defaultParallelism), F.xxhash64(*cols))


def small_table(spark: SparkSession, rows: list[tuple], **columns: pa.DataType) -> DataFrame:
    """Rows made by the driver, as a part of the plan; as a list they would pass through Python workers."""
    return spark.createDataFrame(pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate(columns.values())], list(columns)))


#: Ways to leave characters out of a name, at most, for it to be joined on what they leave.
MOST_REMAINDERS = 1_000


def _remainders(names: DataFrame, name: str, kept: dict[int, list[int]], count: dict[int, int]) -> DataFrame:
    """Names with a hash of each distinct string that is left when all but `common` characters go (``kept``: length -> values of common;
    ``count``: length -> names)."""

    def leave_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of_length: dict[int, list[str]] = {}
            for text in batch.column(0).to_pylist():
                of_length.setdefault(len(text), []).append(text)
            for length, texts in of_length.items():
                for common in kept.get(length, ()):
                    places = np.array(list(itertools.combinations(range(length), common)))
                    step = max(1, (1 << 20) // len(places))
                    for at in range(0, len(texts), step):
                        part = texts[at : at + step]
                        codes = np.array(part, dtype=f"U{length}").view(np.uint32).reshape(len(part), length).astype(np.uint64)
                        key = np.full((len(part), len(places)), common, dtype=np.uint64)
                        for j in range(common):
                            key = (key ^ codes[:, places[:, j]]) * np.uint64(0x9E3779B97F4A7C15)
                            key ^= key >> np.uint64(29)
                        key.sort(axis=1)
                        first = np.ones(key.shape, dtype=bool)
                        first[:, 1:] = key[:, 1:] != key[:, :-1]
                        owner = np.repeat(np.arange(len(part)), first.sum(axis=1))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(part, pa.string()).take(pa.array(owner)), pa.array(np.full(len(owner), common, dtype=np.int32)), pa.array(key[first].view(np.int64))],
                            [name, "common", "key"])

    strings = sum(count[n] * math.comb(n, m) for n, values in kept.items() for m in values)
    rows = spread(names.filter(F.length(name).isin(sorted(kept))).select(name), name, tasks=strings // STRINGS_A_TASK)
    return rows.mapInArrow(leave_out, f"{name} string, common int, key long")


def _remainder_join(left: DataFrame, right: DataFrame, needed: dict[tuple[int, int], int], counts: tuple[dict[int, int], dict[int, int]]) -> DataFrame:
    """Pairs that have the string of their matched characters in common; equal hashes of different strings only add pairs."""
    kept = lambda side: {n: sorted({m for key, m in needed.items() if key[side] == n}) for n in {key[side] for key in needed}}
    rows = [(a, b, m) for (a, b), m in needed.items()]
    lengths = F.broadcast(small_table(left.sparkSession, rows, len_a=pa.int32(), len_b=pa.int32(), common=pa.int32()))  # a row a pair of lengths
    # a name leaves up to thousands of strings: its bytes do not tell the size, so no side is broadcast
    pairs = _remainders(left, "a", kept(0), counts[0]).join(_remainders(right, "b", kept(1), counts[1]).hint("merge"), ["common", "key"])
    pairs = pairs.withColumns({"len_a": F.length("a"), "len_b": F.length("b")}).join(lengths, ["len_a", "len_b", "common"], "left_semi")
    return pairs.select("a", "b").distinct()


def any_lengths(a: int, b: int) -> bool:
    return True


def longer_right(a: int, b: int) -> bool:
    return b >= a


def candidate_pairs(left: DataFrame, right: DataFrame, threshold: float, fits: Callable[[int, int], bool] = any_lengths) -> DataFrame:
    """Pairs (a, b) of distinct names, all that can reach the ratio and few others; only names of lengths that ``fits`` accepts meet.

    A ratio of t means M >= t/2 x (len a + len b) matched characters, in blocks that stand in the same order in both: leaving out
    the others turns both names into one string. Names are therefore joined on all strings of M of their characters, where there
    are at most `MOST_REMAINDERS` for a name. Longer names: with k characters unmatched there are k + 1 blocks at most, which
    together hold M - k - 1 common pairs of neighbours, each shifted by no more than the unmatched characters of a name; they are
    joined, length by length, on the rarest of their positional pairs, and on their rarest characters where no common pair is certain.
    """
    def ends(names: DataFrame, name: str) -> dict[int, int]:
        return {r[0]: r[1] for r in names.groupBy(F.length(name)).count().collect() if r[0]}  # a row a name length

    counts = ends(left, "a"), ends(right, "b")
    both = [(a, b, _matched(a + b, threshold)) for a in counts[0] for b in counts[1]]
    both = [(a, b, m) for a, b, m in both if m <= min(a, b) and fits(a, b)]
    short = {(a, b): m for a, b, m in both if max(math.comb(a, m), math.comb(b, m)) <= MOST_REMAINDERS}
    long = [x for x in both if x[:2] not in short]
    by_pair = {(a, b): 3 * m - a - b - 1 for a, b, m in long if 3 * m - a - b - 1 >= 1 and min(a, b) >= 2}
    by_char = {(a, b): m for a, b, m in long if (a, b) not in by_pair}
    parts = [_remainder_join(left, right, short, counts)] if short else []
    parts += [_prefix_join(left, right, threshold, q, needed) for q, needed in ((2, by_pair), (1, by_char)) if needed]
    return reduce(DataFrame.unionByName, parts) if parts else left.sparkSession.createDataFrame([], "a string, b string")


def similar_pairs(left: DataFrame, right: DataFrame, threshold: float, wanted: Callable[[DataFrame], DataFrame] = lambda pairs: pairs,
                  fits: Callable[[int, int], bool] = any_lengths) -> DataFrame:
    """All pairs (a, b) of distinct lower-case names with ratio >= threshold, without comparing all pairs; only those that
    ``wanted`` leaves are compared, and only names of lengths that ``fits`` accepts."""
    pairs = wanted(candidate_pairs(left, right, threshold, fits))
    # what does not match lies between matches, so replacing it turns one name into the other in as many edits at most
    unmatched = F.length("a") + F.length("b") - 2 * F.ceil(threshold * (F.length("a") + F.length("b")) / 2 - 1e-9)
    pairs = spread(pairs.filter(F.levenshtein("a", "b") <= unmatched), "a", "b")
    return pairs.withColumn("ratio", similarity("a", "b")).filter(F.col("ratio") >= threshold)


def fuzzy_brand_match(names: DataFrame, brands: DataFrame, threshold: float = FUZZY_THRESHOLD) -> DataFrame:
    """Closest brand per distinct name of at least four letters: ``name``, ``brand``, ``ratio`` (1.0 when equal)."""
    distinct = names.select("name").filter(F.length("name") >= MIN_FUZZY_LENGTH).distinct().withColumn("a", F.lower(F.trim("name")))
    known = brands.select("brand").distinct().withColumn("b", F.lower("brand"))
    band = F.abs(F.length("a") - F.length("b")) <= F.greatest(F.lit(3), F.length("a") * 0.4)
    pairs = similar_pairs(distinct.select("a").distinct(), known.select("b").distinct(), threshold, lambda x: x.filter(band))
    best = pairs.join(known, "b").groupBy("a").agg(F.max_by(F.struct("brand", "ratio"), F.struct("ratio", F.col("brand"))).alias("r"))
    return distinct.join(best, "a").select("name", "r.brand", "r.ratio")


def normalize_candidate(name: Column) -> Column:
    return F.trim(F.regexp_replace(name, CI + r"\s*(?:cannabis|extracts?|labs?|farms?|edibles?|vapes?)\s*$", ""))


def join_leaders(names: DataFrame, leaders: DataFrame, threshold: float = 0.80, fits: Callable[[int, int], bool] = any_lengths) -> DataFrame:
    """``name`` and ``leader`` of the names that resemble a leader and are none: the longest, then the first by name."""
    lows = names.select(F.lower("name").alias("a")).distinct()
    known = leaders.select(F.col("name").alias("leader"), F.lower("name").alias("b")).distinct()
    near = similar_pairs(lows, known.select("b").distinct(), threshold, fits=fits).join(known, "b")
    rows = names.select("name", F.lower("name").alias("a")).distinct().join(near.select("a", "leader"), "a")
    return rows.groupBy("name").agg(F.min_by("leader", F.struct(-F.length("leader"), "leader")).alias("leader"))


def clusters_with(names: DataFrame, leaders: DataFrame | None, threshold: float = 0.80) -> DataFrame:
    """``name`` and ``leader``: names meet the stored leaders first, only the rest is clustered. Clustering again what is stored changes nothing."""
    if leaders is None:
        return leader_clusters(names, threshold)
    own = names.select("name").distinct().join(leaders.select("name"), "name", "left_semi").withColumn("leader", F.col("name"))
    others = cut_lineage(names.select("name").distinct().join(leaders.select("name"), "name", "left_anti"))
    settled = cut_lineage(own.unionByName(join_leaders(others, leaders, threshold)))
    return settled.unionByName(leader_clusters(others.join(settled, "name", "left_anti"), threshold))


#: Names that are compared among themselves at once, if fewer share length and first character.
BAND = 50_000
#: Edges that one task settles.
SETTLED_AT_ONCE = 200_000


def _bands(cells: list[tuple[int, str, int]]) -> list[tuple[tuple[int, str], tuple[int, str]]]:
    """First and last (length, first character) of the bands, in the order in which names take their turn; a band has `BAND` names
    or a single cell."""
    out, size = [], 0
    for length, first, n in sorted(cells, key=lambda c: (-c[0], c[1].encode())):
        if out and size + n <= BAND:
            out[-1], size = (out[-1][0], (length, first)), size + n
        else:
            out.append(((length, first), (length, first)))
            size = n
    return out


def leader_clusters(names: DataFrame, threshold: float = 0.80) -> DataFrame:
    """Clusters as a greedy pass would make them: names from long to short, then by name, each joins the first earlier leader it
    resembles, or leads itself. Returns ``name`` and ``leader``.

    Names take their turn band by band: those of a band meet the leaders of earlier bands, and only what resembles none of them is
    compared within the band. So names meet leaders, of which few resemble each other, not all other names.
    """
    nodes = cut_lineage(names.select("name").distinct())
    moved = F.max((F.length(F.lower("name")) != F.length("name")).cast("int")).alias("moved")
    cells = nodes.groupBy(F.length("name").alias("length"), F.substring("name", 1, 1).alias("first")).agg(F.count("*").alias("n"), moved).collect()  # a row a length and character
    # earlier names are not shorter; lower case changes the length of few letters of the world
    fits = any_lengths if any(c["moved"] for c in cells) else longer_right
    length, first = F.length("name"), F.substring("name", 1, 1)
    done: list[DataFrame] = []
    for (long, at), (short, to) in _bands([(c["length"], c["first"], c["n"]) for c in cells]):
        rows = nodes.filter(((length < long) | ((length == long) & (first >= at))) & ((length > short) | ((length == short) & (first <= to))))
        if done:
            leaders = reduce(DataFrame.unionByName, done).filter("name = leader").select("name")
            done.append(cut_lineage(join_leaders(rows, leaders, threshold, fits)))
            rows = cut_lineage(rows.join(done[-1], "name", "left_anti"))
        done.append(cut_lineage(_band_clusters(rows, threshold, fits)))
    return reduce(DataFrame.unionByName, done) if done else nodes.select("name", F.col("name").alias("leader"))


def _settled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Names that join a leader, from all edges that are still open."""
    earlier: dict[str, list[str]] = {}
    for batch in batches:
        for later, name in zip(batch["later"], batch["earlier"], strict=True):
            earlier.setdefault(later, []).append(name)
    lost: set[str] = set()
    for name in sorted(earlier, key=lambda x: (-len(x), x.encode())):
        if not lost.issuperset(earlier[name]):
            lost.add(name)
    yield pd.DataFrame({"later": sorted(lost)}, dtype=object)


def _band_clusters(names: DataFrame, threshold: float, fits: Callable[[int, int], bool]) -> DataFrame:
    """Clusters among the names of a band.

    A name leads unless an earlier leader resembles it. In rounds, open names without an open earlier neighbour lead, and what
    they resemble is lost; edges of lost names go, so that each round meets the open ones only. The last edges are settled in one task.
    """
    order = F.struct((-F.length("name")).alias("l"), F.col("name").alias("n"))
    nodes = names.select("name").distinct().withColumn("low", F.lower("name")).withColumn("pos", order)
    lows = nodes.select(F.col("low").alias("a")).distinct()
    first, last = (nodes.groupBy(F.col("low").alias(c)).agg(f("pos").alias(f"_{c}")) for c, f in (("b", F.min), ("a", F.max)))
    wanted = lambda x: x.join(first, "b").join(last, "a").filter("_b < _a").select("a", "b")
    pairs = similar_pairs(lows, lows.select(F.col("a").alias("b")), threshold, wanted, fits)
    a, b = nodes.alias("a"), nodes.alias("b")
    edges = pairs.join(a.select(F.col("low").alias("a"), F.col("name").alias("later"), F.col("pos").alias("pl")), "a").join(
        b.select(F.col("low").alias("b"), F.col("name").alias("earlier"), F.col("pos").alias("pe")), "b").filter("pe < pl")
    edges = cut_lineage(edges.select("later", "earlier", "pe"))
    open_, lost = edges.select("later", "earlier"), []
    while open_.count() > SETTLED_AT_ONCE:
        heads = open_.select("earlier").distinct().join(open_.select(F.col("later").alias("earlier")).distinct(), "earlier", "left_anti")
        lost.append(cut_lineage(open_.join(heads, "earlier", "left_semi").select("later").distinct()))
        open_ = cut_lineage(open_.join(lost[-1], "later", "left_anti").join(lost[-1].select(F.col("later").alias("earlier")), "earlier", "left_anti"))
    lost.append(open_.repartition(1).mapInPandas(_settled, "later string"))
    names = nodes.select("name")
    behind = cut_lineage(reduce(DataFrame.unionByName, lost))
    joined = edges.join(behind.select(F.col("later").alias("earlier")), "earlier", "left_anti").groupBy(F.col("later").alias("name")).agg(F.min_by("earlier", "pe").alias("first"))
    return names.join(joined, "name", "left").select("name", F.coalesce("first", "name").alias("leader"))


def recent_unmatched(daily: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Rows of today, or of the last days when today has none."""
    today = F.lit(as_of[:10]).cast("date")
    now = daily.filter(F.col("run_date") >= today)
    return now if not now.isEmpty() else daily.filter(F.col("run_date") >= F.date_sub(today, days))


def brand_candidates(daily: DataFrame, brands: DataFrame, min_observations: int = 10, leaders: DataFrame | None = None) -> DataFrame:
    """New brand names from daily unmatched names (``region``, ``run_date``, ``names`` array).

    Names are normalised and counted in Spark; only names seen often enough are clustered, stored ``leaders`` (``name``) first.
    Names that are a known brand (equal, or similar by 0.95) are left out. ``state_count`` counts regions.
    """
    seen = daily.select("region", F.explode("names").alias("raw")).filter(F.length("raw") >= 3).groupBy("raw", "region").agg(F.count("*").alias("c"))
    # texts are read once; a spelling is normalised once, not once an observation
    words = cut_lineage(keep_rows(seen.withColumn("name", normalize_candidate(F.col("raw"))), F.col("name") != ""))
    by_region = words.groupBy("name", "region").agg(F.sum("c").alias("c"))
    counts = by_region.groupBy("name").agg(F.sum("c").alias("n"), F.collect_list("region").alias("regions"))
    frequent = cut_lineage(counts.filter(F.col("n") >= min_observations))
    clusters = cut_lineage(clusters_with(frequent, leaders))
    raws = words.groupBy("name", "raw").agg(F.sum("c").alias("c"))
    samples = top_per_group(raws.join(frequent.select("name"), "name", "left_semi"), ["name"], ["c desc", "raw"], 5)
    sample_of = samples.join(clusters, "name").groupBy("leader").agg(
        F.slice(F.array_sort(F.collect_set("raw")), 1, 5).alias("samples"))
    merged = frequent.join(clusters, "name").groupBy("leader").agg(
        F.sum("n").alias("observation_count"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("regions")))).alias("regions_seen"))
    closest = fuzzy_brand_match(merged.select(F.col("leader").alias("name")), brands, 0.70).select(
        F.col("name").alias("leader"), F.col("brand").alias("closest_existing_brand"), "ratio")
    known = brands.select(F.lower("brand").alias("_b")).distinct()
    out = merged.join(sample_of, "leader", "left").join(closest, "leader", "left").filter(F.coalesce("ratio", F.lit(0.0)) < 0.95)
    out = out.join(known, F.lower("leader") == F.col("_b"), "left_anti")
    return out.select(F.col("leader").alias("name"), "observation_count", F.size("regions_seen").cast("long").alias("state_count"), "regions_seen",
                      "samples", "closest_existing_brand", F.round("ratio", 3).alias("similarity_score"), F.lit("pending").alias("status"))


def learn_brands(daily: DataFrame, brands: DataFrame, stored: DataFrame, as_of: str, days: int = 30, min_observations: int = 10) -> DataFrame:
    """The candidates table after a run: unmatched names of today or the last days, upserted by name into ``stored``.

    Stored candidates lead the clusters, so a name keeps its candidate; a candidate that is seen again takes the new counts and
    keeps the status an admin gave it. Running again over the same days changes nothing.
    """
    found = brand_candidates(recent_unmatched(daily, as_of, days), brands, min_observations, stored.select("name"))
    found = found.withColumn("last_seen_at", F.lit(as_of).cast("timestamp"))
    old = stored.select("name", F.col("status").alias("_status"))
    found = cut_lineage(found.join(old, "name", "left").withColumn("status", F.coalesce("_status", "status")).drop("_status"))
    return found.unionByName(stored.join(found.select("name"), "name", "left_anti"), allowMissingColumns=True)
