"""Order-dependent selection: shop window order, featured offers and the post queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmart.functions.arrays import let
from leafmart.functions.pricing import chain_of
from leafmart.operators.ranking import SCORE_ORDER, top_n, top_per_group

# ---------------------------------------------------------------------------
# Shop window
# ---------------------------------------------------------------------------

def hero_niche() -> Column:
    """Slot 0 to 6 of the opening row an offer qualifies for."""
    cat, sub, w, unit = F.col("category"), F.coalesce("product_subtype", F.lit("")), F.col("weight_value"), F.col("weight_unit")
    g = F.when(unit == "g", w).when(unit == "mg", w / 1000)
    disposable = (cat == "vape") & (sub == "disposable")
    return (F.when((cat == "edible") & (unit == "mg") & w.between(80, 120), 0).when(disposable & g.between(0.7, 1.1), 1)
            .when((cat == "preroll") & ~sub.isin("infused_preroll", "preroll_pack"), 2).when((cat == "flower") & g.between(3.0, 4.0), 3)
            .when((cat == "flower") & g.between(6.5, 8.0), 4).when(disposable & g.between(0.25, 0.6), 5)
            .when((cat == "flower") & g.between(13.0, 15.0), 6))


def hero_slots(deals: DataFrame, group_cols: list[str]) -> DataFrame:
    """Cheapest offer per niche from a store not used by an earlier slot, else the cheapest.

    At most six stores are used before a slot, so the cheapest offers of the seven cheapest stores per niche (49 rows
    a group) decide; the choice is then a fold over the seven sorted lists, without Python.
    """
    cand = deals.withColumn("slot", hero_niche()).filter("slot IS NOT NULL").withColumn("_price", F.col("sale_price").cast("double"))
    per_store = top_per_group(cand, [*group_cols, "slot", "dispensary_id"], ["_price", "id"], 1)
    few = top_per_group(per_store, [*group_cols, "slot"], ["_price", "id"], 7)
    lists = few.groupBy(*group_cols, "slot").agg(F.array_sort(F.collect_list(F.struct("_price", "id", "dispensary_id"))).alias("c"))
    rows = lists.groupBy(*group_cols).agg(F.array_sort(F.collect_list(F.struct("slot", "c"))).alias("slots"))
    start = F.array().cast("array<struct<slot:int,id:string,dispensary_id:string>>")

    def step(done: Column, s: Column) -> Column:
        used = F.transform(done, lambda x: x["dispensary_id"])
        fresh = F.filter(s["c"], lambda x: ~F.array_contains(used, x["dispensary_id"]))
        pick = F.coalesce(F.get(fresh, F.lit(0)), F.get(s["c"], F.lit(0)))
        return F.concat(done, F.array(F.struct(s["slot"].alias("slot"), pick["id"].alias("id"), pick["dispensary_id"].alias("dispensary_id"))))

    picked = rows.select(*group_cols, F.aggregate("slots", start, step).alias("p"))
    return picked.select(*group_cols, F.inline("p"))


SHUFFLE_TIERS = {1: 0.40, 2: 0.45, 3: 0.15}
#: Opening places in which no store shows more than two offers; heroes keep theirs.
OPENING, HEROES, OPENING_PER_STORE = 12, 7, 2
CARD = "struct<tier: int, draw: string, id: string, brand: string, category: string, store: string, chain: string>"


def _swapped(deck: Column, i: Column, j: Column) -> Column:
    return F.transform(deck, lambda x, k: F.when(k == i, F.get(deck, j)).when(k == j, F.get(deck, i)).otherwise(x))


def _draw(done: Column, i: Column) -> Column:
    """One more card: of the tier that lags most behind its share the first that keeps the spacing rules, else of another tier, else
    the first of that tier. No brand follows itself, no category stands four times in a row, no store or chain three times."""
    left, out = done["left"], done["out"]
    lag = lambda t, share: F.struct((F.lit(share) * i - F.size(F.filter(out, lambda y: y["tier"] == t))).alias("lag"), F.lit(-t).alias("tier"))
    lags = F.array(*[F.when(F.exists(left, lambda x: x["tier"] == t), lag(t, share)) for t, share in SHUFFLE_TIERS.items()])
    first = -F.array_max(F.array_compact(lags))["tier"]
    tail = lambda n: F.slice(F.reverse(out), 1, n)
    recent = F.struct(first.alias("first"), tail(1).alias("one"), tail(2).alias("two"), tail(3).alias("three"))

    def ranked(r: Column) -> Column:
        same = lambda name, field, n, x: (F.size(r[name]) == n) & F.forall(r[name], lambda y: y[field] == x[field])
        return F.array_min(F.transform(left, lambda x: F.struct(
            (same("one", "brand", 1, x) | same("three", "category", 3, x) | same("two", "store", 2, x) | same("two", "chain", 2, x)).alias("breaks"),
            F.when(x["tier"] == r["first"], 0).otherwise(x["tier"]).alias("turn"), x["draw"].alias("draw"), x["id"].alias("id"))))["id"]

    # a card that breaks a rule is only taken when all do, and then of the first tier: breaks sorts before turn
    return let(let(recent, ranked), lambda best: F.struct(
        F.filter(left, lambda x: x["id"] != best).alias("left"), F.concat(out, F.filter(left, lambda x: x["id"] == best)).alias("out")))


def _spread_stores(deck: Column) -> Column:
    """Cards of a store that stands more than twice in the opening trade places with the first later card of a store that does not."""
    def trade(cards: Column, i: Column) -> Column:
        opening = F.transform(F.slice(cards, 1, OPENING), lambda y: y["store"])
        shown = lambda stores, store: F.size(F.filter(stores, lambda y: y == store))
        crowded = shown(opening, F.get(cards, i)["store"]) > OPENING_PER_STORE
        later = let(opening, lambda stores: F.filter(F.sequence(F.lit(OPENING), F.size(cards) - 1), lambda k: shown(stores, F.get(cards, k)["store"]) < OPENING_PER_STORE))
        return F.when(~crowded, cards).otherwise(let(F.get(later, F.lit(0)), lambda j: F.when(j.isNotNull(), _swapped(cards, i, j)).otherwise(cards)))

    places = F.array(*[F.lit(i) for _ in range(3) for i in range(HEROES, OPENING)])
    return F.when(F.size(deck) > OPENING, F.aggregate(places, deck, trade)).otherwise(deck)


def tier_shuffle(feed: DataFrame, group_cols: list[str], seed: str) -> DataFrame:
    """Heroes first, then the seeded mix of score tiers with spacing: a fold over the cards of a feed, which holds at most 500 a group
    (a rule of the feed; larger groups only take longer).

    The order inside a tier is the md5 of seed and id, the same on every run and partitioning.
    """
    s = F.col("deal_score")
    heroes = hero_slots(feed, group_cols).select("id", F.col("slot").alias("hero"))
    card = F.struct(
        F.when(s >= 75, 1).when(s >= 40, 2).otherwise(3).alias("tier"), F.md5(F.concat(F.lit(seed), F.col("id"))).alias("draw"), F.col("id"),
        F.coalesce(F.lower("brand"), F.lit("unknown")).alias("brand"), F.col("category"), F.coalesce("dispensary_id", F.lit("")).alias("store"),
        F.coalesce(chain_of(F.col("dispensary_id")), F.lit("")).alias("chain"))
    df = feed.join(heroes, "id", "left").withColumn("card", card)
    cards = df.groupBy(*group_cols).agg(
        F.transform(F.array_sort(F.collect_list(F.when(F.col("hero").isNotNull(), F.struct("hero", "card")))), lambda x: x["card"]).cast(f"array<{CARD}>").alias("heroes"),
        F.array_sort(F.collect_list(F.when(F.col("hero").isNull(), F.col("card")))).cast(f"array<{CARD}>").alias("rest"))
    start = F.struct(F.col("rest").alias("left"), F.array().cast(f"array<{CARD}>").alias("out")).cast(f"struct<left: array<{CARD}>, out: array<{CARD}>>")
    state = f"struct<left: array<{CARD}>, out: array<{CARD}>>"
    mixed = F.aggregate(F.sequence(F.lit(1), F.greatest(F.size("rest"), F.lit(1))), start, lambda d, i: F.when(F.size(d["left"]) == 0, d).otherwise(_draw(d, i).cast(state)))
    decks = cards.withColumn("mixed", F.concat("heroes", mixed["out"])).select(*group_cols, _spread_stores(F.col("mixed")).alias("deck"))
    return decks.select(*group_cols, F.posexplode("deck").alias("_at", "_card")).select(*group_cols, F.col("_card.id").alias("id"), (F.col("_at") + 1).cast("long").alias("position"))


FEED_QUOTAS = {"flower": 2, "vape": 2, "preroll": 1, "edible": 1, "concentrate": 1}
ROUND_ORDER = ["flower", "vape", "concentrate", "preroll", "edible"]
#: How far back a brand, store or category may not stand again, and what it is worth to repair that, at the place and for the card that gives way.
SPACING = {"brand": (3, 2.0, 1.0), "store": (2, 2.0, 1.0), "category": (2, 1.0, 0.5)}
SPACING_ROUNDS = 10


def _openers(feed: DataFrame, group_cols: list[str]) -> DataFrame:
    """Ids of the opening row: per category its quota, with brands new to the row, then new to the category, then any.

    A quota of n is met by the best offers of n + (all quotas) brands and by the n best offers, so few rows a group are folded.
    """
    total = sum(FEED_QUOTAS.values())
    turn = F.create_map(*[x for i, c in enumerate(FEED_QUOTAS) for x in (F.lit(c), F.lit(i))])
    order = ["deal_score desc", "id"]
    heads = top_per_group(top_per_group(feed, [*group_cols, "category", "brand_id"], order, 1), [*group_cols, "category"], order, total + 2)
    few = heads.unionByName(top_per_group(feed, [*group_cols, "category"], order, total)).dropDuplicates(["id"])
    item = F.struct(turn[F.col("category")].alias("turn"), (-F.col("deal_score")).alias("less"), "id", F.col("brand_id").alias("brand"))
    lists = few.groupBy(*group_cols).agg(F.array_sort(F.collect_list(item)).alias("c"))
    start = F.expr("cast(array() as array<struct<stale: int, less: int, id: string, turn: int, brand: string>>)")

    def pick(done: Column, turn_now: Column) -> Column:
        own = lambda y: y["turn"] == turn_now
        fresh = F.filter("c", lambda x: (x["turn"] == turn_now) & ~F.exists(done, lambda y: y["id"] == x["id"]))
        stale = lambda x: F.when(F.exists(done, lambda y: own(y) & (y["brand"] == x["brand"])), 2).when(F.exists(done, lambda y: y["brand"] == x["brand"]), 1).otherwise(0)
        best = F.array_min(F.transform(fresh, lambda x: F.struct(stale(x).alias("stale"), x["less"].cast("int").alias("less"), x["id"].alias("id"), x["turn"].alias("turn"), x["brand"].alias("brand"))))
        return F.when(best.isNull(), done).otherwise(F.concat(done, F.array(best)))

    turns = F.array(*[F.lit(i) for i, n in enumerate(FEED_QUOTAS.values()) for _ in range(n)])
    return lists.select(*group_cols, F.posexplode(F.aggregate(turns, start, pick)).alias("opening", "x")).select(*group_cols, F.col("x.id").alias("id"), "opening")


def _spaced(deck: Column) -> Column:
    """Cards that stand too near to one of the same brand, store or category change places with the later card that repairs most.

    A round walks the deck once; rounds end when one changes nothing.
    """
    def near(cards: Column, i: Column, x: Column, name: str) -> Column:
        span = SPACING[name][0]
        before = F.slice(cards, F.greatest(i - span, F.lit(0)) + 1, F.least(i, F.lit(span)))
        return F.exists(before, lambda y: y[name] == x[name])

    def step(state: Column, i: Column) -> Column:
        cards = state["cards"]
        view = lambda here: F.struct(here.alias("here"), *[near(cards, i, here, n).alias(n) for n in SPACING])

        def worth(v: Column, there: Column, j: Column) -> Column:
            mends = {n: ~v[n] | ~near(cards, i, there, n) for n in SPACING}
            points = sum((F.when(mends[n], SPACING[n][1]).otherwise(0.0) + F.when(near(cards, j, v["here"], n), 0.0).otherwise(SPACING[n][2]) for n in SPACING), F.lit(0.0))
            return F.when(mends["brand"] | mends["store"] | mends["category"], F.struct(points.alias("points"), (-j).alias("j")))

        def mend(v: Column) -> Column:
            options = F.transform(F.slice(cards, i + 2, F.size(cards)), lambda there, k: worth(v, there, i + 1 + k))
            best = F.when(v["brand"] | v["store"] | v["category"], -F.array_max(options)["j"])
            return let(best, lambda j: F.when(j.isNull(), state).otherwise(F.struct(_swapped(cards, i, j).alias("cards"), F.lit(True).alias("moved"))))

        return let(F.get(cards, i), lambda here: let(view(here), mend))

    def walk(state: Column, _: Column) -> Column:
        fresh = F.struct(state["cards"].alias("cards"), F.lit(False).alias("moved"))
        places = F.filter(F.sequence(F.lit(0), F.size(state["cards"]) - 1), lambda i: i > 0)
        return F.when(state["moved"], F.aggregate(places, fresh, step)).otherwise(state)

    return F.aggregate(F.sequence(F.lit(1), F.lit(SPACING_ROUNDS)), F.struct(deck.alias("cards"), F.lit(True).alias("moved")), walk)["cards"]


def spaced_feed(feed: DataFrame, group_cols: list[str]) -> DataFrame:
    """Opening quota 2/2/1/1/1 with different brands, then categories in turn, then spacing. At most 500 offers a group, as in `tier_shuffle`."""
    df = feed.filter(F.col("category").isin(ROUND_ORDER)).withColumn("brand_id", F.coalesce("brand", F.lit("Unknown")))
    df = df.join(_openers(df, group_cols).select("id", "opening"), "id", "left")
    rest = F.row_number().over(Window.partitionBy(*group_cols, "category", F.col("opening").isNull()).orderBy(F.desc("deal_score"), "id"))
    kind = F.create_map(*[x for i, c in enumerate(ROUND_ORDER) for x in (F.lit(c), F.lit(i))])[F.col("category")]
    place = F.when(F.col("opening").isNotNull(), F.struct(F.lit(0).alias("a"), F.col("opening").alias("b"), F.lit(0).alias("c"))).otherwise(
        F.struct(F.lit(1).alias("a"), rest.alias("b"), kind.alias("c")))
    item = F.struct(place.alias("place"), "id", F.col("brand_id").alias("brand"), F.coalesce("dispensary_id", F.lit("")).alias("store"), "category")
    decks = df.withColumn("item", item).groupBy(*group_cols).agg(F.array_sort(F.collect_list("item")).alias("deck"))
    spaced = decks.select(*group_cols, F.posexplode(_spaced(F.col("deck"))).alias("_at", "_x"))
    return spaced.select(*group_cols, F.col("_x.id").alias("id"), (F.col("_at") + 1).cast("long").alias("position"))


def featured_by_discount(deals: DataFrame, group_cols: list[str], n: int = 5) -> DataFrame:
    """Highest discounts: new store and category first, then new stores, then the rest.

    With n picks at most n stores and n categories are used up, so per group the best of the n + 1 best stores of each
    category, of the 2n best stores, and the 2n best offers decide (all bounded).
    """
    rate = (F.col("original_price") - F.col("sale_price")) / F.col("original_price")
    df = deals.filter(F.col("original_price") > F.col("sale_price")).withColumn("_d", rate)
    order = ["_d desc", "id"]
    by_cat = top_per_group(top_per_group(df, [*group_cols, "category", "dispensary_id"], order, 1), [*group_cols, "category"], order, n + 1)
    by_store = top_per_group(top_per_group(df, [*group_cols, "dispensary_id"], order, 1), group_cols, order, 2 * n)
    overall = top_per_group(df, group_cols, order, 2 * n)
    cols = [*group_cols, *[c for c in ("id", "category", "dispensary_id", "_d") if c not in group_cols]]
    pool = by_cat.select(*cols).unionByName(by_store.select(*cols)).unionByName(overall.select(*cols)).distinct()
    few = pool.groupBy(*group_cols).agg(F.collect_list(F.struct("id", "category", "dispensary_id", "_d")).alias("c"))
    start = F.expr("cast(array() as array<struct<stale: int, rate: double, id: string, category: string, dispensary_id: string>>)")

    def pick(done: Column, _: Column) -> Column:
        """What is new in both ways goes first, then a new store, then the rate."""
        fresh = F.filter("c", lambda x: ~F.exists(done, lambda y: y["id"] == x["id"]))
        placed = F.transform(fresh, lambda x: F.struct(
            F.when(F.exists(done, lambda y: y["dispensary_id"] == x["dispensary_id"]), 2).when(F.exists(done, lambda y: (y["stale"] == 0) & (y["category"] == x["category"])), 1).otherwise(0).alias("stale"),
            (-x["_d"]).cast("double").alias("rate"), x["id"].alias("id"), x["category"].alias("category"), x["dispensary_id"].alias("dispensary_id")))
        best = F.array_min(placed)
        return F.when(best.isNull(), done).otherwise(F.concat(done, F.array(best)))

    picked = few.select(*group_cols, F.aggregate(F.sequence(F.lit(1), F.lit(n)), start, pick).alias("p"))
    return picked.select(*group_cols, F.posexplode("p").alias("position", "x")).select(*group_cols, F.col("x.id").alias("id"), (F.col("position") + 1).cast("long").alias("position"))


def post_target() -> Column:
    """Niches worth posting: gram disposables, eighths and quarters, 100 mg edibles, premium gram concentrates, small preroll packs."""
    name, sub = F.lower(F.coalesce("name", F.lit(""))), F.lower(F.coalesce("product_subtype", F.lit("")))
    cat, unit, w = F.col("category"), F.lower(F.coalesce("weight_unit", F.lit(""))), F.coalesce("weight_value", F.lit(0.0))
    says = lambda *words: F.expr("false") if not words else _any(name, words)
    gram = ((unit == "g") & w.between(0.9, 1.1)) | says("1g", "1 g")
    disposable = sub.contains("disposable") | says("disposable", "dispo", "all-in-one", "aio")
    sized = F.when(unit.isin("g", "oz"), w.between(3.4, 3.6) | w.between(6.9, 7.1) | says("3.5g", "3.5 g", "eighth", "1/8", "7g", "7 g", "quarter", "1/4")
                   ).otherwise(says("3.5g", "3.5 g", "7g", "7 g", "eighth", "quarter"))
    live = sub.contains("live") | sub.contains("rosin") | sub.contains("badder") | says("live resin", "live rosin", "badder")
    pack = F.coalesce(F.regexp_extract("name", r"(?i)([0-9]+)\s*(?:pk|pack|ct|count)", 1).try_cast("int"), F.lit(1))
    return (F.when(cat == "vape", disposable & gram).when(cat == "flower", sized)
            .when(cat == "edible", ((unit == "mg") & (w >= 100)) | says("100mg", "200mg", "250mg", "300mg", "500mg"))
            .when(cat == "concentrate", live & gram).when(cat == "preroll", pack <= 2).otherwise(F.lit(False)))


def _any(text: Column, words) -> Column:
    out = F.contains(text, F.lit(words[0]))
    for w in words[1:]:
        out = out | F.contains(text, F.lit(w))
    return out


POST_BUCKETS = ["vape", "flower", "edible", "concentrate", "preroll"]


def post_queue(deals: DataFrame, posted_today: DataFrame, region: str, max_per_day: int = 8, min_score: int = 50, max_price: float = 35,
               limit: int = 200) -> DataFrame:
    """Offers to post: categories in turn, no brand twice, also not one posted today; offers with ``is_posted`` never come again.

    Only the ``limit`` best unposted offers are considered (a rule of the queue), so the array that the fold runs over is
    as short. A turn takes the best offer with an unused brand of the first category, from the one whose turn it is, that
    has one; the next turn starts one category further on.
    """
    open_deals = deals.filter(~F.coalesce("is_posted", F.lit(False)))
    best = top_n(open_deals.filter(F.col("deal_score") >= min_score), SCORE_ORDER, limit)
    price = F.coalesce("sale_price", "original_price")
    usable = best.filter((F.col("region") == region) & (price <= max_price) & (price > 0) & post_target())
    brand = F.lower(F.trim(F.coalesce("brand", F.lit("unknown"))))
    few = usable.agg(F.collect_list(F.struct("id", "category", F.col("deal_score").cast("long").alias("score"), brand.alias("brand"))).alias("c"))
    today = posted_today.agg(F.count("*").alias("n_today"), F.collect_set(F.lower(F.trim("brand"))).alias("used"))
    row = few.withColumn("_k", F.lit(1)).join(F.broadcast(today.withColumn("_k", F.lit(1))), "_k")  # one row each
    turns = F.filter(F.array(*[F.lit(b) for b in POST_BUCKETS]), lambda b: F.exists("c", lambda x: x["category"] == b))
    row = row.withColumn("turns", turns)
    start = F.expr("cast(array() as array<struct<wait: int, worse: bigint, id: string, brand: string>>)")

    def post(done: Column, i: Column) -> Column:
        fresh = F.filter("c", lambda x: F.array_contains("turns", x["category"]) & ~F.array_contains("used", x["brand"]) & ~F.exists(done, lambda y: y["brand"] == x["brand"]))
        placed = F.transform(fresh, lambda x: F.struct(
            F.pmod(F.array_position("turns", x["category"]).cast("int") - 1 - i, F.size("turns")).alias("wait"), (-x["score"]).alias("worse"), x["id"].alias("id"), x["brand"].alias("brand")))
        first = F.array_min(placed)
        return F.when(first.isNull() | (i >= F.lit(max_per_day) - F.col("n_today")), done).otherwise(F.concat(done, F.array(first)))

    posts = row.select(F.aggregate(F.sequence(F.lit(0), F.lit(max_per_day - 1)), start, post).alias("p"))
    return posts.select(F.posexplode("p").alias("position", "x")).select("x.id", (F.col("position") + 1).cast("long").alias("position"))
