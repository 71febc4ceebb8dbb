"""Visitor metrics: growth, retention, cohorts, funnel, virality, acquisition and campaigns.

Distinct-user counts are never computed as many ``count(distinct ...)`` in one aggregate (Spark would expand every
row once per distinct). Events are reduced to one row per user first; partial aggregation on the map side keeps a
user or store with a third of all events down to one row per task. Sets of active days are bounded by the calendar.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmart import lookups as L
from leafmart.functions.numbers import count_if, flag, js_pct, js_round, ratio, round_dec


def instant(as_of: str) -> Column:
    return F.lit(as_of).cast("timestamp_ntz")


def ago(as_of: str, days: int) -> Column:
    moment = dt.datetime.fromisoformat(as_of) - dt.timedelta(days=days)
    return F.lit(moment.isoformat(sep=" ")).cast("timestamp_ntz")


def today(as_of: str) -> Column:
    return F.lit(as_of[:10]).cast("date")


def day() -> Column:
    return F.to_date("created_at")


def since(events: DataFrame, as_of: str, days: int) -> DataFrame:
    return events.filter(F.col("created_at") >= ago(as_of, days))


def is_event(*names: list[str]) -> Column:
    return F.col("event_name").isin([n for group in names for n in group])


def monday(date_col: Column) -> Column:
    return F.to_date(F.date_trunc("week", date_col))


def _user_flags(events: DataFrame, **conditions: Column) -> DataFrame:
    """One row per known user with a 0/1 column per condition."""
    known = events.filter(F.col("anon_id").isNotNull())
    return known.groupBy("anon_id").agg(*[F.max(flag(c)).alias(n) for n, c in conditions.items()])


def kpi_summary(events: DataFrame, as_of: str) -> DataFrame:
    """Headline counts; day counts start at midnight, week and month windows roll from the instant."""
    ts, start = F.col("created_at"), today(as_of).cast("timestamp_ntz")
    per_user = events.groupBy("anon_id").agg(
        F.max(flag(ts >= start)).alias("dau"),
        F.max(flag((ts >= ago(as_of[:10] + " 00:00:00", 1)) & (ts < start))).alias("dau_yesterday"),
        F.max(flag(ts >= ago(as_of, 7))).alias("wau"),
        F.max(flag((ts >= ago(as_of, 14)) & (ts < ago(as_of, 7)))).alias("wau_prev"),
        F.max(flag(ts >= ago(as_of, 30))).alias("mau"),
        F.max(flag((ts >= ago(as_of, 60)) & (ts < ago(as_of, 30)))).alias("mau_prev"),
        F.sum(flag((ts >= start) & is_event(L.SAVE_EVENTS))).alias("_saves"),
        F.sum(flag((ts >= start) & is_event(L.CLICK_EVENTS))).alias("_clicks"))
    known = F.col("anon_id").isNotNull()
    users = ["dau", "dau_yesterday", "wau", "wau_prev", "mau", "mau_prev"]
    return per_user.agg(
        *[F.coalesce(F.sum(F.when(known, F.col(u))), F.lit(0)).alias(u) for u in users],
        count_if(known).alias("total_unique_users"),
        F.coalesce(F.sum("_saves"), F.lit(0)).alias("today_saves"),
        F.coalesce(F.sum("_clicks"), F.lit(0)).alias("today_clicks"))


def growth(events: DataFrame, as_of: str, window_days: int = 30, all_time_users: bool = False) -> DataFrame:
    """Daily and monthly users, stickiness and save rate; user total inside the window unless asked otherwise."""
    ts = F.col("created_at")
    inside = ts >= ago(as_of, window_days)
    users = _user_flags(events if all_time_users else since(events, as_of, window_days),
                        dau=inside & (day() == today(as_of)), mau=inside & (ts >= ago(as_of, 30)), seen=inside,
                        saver=inside & is_event(L.SAVE_EVENTS))
    total = F.count("*") if all_time_users else F.sum("seen")
    sums = users.agg(F.sum("dau").alias("dau"), F.sum("mau").alias("mau"), total.alias("total_users"),
                     F.sum("saver").alias("_savers"), F.sum("seen").alias("_seen"))
    sums = sums.na.fill(0)
    return sums.select("dau", "mau", "total_users", ratio(F.col("dau"), F.col("mau"), 1, 100).alias("dau_mau_ratio"),
                       ratio(F.col("_savers"), F.col("_seen"), 1, 100).alias("save_rate"))


def daily_visitors(events: DataFrame, as_of: str, window_days: int = 30) -> DataFrame:
    inside = since(events, as_of, window_days).filter(F.col("anon_id").isNotNull())
    per_user_day = inside.groupBy(day().alias("day"), "anon_id").agg(F.count("*").alias("_n"))
    return per_user_day.groupBy("day").agg(F.count("*").alias("visitors"), F.sum("_n").alias("events"))


def _returned_within(first: Column, days: Column, n: int) -> Column:
    return F.exists(days, lambda d: (d > first) & (d <= F.date_add(first, n)))


def retention_rate(events: DataFrame, as_of: str, n: int, empty_as_zero: bool = False) -> DataFrame:
    """Share of users first seen in [now - 2n, now - n) with a later day of activity up to n days on."""
    ts = F.col("created_at")
    window = (ts >= ago(as_of, 2 * n)) & (ts < ago(as_of, n))
    users = events.filter(F.col("anon_id").isNotNull() & (ts >= ago(as_of, 2 * n + 1))).groupBy("anon_id").agg(
        F.min(F.when(window, day())).alias("first"), F.collect_set(day()).alias("days")).filter("first IS NOT NULL")
    rate = users.agg(F.count("*").alias("cohort_size"),
                     count_if(_returned_within(F.col("first"), F.col("days"), n)).alias("returned"))
    share = ratio(F.col("returned"), F.col("cohort_size"), 1, 100)
    return rate.select("cohort_size", "returned", (F.coalesce(share, F.lit(0.0)) if empty_as_zero else share).alias("rate"))


def engagement(events: DataFrame, as_of: str, window_days: int = 30) -> DataFrame:
    """Activation, return and bounce shares, events per user-day and saves per saver."""
    inside = F.col("created_at") >= ago(as_of, window_days)
    save = is_event(L.SAVE_EVENTS)
    near = events.filter(F.col("anon_id").isNotNull() & (F.col("created_at") >= ago(as_of, window_days + 1)))
    users = near.groupBy("anon_id").agg(
        F.sum(flag(inside)).alias("n_events"), F.collect_set(F.when(inside, day())).alias("days"),
        F.sum(flag(inside & save)).alias("n_saves"), F.min(F.when(inside, day())).alias("first"),
        F.collect_set(F.when(save, day())).alias("save_days")).filter("n_events > 0")
    sums = users.agg(
        F.count("*").alias("u"), count_if(F.array_contains("save_days", F.col("first"))).alias("activated"),
        count_if(F.size("days") > 1).alias("multi_day"), count_if(F.col("n_events") == 1).alias("bounced"),
        F.sum("n_events").alias("e"), F.sum(F.size("days")).alias("d"), F.sum("n_saves").alias("s"),
        count_if(F.col("n_saves") > 0).alias("savers"))
    u = F.col("u")
    zero = F.lit(0.0)
    return sums.select(
        ratio(F.col("activated"), u, 1, 100).alias("activation_rate"), ratio(F.col("multi_day"), u, 1, 100).alias("return_rate"),
        ratio(F.col("bounced"), u, 1, 100).alias("bounce_rate"),
        F.coalesce(ratio(F.col("e"), F.col("d"), 1), zero).alias("events_per_user_day"),
        F.coalesce(ratio(F.col("s"), F.col("savers"), 1), zero).alias("saves_per_saver"))


def _user_days(events: DataFrame, as_of: str, lookback: int) -> DataFrame:
    return since(events, as_of, lookback).filter(F.col("anon_id").isNotNull()).groupBy("anon_id").agg(
        F.min(day()).alias("first"), F.collect_set(day()).alias("days"))


def weekly_cohorts(events: DataFrame, as_of: str) -> DataFrame:
    """Monday cohorts of the last 56 days with the share active in week 1 to 4, NULL until that week is over."""
    users = _user_days(events, as_of, 56).withColumn("cohort_week", monday(F.col("first")))
    week = lambda k: F.exists("days", lambda d: (d >= F.date_add("cohort_week", 7 * k)) & (d < F.date_add("cohort_week", 7 * k + 7)))
    sums = users.groupBy("cohort_week").agg(
        F.count("*").alias("cohort_size"), *[count_if(week(k)).alias(f"_w{k}") for k in range(1, 5)])
    return sums.select("cohort_week", "cohort_size", F.lit(100).cast("long").alias("week0"), *[
        F.when(today(as_of) >= F.date_add("cohort_week", 7 * k + 7), ratio(F.col(f"_w{k}"), F.col("cohort_size"), 1, 100)).alias(f"week{k}")
        for k in range(1, 5)])


_DAY_MARKS = [1, 3, 7, 14, 30]


def day_n_cohorts(events: DataFrame, as_of: str, lookback: int = 90) -> DataFrame:
    """Monday cohorts; day 1 exactly, then within 3, 7, 14 and 30 days after each user's first day."""
    users = _user_days(events, as_of, lookback).withColumn("cohort_week", monday(F.col("first")))
    def reached(n: int) -> Column:
        if n == 1:
            return F.array_contains("days", F.date_add("first", 1))
        return _returned_within(F.col("first"), F.col("days"), n)

    hit = {n: reached(n) for n in _DAY_MARKS}
    sums = users.groupBy("cohort_week").agg(F.count("*").alias("cohort_size"), *[count_if(hit[n]).alias(f"_d{n}") for n in _DAY_MARKS])
    return sums.select("cohort_week", "cohort_size",
                       *[ratio(F.col(f"_d{n}"), F.col("cohort_size"), 1, 100).alias(f"day{n}") for n in _DAY_MARKS])


def day_n_cohorts_from_monday(events: DataFrame, as_of: str, lookback: int = 90, keep: int = 12) -> DataFrame:
    """Browser variant: offsets count from the cohort Monday, whole percents, newest 12 cohorts."""
    users = _user_days(events, as_of, lookback).withColumn("cohort_week", monday(F.col("first")))
    hit = {n: _returned_within(F.col("cohort_week"), F.col("days"), n) for n in _DAY_MARKS}
    sums = users.groupBy("cohort_week").agg(F.count("*").alias("cohort_size"), *[count_if(hit[n]).alias(f"_d{n}") for n in _DAY_MARKS])
    newest = sums.orderBy(F.col("cohort_week").desc()).limit(keep)
    return newest.select("cohort_week", "cohort_size",
                         *[js_pct(F.col(f"_d{n}"), F.col("cohort_size")).alias(f"day{n}") for n in _DAY_MARKS])


# ---------------------------------------------------------------------------
# Dashboard of a date range
# ---------------------------------------------------------------------------

def funnel(events: DataFrame) -> DataFrame:
    """Visited, engaged, activated (saved or clicked) and power users (3 or more days)."""
    users = events.groupBy("anon_id").agg(
        F.max(flag(is_event(L.ENGAGED_EVENTS))).alias("engaged"), F.max(flag(is_event(L.ACTIVATED_EVENTS))).alias("activated"),
        F.size(F.collect_set(day())).alias("n_days"))
    return users.agg(F.count("*").alias("visited"), F.sum("engaged").alias("engaged"), F.sum("activated").alias("activated"),
                     count_if(F.col("n_days") >= 3).alias("power_user"))


def event_breakdown(events: DataFrame) -> DataFrame:
    return events.groupBy("event_name").agg(F.count("*").alias("n"))


def hourly_activity(events: DataFrame) -> DataFrame:
    """24 rows, also for hours without events."""
    hours = events.sparkSession.range(24).select(F.col("id").alias("hour"))
    counted = events.groupBy(F.hour("created_at").cast("long").alias("hour")).agg(F.count("*").alias("n"))
    return hours.join(counted, "hour", "left").select("hour", F.coalesce("n", F.lit(0)).alias("n"))


def device_breakdown(events: DataFrame) -> DataFrame:
    pairs = events.filter(F.coalesce("device_type", F.lit("")) != "").select("anon_id", "device_type").distinct()
    return pairs.groupBy("device_type").agg(F.count("*").alias("n"))


def url_host(url: Column) -> Column:
    return F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit("direct"))


def referrers(events: DataFrame, n: int = 10) -> DataFrame:
    """Referring hosts of app loads; broken addresses count as direct, and without any data all visitors are direct."""
    loads = events.filter((F.col("event_name") == "app_loaded") & (F.coalesce("referrer_url", F.lit("")) != ""))
    hosts = loads.groupBy(url_host(F.col("referrer_url")).alias("source")).agg(F.count("*").alias("n"))
    totals = events.groupBy("anon_id").agg(
        F.max(flag((F.col("event_name") == "app_loaded") & (F.coalesce("referrer_url", F.lit("")) != ""))).alias("_has"))
    fallback = totals.agg(F.max("_has").alias("_any"), F.count("*").alias("n")).filter("_any = 0").select(
        F.lit("direct").alias("source"), "n")
    return hosts.unionByName(fallback).orderBy(F.col("n").desc(), "source").limit(n)


def referrer_class(url: Column) -> Column:
    """Channel of a referrer: known networks by host, other hosts as they are, 'direct' without one."""
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    return (F.when(host.isNull(), "direct")
            .when(host.isin("t.co", "x.com", "twitter.com") | host.endswith(".x.com") | host.endswith(".twitter.com"), "twitter")
            .when(host.endswith("facebook.com") | host.endswith("fb.com") | host.endswith("instagram.com"), "facebook")
            .when(host.endswith("google.com") | host.endswith("google.co"), "google")
            .when(host.endswith("reddit.com"), "reddit").otherwise(host))


def viral(events: DataFrame) -> DataFrame:
    """Shares, their views, referral clicks and conversions, and the viral coefficient."""
    users = events.groupBy("anon_id").agg(
        F.max(flag(is_event(L.ACTIVATED_EVENTS))).alias("activated"), F.sum(flag(is_event(L.SHARE_EVENTS))).alias("shares"),
        F.sum(flag(F.col("event_name") == "shared_page_view")).alias("views"),
        F.sum(flag(F.col("event_name") == "referral_click")).alias("clicks"),
        F.sum(flag(F.col("event_name") == "referral_conversion")).alias("conversions"))
    t = users.agg(F.count("*").alias("visitors"), *[F.sum(c).alias(c) for c in ("activated", "shares", "views", "clicks", "conversions")])
    active = F.when(F.col("activated") > 0, F.col("activated")).when(F.col("visitors") > 0, F.col("visitors")).otherwise(1)
    impressions = F.greatest("clicks", "views", F.lit(1))
    coefficient = (F.col("shares") / active.cast("double")) * (F.col("conversions") / impressions.cast("double"))
    return t.select("shares", "views", "clicks", "conversions", round_dec(coefficient, 3).alias("viral_coefficient"),
                    js_pct(F.col("views"), F.col("shares")).alias("share_view_rate"),
                    js_pct(F.col("conversions"), F.col("clicks")).alias("click_conversion_rate"))


def top_referrers(events: DataFrame, n: int = 10) -> DataFrame:
    hits = events.filter(F.col("event_name").isin("referral_click", "referral_conversion") & F.col("referrer_id").isNotNull())
    sums = hits.groupBy("referrer_id").agg(
        F.sum(flag(F.col("event_name") == "referral_conversion")).alias("conversions"),
        F.sum(flag(F.col("event_name") == "referral_click")).alias("clicks"))
    return sums.orderBy(F.col("conversions").desc(), F.col("clicks").desc(), "referrer_id").limit(n)


def _change(now: Column, before: Column) -> Column:
    share = js_round((now - before).cast("double") / F.when(before > 0, before).cast("double") * 100)
    return F.coalesce(share, F.when(now > 0, F.lit(100)).otherwise(F.lit(0)).cast("long"))


def _weeks(as_of: str) -> tuple[Column, Column]:
    ts = F.col("created_at")
    return ts >= ago(as_of, 7), (ts >= ago(as_of, 14)) & (ts < ago(as_of, 7))


def week_over_week(events: DataFrame, as_of: str) -> DataFrame:
    this, last = _weeks(as_of)
    kinds = {"saves": is_event(L.SAVE_EVENTS), "clicks": is_event(L.CLICK_EVENTS), "shares": is_event(L.SHARE_EVENTS)}
    per_user = since(events, as_of, 14).groupBy("anon_id").agg(
        F.max(flag(this)).alias("visitors_this"), F.max(flag(last)).alias("visitors_last"),
        *[F.sum(flag(w & c)).alias(f"{k}_{n}") for k, c in kinds.items() for n, w in (("this", this), ("last", last))])
    names = ["visitors", *kinds]
    sums = per_user.agg(*[F.coalesce(F.sum(f"{k}_{w}"), F.lit(0)).alias(f"{k}_{w}") for k in names for w in ("this", "last")])
    return sums.select(*[f"{k}_{w}" for k in names for w in ("this", "last")],
                       *[_change(F.col(f"{k}_this"), F.col(f"{k}_last")).alias(f"{k}_change") for k in names])


def stickiness(events: DataFrame, as_of: str, lookback: int = 90) -> DataFrame:
    """Mean daily users of the last 7 days over all users of the fetched window."""
    recent = F.col("created_at") >= ago(as_of, 7)
    users = since(events, as_of, lookback).groupBy("anon_id").agg(F.collect_set(F.when(recent, day())).alias("days"))
    spread = users.select(F.explode_outer("days").alias("d")).groupBy("d").agg(F.count("*").alias("n"))
    wau_mau = users.agg(count_if(F.size("days") > 0).alias("wau"), F.count("*").alias("mau"))
    daily = spread.filter("d IS NOT NULL").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("_sum"), F.count("*").alias("n_days"))
    both = wau_mau.withColumn("_k", F.lit(1)).join(daily.withColumn("_k", F.lit(1)), "_k")
    mean = F.col("_sum").cast("double") / F.greatest("n_days", F.lit(1)).cast("double")
    return both.select("wau", "mau", "n_days", js_round(mean / F.greatest("mau", F.lit(1)) * 100).alias("stickiness"))


def churn(events: DataFrame, as_of: str) -> DataFrame:
    """Churn: last week's users missing this week. Return rate: users from before who came in the last 7 days."""
    this, last = _weeks(as_of)
    users = since(events, as_of, 90).groupBy("anon_id").agg(
        F.max(flag(this)).alias("this"), F.max(flag(last)).alias("last"),
        F.max(flag(F.col("created_at") < ago(as_of, 7))).alias("old"))
    s = users.agg(F.sum("last").alias("last_week"), count_if((F.col("last") == 1) & (F.col("this") == 0)).alias("churned"),
                  F.sum("old").alias("old_users"), count_if((F.col("old") == 1) & (F.col("this") == 1)).alias("returned")).na.fill(0)
    return s.select("last_week", "churned", js_pct(F.col("churned"), F.col("last_week")).alias("churn_rate"),
                    "old_users", "returned", js_pct(F.col("returned"), F.col("old_users")).alias("return_rate"))


def growth_velocity(events: DataFrame, as_of: str) -> DataFrame:
    """Compound weekly growth of users over the last four weeks."""
    seconds = F.unix_seconds(instant(as_of).cast("timestamp")) - F.unix_seconds(F.col("created_at").cast("timestamp"))
    micros = (F.unix_micros(instant(as_of).cast("timestamp")) - F.unix_micros(F.col("created_at").cast("timestamp")))
    week = F.floor(micros / F.lit(7 * 86400 * 1_000_000)).cast("long")
    users = events.filter(seconds > -86400 * 2).groupBy("anon_id").agg(*[F.max(flag(week == k)).alias(f"w{k}") for k in range(4)])
    s = users.agg(*[F.coalesce(F.sum(f"w{k}"), F.lit(0)).alias(f"w{k}") for k in range(4)])
    busy = sum((flag(F.col(f"w{k}") > 0) for k in range(4)), F.lit(0))
    oldest = F.when(F.col("w3") > 0, F.col("w3")).otherwise(F.col("w2")).cast("double")
    newest = F.col("w0").cast("double")
    rate = js_round((F.pow(newest / F.when(oldest > 0, oldest), 1.0 / F.when(busy > 1, busy - 1).cast("double")) - 1) * 100)
    usable = (busy >= 2) & (oldest > 0) & (newest > 0)
    return s.select("w0", "w1", "w2", "w3", F.when(usable, rate).otherwise(F.lit(0).cast("long")).alias("growth_velocity"))


def activation_to_retention(events: DataFrame, as_of: str, range_days: int = 30, lookback: int = 90) -> DataFrame:
    """Share of the range's activated users with at least two active days."""
    users = since(events, as_of, lookback).groupBy("anon_id").agg(
        F.max(flag(is_event(L.ACTIVATED_EVENTS) & (F.col("created_at") >= ago(as_of, range_days)))).alias("activated"),
        F.size(F.collect_set(day())).alias("n_days")).filter("activated = 1")
    s = users.agg(F.count("*").alias("activated"), count_if(F.col("n_days") >= 2).alias("kept"))
    return s.select("activated", "kept", js_pct(F.col("kept"), F.col("activated")).alias("rate"))


def store_referral_clicks(events: DataFrame, n: int = 15) -> DataFrame:
    clicks = events.filter(is_event(L.CLICK_EVENTS)).groupBy(F.coalesce("store", F.lit("Unknown")).alias("store")).agg(
        F.count("*").alias("clicks"))
    return clicks.orderBy(F.col("clicks").desc(), "store").limit(n)


def first_touch(events: DataFrame) -> DataFrame:
    """Earliest tagged app load per user."""
    tagged = events.filter((F.col("event_name") == "app_loaded") & (F.coalesce("utm_source", F.lit("")) != ""))
    at = F.struct("created_at", "id")
    return tagged.groupBy("anon_id").agg(F.min_by("utm_source", at).alias("source"), F.min(at).alias("touched"))


def persistent_source(utm_source: Column, referrer_url: Column) -> Column:
    """Stored acquisition source: tag, else referrer channel, else direct."""
    return F.coalesce(F.when(utm_source != "", utm_source), referrer_class(referrer_url))


def acquisition_channels(events: DataFrame) -> DataFrame:
    """Visitors, saves and clicks per first-touch source; what a user did before the first tagged load is organic.

    The touch table has one row per user; adaptive execution splits a user with very many events.
    """
    joined = events.join(first_touch(events), "anon_id", "left")
    tagged = F.col("touched").isNotNull() & (F.struct("created_at", "id") >= F.col("touched"))
    source = F.when(tagged, F.col("source")).otherwise("organic")
    per_user = joined.groupBy(source.alias("source"), "anon_id").agg(
        F.sum(flag(is_event(L.SAVE_EVENTS))).alias("saves"), F.sum(flag(is_event(L.CLICK_EVENTS))).alias("clicks"))
    return per_user.groupBy("source").agg(F.count("*").alias("visitors"), F.sum("saves").alias("saves"), F.sum("clicks").alias("clicks"))


def campaign_users(events: DataFrame, as_of: str, source: str = "flyer") -> DataFrame:
    """Users with ``is_new`` (first day on or after the first tagged load of the campaign, today without one).

    The campaign start travels as a column of a one-row aggregate joined on a constant key, not through the driver.
    """
    users = events.groupBy("anon_id").agg(F.min(day()).alias("first_day"))
    start = events.filter((F.col("event_name") == "app_loaded") & (F.col("utm_source") == source)).agg(
        F.least(F.min(day()), today(as_of)).alias("start_day"))
    keyed = users.withColumn("_k", F.lit(1)).join(F.broadcast(start.withColumn("_k", F.lit(1))), "_k")
    return keyed.select("anon_id", "first_day", "start_day", (F.col("first_day") >= F.col("start_day")).alias("is_new"))


def campaign_segment(events: DataFrame, as_of: str, source: str = "flyer") -> DataFrame:
    """New versus earlier users with all rates of the campaign report, one row per segment."""
    kinds = {"saves": is_event(L.SAVE_EVENTS), "clicks": is_event(L.CLICK_EVENTS), "shares": is_event(L.SHARE_EVENTS)}
    per_user = events.groupBy("anon_id").agg(
        F.count("*").alias("n"), F.min(day()).alias("first_day"), F.size(F.collect_set(day())).alias("n_days"),
        F.max(flag(is_event(L.ENGAGED_EVENTS))).alias("engaged"), F.max(flag(is_event(L.ACTIVATED_EVENTS))).alias("activated"),
        *[F.sum(flag(c)).alias(k) for k, c in kinds.items()])
    users = per_user.join(campaign_users(events, as_of, source).select("anon_id", "is_new"), "anon_id")
    s = users.groupBy(F.when(F.col("is_new"), "new").otherwise("earlier").alias("segment")).agg(
        F.count("*").alias("visitors"), F.sum("n").alias("events"), *[F.sum(k).alias(k) for k in kinds],
        F.sum("engaged").alias("engaged"), F.sum("activated").alias("activated"), count_if(F.col("n_days") >= 3).alias("power_users"),
        count_if(F.col("n") <= 1).alias("bounced"))
    return s.select("*", round_dec(F.col("events") / F.col("visitors").cast("double"), 1).alias("events_per_user"),
                    js_pct(F.col("activated"), F.col("visitors")).alias("activation_rate"),
                    js_pct(F.col("bounced"), F.col("visitors")).alias("bounce_rate"))


def campaign_attribution(events: DataFrame, as_of: str, source: str = "flyer") -> DataFrame:
    """New users per first-touch source with their saves and clicks (source taken from the whole range)."""
    new = campaign_users(events, as_of, source).filter("is_new").select("anon_id")
    sums = events.groupBy("anon_id").agg(F.sum(flag(is_event(L.SAVE_EVENTS))).alias("saves"),
                                         F.sum(flag(is_event(L.CLICK_EVENTS))).alias("clicks"))
    users = sums.join(new, "anon_id").join(first_touch(events).select("anon_id", "source"), "anon_id", "left")
    return users.groupBy(F.coalesce("source", F.lit("organic")).alias("source")).agg(
        F.count("*").alias("visitors"), F.sum("saves").alias("saves"), F.sum("clicks").alias("clicks"))


def campaign_top_stores(events: DataFrame, as_of: str, n: int = 10, source: str = "flyer") -> DataFrame:
    new = campaign_users(events, as_of, source).filter("is_new").select("anon_id")
    clicks = events.filter(is_event(L.CLICK_EVENTS) & F.col("store").isNotNull()).groupBy("anon_id", "store").agg(F.count("*").alias("c"))
    return clicks.join(new, "anon_id").groupBy("store").agg(F.sum("c").alias("clicks")).orderBy(
        F.col("clicks").desc(), "store").limit(n)


def campaign_top_deals(events: DataFrame, as_of: str, n: int = 10, source: str = "flyer") -> DataFrame:
    new = campaign_users(events, as_of, source).filter("is_new").select("anon_id")
    saves = events.filter(is_event(L.SAVE_EVENTS)).groupBy("anon_id", F.col("k").alias("deal_id")).agg(F.count("*").alias("c"))
    return saves.join(new, "anon_id").groupBy("deal_id").agg(F.sum("c").alias("saves")).orderBy(
        F.col("saves").desc(), "deal_id").limit(n)


def daily_insert_cap(rows: DataFrame, user: str, cap: int, ts: str = "created_at", key: str = "id") -> DataFrame:
    """Rows accepted by the daily limit: first ``cap`` per user and UTC day, users without a name are refused."""
    known = rows.filter(F.coalesce(F.col(user).cast("string"), F.lit("")) != "").withColumn("_day", F.to_date(ts))
    order = Window.partitionBy(user, "_day").orderBy(ts, key)
    return known.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= cap).drop("_rn", "_day")


def daily_insert_rejects(rows: DataFrame, user: str, cap: int, ts: str = "created_at") -> DataFrame:
    """Refused rows per user and day; needs counts only, so nothing is sorted."""
    named = F.coalesce(F.col(user).cast("string"), F.lit("")) != ""
    sums = rows.groupBy(F.col(user).alias("user"), F.to_date(ts).alias("day")).agg(
        F.count("*").alias("n"), F.max(flag(named)).alias("_named"))
    over = F.when(F.col("_named") == 1, F.col("n") - cap).otherwise(F.col("n"))
    return sums.withColumn("n_rejected", over).filter("n_rejected > 0").select("user", "day", "n", "n_rejected")
