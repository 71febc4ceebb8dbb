"""Visitor metrics over the event view."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafmart import lookups as L
from leafmart.operators import engagement as e
from leafmart.registry import oracle as o
from leafmart.registry.common import EVENTS_AS_OF as NOW
from leafmart.registry.common import day_text, events, view

QUERIES, ORACLES = {}, {}
TS = f"TIMESTAMP '{NOW}'"
TODAY = f"DATE '{NOW[:10]}'"
SAVE, CLICK, SHARE = (o.values_in(x) for x in (L.SAVE_EVENTS, L.CLICK_EVENTS, L.SHARE_EVENTS))
ENGAGED, ACTIVATED = o.values_in(L.ENGAGED_EVENTS), o.values_in(L.ACTIVATED_EVENTS)
EV = "v_analytics_events"


def register(name, fn, sql=None):
    QUERIES[name] = fn
    if sql is not None:
        ORACLES[name] = o.sql(sql)


def ago(days: int) -> str:
    return f"({TS} - INTERVAL '{days}' DAY)"


def users(cond: str) -> str:
    return f"COUNT(DISTINCT anon_id) FILTER (WHERE {cond})"


register("kpi_summary", lambda s, d: e.kpi_summary(events(s, d), NOW), f"""
SELECT {users(f"created_at >= {TODAY}")} AS dau, {users(f"created_at >= {TODAY} - INTERVAL '1' DAY AND created_at < {TODAY}")} AS dau_yesterday,
  {users(f"created_at >= {ago(7)}")} AS wau, {users(f"created_at >= {ago(14)} AND created_at < {ago(7)}")} AS wau_prev,
  {users(f"created_at >= {ago(30)}")} AS mau, {users(f"created_at >= {ago(60)} AND created_at < {ago(30)}")} AS mau_prev,
  COUNT(DISTINCT anon_id) AS total_unique_users, COUNT(*) FILTER (WHERE created_at >= {TODAY} AND event_name IN {SAVE}) AS today_saves,
  COUNT(*) FILTER (WHERE created_at >= {TODAY} AND event_name IN {CLICK}) AS today_clicks FROM {EV}""")
_growth = lambda all_time: f"""
SELECT dau, mau, total_users, {o.ratio('dau', 'mau', 1, 100)} AS dau_mau_ratio, {o.ratio('savers', 'seen', 1, 100)} AS save_rate FROM (
  SELECT {users(f"CAST(created_at AS DATE) = {TODAY} AND created_at >= {ago(14)}")} AS dau, {users(f"created_at >= {ago(14)}")} AS mau,
    {'COUNT(DISTINCT anon_id)' if all_time else users(f"created_at >= {ago(14)}")} AS total_users,
    {users(f"created_at >= {ago(14)}")} AS seen, {users(f"event_name IN {SAVE} AND created_at >= {ago(14)}")} AS savers FROM {EV}) x"""  # noqa: E731
register("growth", lambda s, d: e.growth(events(s, d), NOW, 14), _growth(False))
register("growth_all_time_users", lambda s, d: e.growth(events(s, d), NOW, 14, all_time_users=True), _growth(True))
register("daily_visitors", lambda s, d: e.daily_visitors(events(s, d), NOW, 14).withColumn("day", day_text("day")), f"""
SELECT strftime(created_at, '%Y-%m-%d') AS day, COUNT(DISTINCT anon_id) AS visitors, COUNT(*) AS events FROM {EV}
WHERE created_at >= {ago(14)} AND anon_id IS NOT NULL GROUP BY 1""")


def _retention_sql(n: int, empty: str) -> str:
    return f"""
WITH cohort AS (SELECT anon_id, MIN(CAST(created_at AS DATE)) AS f FROM {EV} WHERE created_at >= {ago(2 * n)} AND created_at < {ago(n)} GROUP BY anon_id),
marked AS (SELECT anon_id, EXISTS (SELECT 1 FROM {EV} x WHERE x.anon_id = c.anon_id AND CAST(x.created_at AS DATE) > f AND CAST(x.created_at AS DATE) <= f + {n}) AS back FROM cohort c),
sums AS (SELECT COUNT(*) AS cohort_size, COUNT(*) FILTER (WHERE back) AS returned FROM marked)
SELECT cohort_size, returned, COALESCE({o.ratio('returned', 'cohort_size', 1, 100)}, {empty}) AS rate FROM sums"""


register("retention_7d", lambda s, d: e.retention_rate(events(s, d), NOW, 7), _retention_sql(7, "NULL"))
register("retention_30d_or_zero", lambda s, d: e.retention_rate(events(s, d), NOW, 30, True), _retention_sql(30, "0"))
register("engagement", lambda s, d: e.engagement(events(s, d), NOW, 14), f"""
WITH u AS (SELECT anon_id, COUNT(*) AS n, COUNT(DISTINCT CAST(created_at AS DATE)) AS days, COUNT(*) FILTER (WHERE event_name IN {SAVE}) AS saves,
    MIN(CAST(created_at AS DATE)) AS f FROM {EV} WHERE created_at >= {ago(14)} GROUP BY anon_id),
w AS (SELECT *, EXISTS (SELECT 1 FROM {EV} x WHERE x.anon_id = u.anon_id AND CAST(x.created_at AS DATE) = u.f AND x.event_name IN {SAVE}) AS act FROM u),
t AS (SELECT COUNT(*) AS c, COUNT(*) FILTER (WHERE act) AS a, COUNT(*) FILTER (WHERE days > 1) AS m, COUNT(*) FILTER (WHERE n = 1) AS b,
    CAST(SUM(n) AS BIGINT) AS e, CAST(SUM(days) AS BIGINT) AS d, CAST(SUM(saves) AS BIGINT) AS s, COUNT(*) FILTER (WHERE saves > 0) AS sv FROM w)
SELECT {o.ratio('a', 'c', 1, 100)} AS activation_rate, {o.ratio('m', 'c', 1, 100)} AS return_rate, {o.ratio('b', 'c', 1, 100)} AS bounce_rate,
  {o.ratio('e', 'd', 1)} AS events_per_user_day, {o.ratio('s', 'sv', 1)} AS saves_per_saver FROM t""")
o.EXTRA["o_user_days_56"] = f"SELECT DISTINCT anon_id, CAST(created_at AS DATE) AS d FROM {EV} WHERE created_at >= {ago(56)}"
o.EXTRA["o_user_days_90"] = f"SELECT DISTINCT anon_id, CAST(created_at AS DATE) AS d FROM {EV} WHERE created_at >= {ago(90)}"
_w = lambda k: f"bool_or(d >= cm + {7 * k} AND d < cm + {7 * k + 7}) AS w{k}"
register("weekly_cohorts", lambda s, d: e.weekly_cohorts(events(s, d), NOW).withColumn("cohort_week", day_text("cohort_week")), f"""
WITH f AS (SELECT anon_id, MIN(d) AS fd FROM o_user_days_56 GROUP BY anon_id),
c AS (SELECT anon_id, fd - CAST(isodow(fd) - 1 AS INT) AS cm FROM f),
j AS (SELECT cm, anon_id, {', '.join(_w(k) for k in range(1, 5))} FROM c JOIN o_user_days_56 USING (anon_id) GROUP BY cm, anon_id)
SELECT strftime(cm, '%Y-%m-%d') AS cohort_week, COUNT(*) AS cohort_size, CAST(100 AS BIGINT) AS week0,
  {', '.join(f"CASE WHEN {TODAY} >= cm + {7 * k + 7} THEN {o.ratio(f'COUNT(*) FILTER (WHERE w{k})', 'COUNT(*)', 1, 100)} END AS week{k}" for k in range(1, 5))}
FROM j GROUP BY cm""")
_marks = [1, 3, 7, 14, 30]
register("day_n_cohorts", lambda s, d: e.day_n_cohorts(events(s, d), NOW).withColumn("cohort_week", day_text("cohort_week")), f"""
WITH f AS (SELECT anon_id, MIN(d) AS fd FROM o_user_days_90 GROUP BY anon_id),
j AS (SELECT fd - CAST(isodow(fd) - 1 AS INT) AS cm, anon_id, bool_or(d = fd + 1) AS d1, {', '.join(f'bool_or(d > fd AND d <= fd + {n}) AS d{n}' for n in _marks[1:])}
  FROM f JOIN o_user_days_90 USING (anon_id) GROUP BY fd, anon_id)
SELECT strftime(cm, '%Y-%m-%d') AS cohort_week, COUNT(*) AS cohort_size,
  {', '.join(f"{o.ratio(f'COUNT(*) FILTER (WHERE d{n})', 'COUNT(*)', 1, 100)} AS day{n}" for n in _marks)} FROM j GROUP BY cm""")
register("day_n_cohorts_from_monday", lambda s, d: e.day_n_cohorts_from_monday(events(s, d), NOW).withColumn("cohort_week", day_text("cohort_week")), f"""
WITH f AS (SELECT anon_id, MIN(d) AS fd FROM o_user_days_90 GROUP BY anon_id),
c AS (SELECT anon_id, fd - CAST(isodow(fd) - 1 AS INT) AS cm FROM f),
j AS (SELECT cm, anon_id, {', '.join(f'bool_or(d - cm BETWEEN 1 AND {n}) AS d{n}' for n in _marks)} FROM c JOIN o_user_days_90 USING (anon_id) GROUP BY cm, anon_id)
SELECT strftime(cm, '%Y-%m-%d') AS cohort_week, COUNT(*) AS cohort_size,
  {', '.join(f"{o.js_pct(f'COUNT(*) FILTER (WHERE d{n})', 'COUNT(*)')} AS day{n}" for n in _marks)} FROM j GROUP BY cm ORDER BY cm DESC LIMIT 12""")
register("funnel", lambda s, d: e.funnel(events(s, d)), f"""
SELECT COUNT(DISTINCT anon_id) AS visited, {users(f"event_name IN {ENGAGED}")} AS engaged, {users(f"event_name IN {ACTIVATED}")} AS activated,
  (SELECT COUNT(*) FROM (SELECT anon_id FROM {EV} GROUP BY anon_id HAVING COUNT(DISTINCT CAST(created_at AS DATE)) >= 3) p) AS power_user FROM {EV}""")
register("event_breakdown", lambda s, d: e.event_breakdown(events(s, d)), f"SELECT event_name, COUNT(*) AS n FROM {EV} GROUP BY event_name")
register("hourly_activity", lambda s, d: e.hourly_activity(events(s, d)), f"""
SELECT h.hour, COUNT(x.id) AS n FROM range(24) h(hour) LEFT JOIN {EV} x ON hour(x.created_at) = h.hour GROUP BY h.hour""")
register("device_breakdown", lambda s, d: e.device_breakdown(events(s, d)),
         f"SELECT device_type, COUNT(DISTINCT anon_id) AS n FROM {EV} WHERE device_type IS NOT NULL GROUP BY device_type")
_host = "COALESCE(NULLIF(regexp_extract(referrer_url, '^[a-z]+://([^/?#:]+)', 1), ''), 'direct')"
register("referrers", lambda s, d: e.referrers(events(s, d)), f"""
SELECT {_host} AS source, COUNT(*) AS n FROM {EV} WHERE event_name = 'app_loaded' AND referrer_url IS NOT NULL GROUP BY 1 ORDER BY n DESC, source LIMIT 10""")
register("referrer_class", lambda s, d: events(s, d).groupBy(e.referrer_class(F.col("referrer_url")).alias("channel")).agg(F.count("*").alias("n")), f"""
SELECT CASE WHEN h IS NULL THEN 'direct' WHEN h IN ('t.co','x.com','twitter.com') THEN 'twitter' WHEN h LIKE '%google.com' THEN 'google'
  WHEN h LIKE '%reddit.com' THEN 'reddit' ELSE h END AS channel, COUNT(*) AS n
FROM (SELECT NULLIF(regexp_extract(referrer_url, '^[a-z]+://([^/?#:]+)', 1), '') AS h FROM {EV}) x GROUP BY 1""")
register("viral", lambda s, d: e.viral(events(s, d)), f"""
WITH t AS (SELECT COUNT(*) FILTER (WHERE event_name IN {SHARE}) AS shares, COUNT(*) FILTER (WHERE event_name = 'shared_page_view') AS views,
  COUNT(*) FILTER (WHERE event_name = 'referral_click') AS clicks, COUNT(*) FILTER (WHERE event_name = 'referral_conversion') AS conversions,
  {users(f"event_name IN {ACTIVATED}")} AS act FROM {EV})
SELECT shares, views, clicks, conversions,
  {o.round_dec('(shares / CAST(act AS DOUBLE)) * (conversions / CAST(greatest(clicks, views, 1) AS DOUBLE))', 3)} AS viral_coefficient,
  {o.js_pct('views', 'shares')} AS share_view_rate, {o.js_pct('conversions', 'clicks')} AS click_conversion_rate FROM t""")
register("top_referrers", lambda s, d: e.top_referrers(events(s, d)), f"""
SELECT referrer_id, COUNT(*) FILTER (WHERE event_name = 'referral_conversion') AS conversions, COUNT(*) FILTER (WHERE event_name = 'referral_click') AS clicks
FROM {EV} WHERE event_name IN ('referral_click','referral_conversion') GROUP BY referrer_id ORDER BY conversions DESC, clicks DESC, referrer_id LIMIT 10""")
_this, _last = f"created_at >= {ago(7)}", f"created_at >= {ago(14)} AND created_at < {ago(7)}"
_kinds = {"saves": SAVE, "clicks": CLICK, "shares": SHARE}
_chg = lambda k: (f"CASE WHEN {k}_last > 0 THEN CAST(floor(CAST({k}_this - {k}_last AS DOUBLE) / {k}_last * 100 + 0.5) AS BIGINT) "  # noqa: E731
                  f"WHEN {k}_this > 0 THEN 100 ELSE 0 END AS {k}_change")
register("week_over_week", lambda s, d: e.week_over_week(events(s, d), NOW), f"""
WITH t AS (SELECT {users(_this)} AS visitors_this, {users(_last)} AS visitors_last,
  {', '.join(f"COUNT(*) FILTER (WHERE {w} AND event_name IN {names}) AS {k}_{n}" for k, names in _kinds.items() for n, w in (('this', _this), ('last', _last)))} FROM {EV})
SELECT *, {', '.join(_chg(k) for k in ['visitors', *_kinds])} FROM t""")
register("stickiness", lambda s, d: e.stickiness(events(s, d), NOW), f"""
WITH m AS (SELECT COUNT(DISTINCT anon_id) AS mau, {users(_this)} AS wau FROM {EV} WHERE created_at >= {ago(90)}),
dd AS (SELECT COUNT(DISTINCT anon_id) AS n FROM {EV} WHERE {_this} GROUP BY CAST(created_at AS DATE)),
a AS (SELECT CAST(SUM(n) AS DOUBLE) / COUNT(*) AS mean, COUNT(*) AS n_days FROM dd)
SELECT wau, mau, n_days, {o.js_round('mean / mau * 100')} AS stickiness FROM m, a""")
register("churn_and_return", lambda s, d: e.churn(events(s, d), NOW), f"""
WITH u AS (SELECT anon_id, bool_or({_this}) AS t, bool_or({_last}) AS l, bool_or(created_at < {ago(7)}) AS old FROM {EV} WHERE created_at >= {ago(90)} GROUP BY anon_id),
s AS (SELECT COUNT(*) FILTER (WHERE l) AS last_week, COUNT(*) FILTER (WHERE l AND NOT t) AS churned, COUNT(*) FILTER (WHERE old) AS old_users,
  COUNT(*) FILTER (WHERE old AND t) AS returned FROM u)
SELECT last_week, churned, {o.js_pct('churned', 'last_week')} AS churn_rate, old_users, returned, {o.js_pct('returned', 'old_users')} AS return_rate FROM s""")
_week = f"CAST(floor((epoch_us({TS}) - epoch_us(created_at)) / CAST({7 * 86400 * 1_000_000} AS DOUBLE)) AS BIGINT)"
register("growth_velocity", lambda s, d: e.growth_velocity(events(s, d), NOW), f"""
WITH t AS (SELECT {', '.join(f"{users(f'{_week} = {k}')} AS w{k}" for k in range(4))} FROM {EV}),
b AS (SELECT *, CASE WHEN w3 > 0 THEN w3 ELSE w2 END AS oldest, {' + '.join(f'CASE WHEN w{k} > 0 THEN 1 ELSE 0 END' for k in range(4))} AS busy FROM t)
SELECT w0, w1, w2, w3, CASE WHEN busy >= 2 AND oldest > 0 AND w0 > 0 THEN {o.js_round('(power(CAST(w0 AS DOUBLE) / oldest, 1.0::DOUBLE / (busy - 1)) - 1) * 100')} ELSE 0 END AS growth_velocity FROM b""")
register("activation_to_retention", lambda s, d: e.activation_to_retention(events(s, d), NOW, 14), f"""
WITH u AS (SELECT anon_id, bool_or(event_name IN {ACTIVATED} AND created_at >= {ago(14)}) AS a, COUNT(DISTINCT CAST(created_at AS DATE)) AS n FROM {EV}
  WHERE created_at >= {ago(90)} GROUP BY anon_id), s AS (SELECT COUNT(*) AS activated, COUNT(*) FILTER (WHERE n >= 2) AS kept FROM u WHERE a)
SELECT activated, kept, {o.js_pct('kept', 'activated')} AS rate FROM s""")
register("store_referral_clicks", lambda s, d: e.store_referral_clicks(events(s, d)), f"""
SELECT COALESCE(store, 'Unknown') AS store, COUNT(*) AS clicks FROM {EV} WHERE event_name IN {CLICK} GROUP BY 1 ORDER BY clicks DESC, store LIMIT 15""")
o.EXTRA["o_touch"] = f"""SELECT anon_id, utm_source AS source, created_at AS ts, id AS tid FROM {EV} WHERE event_name = 'app_loaded' AND COALESCE(utm_source, '') <> ''
QUALIFY row_number() OVER (PARTITION BY anon_id ORDER BY created_at, id) = 1"""
register("first_touch", lambda s, d: e.first_touch(events(s, d)).select("anon_id", "source"), "SELECT anon_id, source FROM o_touch")
register("acquisition_channels", lambda s, d: e.acquisition_channels(events(s, d)), f"""
SELECT CASE WHEN t.ts < x.created_at OR (t.ts = x.created_at AND t.tid <= x.id) THEN t.source ELSE 'organic' END AS source,
  COUNT(DISTINCT x.anon_id) AS visitors, COUNT(*) FILTER (WHERE event_name IN {SAVE}) AS saves, COUNT(*) FILTER (WHERE event_name IN {CLICK}) AS clicks
FROM {EV} x LEFT JOIN o_touch t ON t.anon_id = x.anon_id GROUP BY 1""")
register("persistent_source", lambda s, d: events(s, d).groupBy(e.persistent_source(F.col("utm_source"), F.col("referrer_url")).alias("source")).agg(F.count("*").alias("n")), f"""
SELECT COALESCE(utm_source, CASE WHEN h IS NULL THEN 'direct' WHEN h = 't.co' THEN 'twitter' WHEN h LIKE '%google.com' THEN 'google'
  WHEN h LIKE '%reddit.com' THEN 'reddit' ELSE h END) AS source, COUNT(*) AS n
FROM (SELECT utm_source, NULLIF(regexp_extract(referrer_url, '^[a-z]+://([^/?#:]+)', 1), '') AS h FROM {EV}) x GROUP BY 1""")
# the campaign starts in the second half of the range, so that both segments hold users
CAMPAIGN = "reddit"
_late = lambda s, d: events(s, d).withColumn(
    "utm_source", F.when((F.col("utm_source") != CAMPAIGN) | (F.col("created_at") >= F.lit("2024-01-10").cast("timestamp_ntz")), F.col("utm_source")))
o.EXTRA["o_late"] = f"SELECT * REPLACE (CASE WHEN utm_source <> '{CAMPAIGN}' OR created_at >= DATE '2024-01-10' THEN utm_source END AS utm_source) FROM {EV}"
o.EXTRA["o_campaign"] = f"""
SELECT anon_id, MIN(CAST(created_at AS DATE)) >= least({TODAY}, (SELECT MIN(CAST(created_at AS DATE)) FROM o_late WHERE event_name = 'app_loaded' AND utm_source = '{CAMPAIGN}')) AS is_new
FROM o_late GROUP BY anon_id"""
register("campaign_segment", lambda s, d: e.campaign_segment(_late(s, d), NOW, CAMPAIGN), f"""
WITH u AS (SELECT anon_id, COUNT(*) AS n, COUNT(DISTINCT CAST(created_at AS DATE)) AS days, bool_or(event_name IN {ENGAGED}) AS eng, bool_or(event_name IN {ACTIVATED}) AS act,
  {', '.join(f"COUNT(*) FILTER (WHERE event_name IN {v}) AS {k}" for k, v in _kinds.items())} FROM o_late GROUP BY anon_id),
s AS (SELECT CASE WHEN is_new THEN 'new' ELSE 'earlier' END AS segment, COUNT(*) AS visitors, CAST(SUM(n) AS BIGINT) AS events,
  {', '.join(f"CAST(SUM({k}) AS BIGINT) AS {k}" for k in _kinds)}, COUNT(*) FILTER (WHERE eng) AS engaged, COUNT(*) FILTER (WHERE act) AS activated,
  COUNT(*) FILTER (WHERE days >= 3) AS power_users, COUNT(*) FILTER (WHERE n <= 1) AS bounced FROM u JOIN o_campaign USING (anon_id) GROUP BY 1)
SELECT *, {o.round_dec('events / CAST(visitors AS DOUBLE)', 1)} AS events_per_user, {o.js_pct('activated', 'visitors')} AS activation_rate,
  {o.js_pct('bounced', 'visitors')} AS bounce_rate FROM s""")
o.EXTRA["o_late_touch"] = "SELECT anon_id, arg_min(utm_source, (created_at, id)) AS source FROM o_late WHERE event_name = 'app_loaded' AND utm_source IS NOT NULL GROUP BY anon_id"
register("campaign_attribution", lambda s, d: e.campaign_attribution(_late(s, d), NOW, CAMPAIGN), f"""
SELECT COALESCE(t.source, 'organic') AS source, COUNT(DISTINCT x.anon_id) AS visitors, COUNT(*) FILTER (WHERE event_name IN {SAVE}) AS saves,
  COUNT(*) FILTER (WHERE event_name IN {CLICK}) AS clicks FROM o_late x JOIN o_campaign c ON c.anon_id = x.anon_id AND c.is_new
LEFT JOIN o_late_touch t ON t.anon_id = x.anon_id GROUP BY 1""")
register("campaign_top_stores", lambda s, d: e.campaign_top_stores(_late(s, d), NOW, 5, CAMPAIGN), f"""
SELECT store, COUNT(*) AS clicks FROM o_late JOIN o_campaign USING (anon_id) WHERE is_new AND store IS NOT NULL AND event_name IN {CLICK}
GROUP BY store ORDER BY clicks DESC, store LIMIT 5""")
register("campaign_top_deals", lambda s, d: e.campaign_top_deals(_late(s, d), NOW, 10, CAMPAIGN), f"""
SELECT k AS deal_id, COUNT(*) AS saves FROM o_late JOIN o_campaign USING (anon_id) WHERE is_new AND event_name IN {SAVE}
GROUP BY k ORDER BY saves DESC, deal_id LIMIT 10""")
register("daily_insert_cap", lambda s, d: e.daily_insert_cap(view(s, d, "analytics_events"), "anon_id", 2).select("id"), f"""
SELECT id FROM {EV} WHERE anon_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY anon_id, CAST(created_at AS DATE) ORDER BY created_at, id) <= 2""")
register("daily_insert_rejects", lambda s, d: e.daily_insert_rejects(events(s, d), "anon_id", 2).withColumn("day", day_text("day")), f"""
SELECT anon_id AS "user", strftime(created_at, '%Y-%m-%d') AS day, COUNT(*) AS n, COUNT(*) - 2 AS n_rejected FROM {EV} GROUP BY 1, 2 HAVING COUNT(*) > 2""")
register("user_set_difference", lambda s, d: _sets(s, d), f"""
WITH l AS (SELECT DISTINCT anon_id FROM {EV} WHERE {_last}), t AS (SELECT DISTINCT anon_id FROM {EV} WHERE {_this})
SELECT anon_id, 'lost' AS kind FROM (SELECT * FROM l EXCEPT SELECT * FROM t) a UNION ALL SELECT anon_id, 'kept' FROM (SELECT * FROM l INTERSECT SELECT * FROM t) b""")
register("user_day_pairs", lambda s, d: events(s, d).select("anon_id", day_text("created_at").alias("day")).distinct(),
         f"SELECT DISTINCT anon_id, strftime(created_at, '%Y-%m-%d') AS day FROM {EV}")
register("exists_returned", lambda s, d: _returned(s, d), f"""
WITH c AS (SELECT anon_id, MIN(CAST(created_at AS DATE)) AS f FROM {EV} GROUP BY anon_id)
SELECT anon_id FROM c WHERE EXISTS (SELECT 1 FROM {EV} x WHERE x.anon_id = c.anon_id AND CAST(x.created_at AS DATE) > f AND CAST(x.created_at AS DATE) <= f + 7)""")


def _sets(s, d):
    this, last = e._weeks(NOW)
    seen = lambda cond: events(s, d).filter(cond).select("anon_id").distinct()
    lost = seen(last).join(seen(this), "anon_id", "left_anti").withColumn("kind", F.lit("lost"))
    return lost.unionByName(seen(last).join(seen(this), "anon_id", "left_semi").withColumn("kind", F.lit("kept")))


def _returned(s, d):
    users = events(s, d).groupBy("anon_id").agg(F.min(e.day()).alias("first"), F.collect_set(e.day()).alias("days"))
    return users.filter(e._returned_within(F.col("first"), F.col("days"), 7)).select("anon_id")
