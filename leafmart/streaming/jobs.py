"""The four continuous jobs as Structured Streaming queries over files.

State that must survive (latest run rows, sessions, accepted events, saves per window) lies in tiers of append-only folders, see
`streaming.state`: a batch writes what it brings. All folders lie under the cluster's checkpoint folder unless the caller names one.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmart import lookups as L
from leafmart.session import ensure_checkpoint_dir
from leafmart.streaming.state import Tiers, merge, newest, touched


def work_folder(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def file_stream(spark: SparkSession, folder: str, pattern: str, schema, per_trigger: int = 1000) -> DataFrame:
    return (spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", per_trigger)
            .format("parquet").load(folder))


def run_to_end(stream: DataFrame, step: Callable[[DataFrame, int], None], root: str, mode: str = "append") -> None:
    """Process everything that is there now."""
    q = (stream.writeStream.foreachBatch(step).outputMode(mode).option("checkpointLocation", f"{root}/_checkpoint")
         .trigger(availableNow=True).start())
    q.awaitTermination()


def latest(spark: SparkSession, root: str) -> DataFrame:
    """State of a job: its live tiers, and the closed rows where it has some, merged."""
    store = Tiers(spark, root)
    rows = store.rows(store.live())
    closed = Tiers(spark, f"{root}/closed")
    done = closed.rows(closed.live())
    both = rows if done is None else rows.unionByName(done.select(*rows.columns))
    return merge(both, json.loads(store.live()[0]["spec"]))


def run_state_feed(stream: DataFrame, root: str, key: str = "id", seq: str = "seq") -> None:
    """Latest row per run by ``seq`` from inserts and updates, also when they come late; the running ones are those whose
    status says so."""
    def step(batch: DataFrame, batch_id: int) -> None:
        Tiers(batch.sparkSession, root, {"merge": "newest", "keys": [key], "seq": seq}).add(batch_id, newest(batch, [key], seq))

    run_to_end(stream, step, root)


MILESTONES = [60, 180, 300, 600]


def session_touch(stream: DataFrame, root: str) -> None:
    """Sessions by user: first and last touch, and the first source ever seen (never overwritten).

    Each batch is reduced to one row per user; it meets the stored rows of the user when tiers merge and when sessions are read.
    """
    def step(batch: DataFrame, batch_id: int) -> None:
        at = F.struct(F.col("created_at").alias("at"), F.col("id").alias("event"), F.col("utm_source").alias("source"))
        rows = batch.select(F.col("anon_id").alias("user_id"), F.col("created_at").alias("first_seen"), F.col("created_at").alias("last_seen"),
                            F.when(F.col("event_name") == "app_loaded", at).alias("touch"))
        Tiers(batch.sparkSession, root, {"merge": "touched"}).add(batch_id, touched(rows))

    run_to_end(stream, step, root)


def session_milestones(events: DataFrame) -> DataFrame:
    """Per user and day: length in seconds and how many duration marks (1, 3, 5, 10 minutes) it passed."""
    at = F.unix_seconds(F.col("created_at").cast("timestamp"))
    s = events.groupBy(F.col("anon_id").alias("user_id"), F.to_date("created_at").alias("day")).agg((F.max(at) - F.min(at)).alias("seconds"))
    passed = sum((F.when(F.col("seconds") >= m, 1).otherwise(0) for m in MILESTONES), F.lit(0))
    return s.withColumn("milestones", passed.cast("long"))


#: Days a batch may span before its days are joined instead of listed.
LISTED_DAYS = 4000


def event_ingest(stream: DataFrame, root: str, cap: int = 500) -> None:
    """Appends events once per id and at most ``cap`` per user and day, however late they come.

    Accepted rows lie by day under ``accepted``; a batch opens the folders of its own days only, once to leave out known ids and
    once for a count per user and day. Folders of a day are merged in tiers, so their number stays small.
    """
    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        store = Tiers(spark, f"{root}/accepted", {"merge": "all"}, part="day")
        rows = batch.filter(F.col("anon_id").isNotNull()).withColumn("created_at", F.col("created_at").cast("timestamp"))
        rows = rows.dropDuplicates(["id"]).withColumn("day", F.coalesce(F.date_format("created_at", "yyyy-MM-dd"), F.lit("unknown")))
        days = {r["day"] for r in rows.select("day").distinct().limit(LISTED_DAYS + 1).collect()}
        entries = [e for e in store.live(batch_id) if e["part"] in days or len(days) > LISTED_DAYS]
        before, taken = store.rows(entries), F.lit(0)
        if before is not None:
            rows = rows.join(before.select("id"), "id", "left_anti")
            counts = before.groupBy("anon_id", "day").agg(F.count("*").alias("_n"))
            rows, taken = rows.join(counts, ["anon_id", "day"], "left"), F.coalesce("_n", F.lit(0))
        order = Window.partitionBy("anon_id", "day").orderBy("created_at", "id")
        kept = rows.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") + taken <= cap).drop("_rn", "_n")
        store.add(batch_id, kept)

    run_to_end(stream, step, root)


def accepted_events(spark: SparkSession, root: str, days: list[str] | None = None) -> DataFrame | None:
    """Accepted events, of some days when given."""
    return Tiers(spark, f"{root}/accepted", {"merge": "all"}, part="day").read(days)


def window_saves(stream: DataFrame, root: str, size: str = "1 hour", slide: str | None = "5 minutes", delay: str = "10 minutes") -> None:
    """Saves per offer in sliding (or, without a slide, tumbling) windows, the running one included.

    Each batch brings the windows that changed; the highest count of a window is its last. Rows later than ``delay`` behind the
    newest are not counted, as their windows are closed. When tiers merge, closed windows move to ``closed``, by day of their
    start, and are not written again with the open ones.
    """
    saves = stream.filter(F.col("event_name").isin(L.SAVE_EVENTS)).withColumn("at", F.col("created_at").cast("timestamp"))
    win = F.window("at", size, slide) if slide else F.window("at", size)
    counts = saves.withWatermark("at", delay).groupBy(win.alias("w"), F.col("k").alias("deal_id")).agg(F.count("*").alias("saves"), F.max("at").alias("newest"))
    flat = counts.select("deal_id", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "saves", "newest")

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        keys = ["deal_id", "window_start", "window_end"]
        store = Tiers(spark, root, {"merge": "newest", "keys": keys, "seq": "saves"})
        before = store.live(batch_id)
        last = max([e["mark"] for e in before if e["mark"]] + [batch.agg(F.max("newest").cast("string")).first()[0] or ""])
        # behind the watermark of this batch; the next one can only be later
        final = F.col("window_end") <= F.lit(last or None).cast("timestamp") - F.expr(f"INTERVAL {delay}")
        closed = Tiers(spark, f"{root}/closed", {"merge": "all"}, part="day")
        rows = batch.drop("newest").withColumn("day", F.date_format("window_start", "yyyy-MM-dd"))
        store.add(batch_id, rows, last, final, closed)

    run_to_end(flat, step, root, "update")
