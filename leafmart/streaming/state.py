"""Keyed state of streaming jobs in tiers of append-only folders.

A micro-batch writes what it brings, reduced to a row per key, and reads nothing. Rows of a key are merged when they are read.
Eight folders of a tier are merged into one of the next, so a row is written again once a tier: bytes written follow the batch, and
the number of folders grows with the logarithm of the batches. A manifest a batch names the live folders. A replayed batch starts from the
manifest before it and overwrites its own folders; readers take the newest complete manifest. Folders that neither the newest nor the
manifest before it names are removed.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FAN = 8
MANIFEST = "part string, tier int, folder string, spec string, mark string"


def newest(rows: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The row of the highest `seq` of each key; null keys are equal."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(seq, F.xxhash64(*rest))).alias("_r")).select(*[F.col(c) if c in keys else F.col(f"_r.{c}").alias(c) for c in rows.columns])


def touched(rows: DataFrame) -> DataFrame:
    """First and last touch of a user and the first source ever seen."""
    return rows.groupBy("user_id").agg(
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
        F.min(F.when(F.col("touch.source").isNotNull(), F.col("touch"))).alias("touch"))


def merge(rows: DataFrame, spec: dict) -> DataFrame:
    if spec["merge"] == "newest":
        return newest(rows, spec["keys"], spec["seq"])
    return touched(rows) if spec["merge"] == "touched" else rows


@dataclass
class Tiers:
    """State under `root`. `spec` says how rows of a key merge: `newest` by keys and seq, `touched`, or `all` (every row stays).

    With `part` the state is divided by the values of a string column; a batch writes, and a reader may ask for, some parts only.
    """

    spark: SparkSession
    root: str
    spec: dict = field(default_factory=lambda: {"merge": "all"})
    part: str | None = None

    def _manifests(self) -> list[int]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/m=*/_SUCCESS")
        found = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(path)
        return sorted(int(f.getPath().getParent().getName()[2:]) for f in found or [])

    def live(self, below: int | None = None) -> list[dict]:
        """Entries of the newest manifest, of one below a batch id when given."""
        ids = [i for i in self._manifests() if below is None or i < below]
        return [r.asDict() for r in self.spark.read.schema(MANIFEST).parquet(f"{self.root}/m={ids[-1]:010d}").collect()] if ids else []

    def rows(self, entries: list[dict]) -> DataFrame | None:
        paths = [f"{self.root}/{e['folder']}" for e in entries]
        return self.spark.read.parquet(*paths) if paths else None

    def read(self, parts: list[str] | None = None) -> DataFrame | None:
        """Merged state, of some parts when given; None before the first batch."""
        entries = self.live()
        spec = json.loads(entries[0]["spec"]) if entries else self.spec
        found = self.rows([e for e in entries if parts is None or e["part"] in parts])
        return None if found is None else merge(found, spec)

    def _write(self, rows: DataFrame, folder: str, known: list[str] | None = None) -> list[tuple[str, str]]:
        """Part and path of what was written; with parts the sizes of files are evened out by the engine."""
        if self.part is None:
            rows.write.mode("overwrite").parquet(f"{self.root}/{folder}")
            return [("", folder)]
        rows.withColumn("_part", F.col(self.part)).hint("rebalance", "_part").write.mode("overwrite").partitionBy("_part").parquet(f"{self.root}/{folder}")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{folder}/_part=*")
        names = [f.getPath().getName() for f in path.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(path) or []]
        return [(n[len("_part="):], f"{folder}/{n}") for n in sorted(names)]

    def add(self, batch_id: int, rows: DataFrame, mark: str = "", final: Column | None = None, closed: Tiers | None = None) -> None:
        """Adds the rows of a batch. `final` tells rows that no later batch can change: when tiers merge they move to `closed`,
        which is divided by part and not merged with open rows again. `mark` is kept in the manifest."""
        entries = [(e["part"], e["tier"], e["folder"]) for e in self.live(batch_id)]
        entries += [(part, 0, folder) for part, folder in self._write(rows, f"t0-{batch_id}")]
        tier = 0
        while True:
            full = {p for p in {e[0] for e in entries} if sum(e[0] == p and e[1] == tier for e in entries) >= FAN}
            if not full:
                break
            old = [e for e in entries if e[0] in full and e[1] == tier]
            merged = merge(self.spark.read.parquet(*[f"{self.root}/{e[2]}" for e in old]), self.spec)
            if final is not None and closed is not None:
                closed.add(batch_id * 16 + tier, merged.filter(final))
                merged = merged.filter(~F.coalesce(final, F.lit(False)))
            entries = [e for e in entries if e not in old] + [(part, tier + 1, folder) for part, folder in self._write(merged, f"t{tier + 1}-{batch_id}")]
            tier += 1
        table = self.spark.createDataFrame([(*e, json.dumps(self.spec), mark) for e in entries] or [("", -1, "", json.dumps(self.spec), mark)], MANIFEST)
        table.filter("tier >= 0").coalesce(1).write.mode("overwrite").parquet(f"{self.root}/m={batch_id:010d}")
        self._drop_unnamed()

    def _drop_unnamed(self) -> None:
        """Removes folders of this store that the two newest manifests do not name, and older manifests."""
        ids = self._manifests()
        if len(ids) < 3:
            return
        named = {e["folder"].split("/")[0] for i in ids[-2:] for e in self.spark.read.schema(MANIFEST).parquet(f"{self.root}/m={i:010d}").select("folder").collect()}
        parts = {e["folder"] for i in ids[-2:] for e in self.spark.read.schema(MANIFEST).parquet(f"{self.root}/m={i:010d}").select("folder").collect()}
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        keep = {f"m={i:010d}" for i in ids[-2:]}
        for status in files.listStatus(path):
            name = status.getPath().getName()
            if (name.startswith("t") and "-" in name and name not in named) or (name.startswith("m=") and name not in keep):
                files.delete(status.getPath(), True)
            elif name in named and self.part is not None:
                for inner in files.listStatus(status.getPath()):
                    if inner.getPath().getName().startswith("_part=") and f"{name}/{inner.getPath().getName()}" not in parts:
                        files.delete(inner.getPath(), True)
