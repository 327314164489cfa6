"""Problem 3: a reproducible sample that keeps its members as data grows, by a persisted selection ledger.

Per track and snapshot: the distinct keys seen so far are the population, ``ceil(share * population)`` (at least
``least``) is the quota. All keys already in the ledger stay, by join; the rest of the quota is filled from the unselected
keys of lowest hash priority. The priority is a digest of seed, track and key, so it depends on neither row order nor
partitioning.

A ledger is a folder that later runs continue: the keys of each snapshot and the members it added are appended, nothing is
written again. The manifest has the sizes and, for each track, a histogram of the priorities of unselected keys (by their leading
digits, at most 65,536 counts a track), from which the cut is known before any key is read; then only the keys up to the
cut are read, and only those of the one bin at the cut are ranked.

Defined cases: null and blank operations are no members. Blanks around an operation do not count; operations that
arrive again are one member. Ties of priority (equal digests) are broken by the key itself. Empty tables give an empty
ledger. Rows of a null snapshot count as of the last snapshot. A continued ledger leaves snapshots out that it has had, so
rows that come later must bear a later snapshot. Extra columns are never read.
"""

from __future__ import annotations

import json
import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.session import cut, list_names, read_text, scratch, write_text

#: Hex digits of a priority that the histogram counts: 16 ** 4 bins.
DIGITS = 4
_AROUND = r"^[\s\p{Z}\x{200B}\x{2060}\x{FEFF}]+|[\s\p{Z}\x{200B}\x{2060}\x{FEFF}]+$"


def member_key(c: Column) -> Column:
    """The operation without blanks around it; null where nothing is left."""
    key = F.regexp_replace(c.cast("string"), _AROUND, "")
    return F.when(key != "", key)


def priority(seed: str, track: Column, key: Column) -> Column:
    return F.md5(F.concat_ws("\u0001", F.lit(seed), track, key))


def cut_of(bins: dict[str, int], n: int) -> tuple[str, int]:
    """The bin at which the ``n`` lowest priorities end, and how many of it belong to them; bins are sorted by name."""
    before = 0
    for b in sorted(bins):
        if before + bins[b] >= n:
            return b, n - before
        before += bins[b]
    raise ValueError(f"fewer than {n} keys")


class Ledger:
    """The selection of all snapshots so far, in the folder ``path``; a folder with a manifest is continued."""

    KEYS = "track string, key string, priority string, s int, d string"

    def __init__(self, spark: SparkSession, path: str | None = None, share: float = 0.25, least: int = 10, seed: str = "ledger-1"):
        self.spark, self.path = spark, path or scratch(spark, "ledger")
        settings = {"share": share, "least": least, "seed": seed}
        kept = read_text(spark, f"{self.path}/manifest.json")
        self.state = json.loads(kept) if kept else {"settings": settings, "snapshots": [], "sizes": {}, "held": {}, "open": {}}
        if self.state["settings"] != settings:
            raise ValueError(f"the ledger was kept with {self.state['settings']}")

    def _table(self, name: str) -> DataFrame:
        base = f"{self.path}/{name}"
        if not list_names(self.spark, base):
            return self.spark.createDataFrame([], self.KEYS)
        return self.spark.read.option("basePath", base).schema(self.KEYS).parquet(base)

    def members(self) -> DataFrame:
        """(track, key, priority, snapshot) of all members."""
        return self._table("members").select("track", "key", "priority", F.col("s").alias("snapshot"))

    def _append(self, rows: DataFrame, name: str, snapshot: int) -> None:
        digit = F.substring("priority", 1, 1).alias("d")
        rows.select("track", "key", "priority", digit).write.mode("overwrite").partitionBy("d").parquet(f"{self.path}/{name}/s={snapshot}")

    def grow(self, keys: DataFrame, snapshot: int, fresh: bool = False) -> None:
        """One more snapshot of ``keys`` (track, key); with ``fresh`` the keys are distinct and were never there before."""
        seed, share, least = (self.state["settings"][k] for k in ("seed", "share", "least"))
        if not fresh:
            keys = keys.select("track", "key").distinct().join(self._table("keys").select("track", "key"), ["track", "key"], "left_anti")
        self._append(keys.withColumn("priority", priority(seed, F.col("track"), F.col("key"))), "keys", snapshot)
        new = self._table("keys").where(F.col("s") == snapshot).groupBy("track", F.substring("priority", 1, DIGITS).alias("bin"))
        sizes, held, open_ = self.state["sizes"], self.state["held"], self.state["open"]
        for r in new.agg(F.count("*").alias("n")).collect():  # at most 16 ** DIGITS rows a track
            sizes[r["track"]] = sizes.get(r["track"], 0) + r["n"]
            bins = open_.setdefault(r["track"], {})
            bins[r["bin"]] = bins.get(r["bin"], 0) + r["n"]
        cuts = {}
        for t, n in sizes.items():
            wanted = min(n, max(least, math.ceil(round(share * n, 6)))) - held.get(t, 0)
            if wanted > 0:
                at, room = cuts[t] = cut_of(open_[t], wanted)
                open_[t] = {b: c for b, c in open_[t].items() if b > at} | ({at: open_[t][at] - room} if open_[t][at] > room else {})
                held[t] = held.get(t, 0) + wanted
        if cuts:
            self._append(self._lowest(cuts), "members", snapshot)
        self.state["snapshots"].append(snapshot)
        write_text(self.spark, f"{self.path}/manifest.json", json.dumps(self.state))

    def _lowest(self, cuts: dict[str, tuple[str, int]]) -> DataFrame:
        """The unselected keys up to the cut of each track."""
        digits = sorted({f"{d:x}" for d in range(16) if any(f"{d:x}" <= at[0] for at, _ in cuts.values())})
        bin_ = F.substring("priority", 1, DIGITS)
        edge = F.create_map(*[F.lit(x) for t, (at, _) in cuts.items() for x in (t, at)])[F.col("track")]
        room = F.create_map(*[F.lit(x) for t, (_, n) in cuts.items() for x in (t, n)])[F.col("track")]
        near = lambda name: self._table(name).where(F.col("d").isin(digits) & (bin_ <= edge)).select("track", "key", "priority")
        unseen = near("keys").join(near("members").select("track", "key"), ["track", "key"], "left_anti")
        rank = F.row_number().over(Window.partitionBy("track").orderBy("priority", "key"))
        last = unseen.where(bin_ == edge).withColumn("rk", rank).where(F.col("rk") <= room).drop("rk")
        return unseen.where(bin_ < edge).unionByName(last)


def stable_sample(
    tables: dict[str, DataFrame], text_col: str, snapshot_col: str, share: float = 0.25, least: int = 10, seed: str = "ledger-1", path: str | None = None
) -> DataFrame:
    """(track, operation, priority, snapshot): the ledger over all snapshots of the tracks in ``tables``.

    With ``path`` the ledger in that folder is continued by the snapshots it has not had.
    """
    rows = reduce(
        DataFrame.unionByName,
        [
            df.select(F.lit(t).alias("track"), member_key(F.col(text_col)).alias("key"), F.coalesce(F.col(snapshot_col).cast("int"), F.lit(LAST)).alias("s"))
            for t, df in tables.items()
        ],
    ).where("key is not null")
    ledger = Ledger(rows.sparkSession, path, share, least, seed)
    had = ledger.state["snapshots"]
    if had:
        rows = rows.where(~F.col("s").isin(had))
    first = cut(rows.groupBy("track", "key").agg(F.min("s").alias("s")), "first-seen", "s")
    for snap in sorted(r["s"] for r in first.select("s").distinct().collect()):  # one row a snapshot
        ledger.grow(first.where(F.col("s") == snap), snap, fresh=not had)
    return ledger.members().select("track", F.col("key").alias("operation"), "priority", "snapshot")


#: Snapshot of rows that have none.
LAST = 2**31 - 1
