"""Problem 5: duplicates of new batches against all history, by sorted-neighbourhood runs under several keys.

Every record has sort keys with a real order: the tree of its computation and its bare spelling; a text that is no operation has
its letters and digits, read forwards and backwards. The accepted history is a store of sorted runs in a folder: each run is
divided into key ranges (one folder a range) and sorted inside each, with one row per distinct key. A batch is reduced
to its distinct keys and sorted; of the runs only the ranges that the batch touches are read, and of these only the
blocks of the order (keys of one beginning) that hold a new record. What is left is merged with the batch by the order,
and every new record is compared with the ``window`` records before and behind it: equal keys repeat each other, and
so do texts of words whose five-word shingles are alike by 0.8 or more. New keys become a new run; runs of like size are
merged once there are ``fan`` of them, and the ranges are cut anew when the store has outgrown them.

A store is a folder with a manifest, which every later session continues (``AcceptedRuns(spark, path)``). Ranges hold about
``RANGE_ROWS`` distinct keys each (more only beyond two billion keys), whatever the number of rows a key has; the rows of a batch come
back to their keys with hot keys broadcast.

Defined cases: null, blank and mark-only operations are no cases and enter no run. Texts that are no operation repeat
each other if their letters and digits agree, or by their shingles, if they have five words or more; windows end at the
borders of ranges, which cut a block only if it is larger than a range. Repeated ids give their row again. Ties cannot occur between ids; the smallest id is always the
first. Empty batches and an empty history are allowed. Batches follow each other by number where they have one, and by
text otherwise; rows of a null batch form the last one. Other columns are never read.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.llm.opkey import sort_keys
from quillstone.operators.skew import join_to_groups
from quillstone.session import cut, list_names, read_text, remove, scratch, write_text

RUN = "key string, first_id long, n long, fresh boolean, b string, grams array<long>, run string, r int"
#: Distinct keys of one range, about: what one task sorts.
RANGE_ROWS = 100_000
#: Most ranges; a store of more than ``RANGE_ROWS * MAX_RANGES`` keys has larger ones.
MAX_RANGES = 20_000
#: Keys a range that the cut of the ranges is estimated from.
SAMPLED = 50
#: Characters that the keys of one block share.
BLOCK = 16
#: Batches of at most so many keys have their blocks broadcast, some 10 MB; those of larger ones are shuffled.
BROADCAST_KEYS = 200_000
WINDOW, SIMILARITY = 3, 0.8


class AcceptedRuns:
    """The sorted runs of all records accepted so far, in the folder ``path``; a folder with a manifest is continued."""

    def __init__(self, spark: SparkSession, path: str | None = None, fan: int = 4, window: int = WINDOW, range_rows: int = RANGE_ROWS):
        self.spark, self.fan, self.window, self.range_rows = spark, fan, window, range_rows
        self.path = path or scratch(spark, "runs")
        kept = read_text(spark, f"{self.path}/manifest.json")
        state = json.loads(kept) if kept else {"next": 0, "splits": None, "runs": {}}
        #: live runs with their number of keys, and the first keys of all ranges but the first
        self.next: int = state["next"]
        self.splits: list[str] | None = state["splits"]
        self.runs: dict[str, int] = state["runs"]

    def _save(self) -> None:
        write_text(self.spark, f"{self.path}/manifest.json", json.dumps({"next": self.next, "splits": self.splits, "runs": self.runs}))

    def read(self, runs: list[str], ranges: list[int] | None = None) -> DataFrame:
        """The rows of some runs, of all ranges or of some."""
        base = f"{self.path}/runs"
        df = self.spark.read.option("basePath", base).schema(RUN).parquet(*[f"{base}/run={r}" for r in runs])
        return df if ranges is None else df.where(F.col("r").isin(ranges))

    def _range(self, key: Column) -> Column:
        """The range of a key: a binary search in the splits."""
        if not self.splits:
            return F.lit(0)
        splits = F.lit(self.splits)
        steps = F.sequence(F.lit(0), F.lit(math.ceil(math.log2(len(self.splits) + 1))))
        mid = lambda s: F.floor((s["lo"] + s["hi"]) / 2).cast("int")

        def halve(s: Column, _: Column) -> Column:
            above = F.get(splits, mid(s)) <= key
            lo = F.when((s["lo"] < s["hi"]) & above, mid(s) + 1).otherwise(s["lo"])
            hi = F.when((s["lo"] < s["hi"]) & ~above, mid(s)).otherwise(s["hi"])
            return F.struct(lo.alias("lo"), hi.alias("hi"))

        start = F.struct(F.lit(0).alias("lo"), F.lit(len(self.splits)).alias("hi"))
        return F.aggregate(steps, start, halve, lambda s: s["lo"])

    def _cut_ranges(self, keys: DataFrame, n: int) -> None:
        """Cut ranges of about ``range_rows`` keys (more where they would be too many), by a bounded sample chosen by hash."""
        ranges = min(MAX_RANGES, max(1, math.ceil(n / self.range_rows)))
        share = min(1.0, SAMPLED * ranges / max(n, 1))
        some = keys.where(F.pmod(F.xxhash64("key"), F.lit(1 << 20)) < math.ceil(share * (1 << 20))).select("key")
        found = sorted((r["key"] for r in some.limit(10 * SAMPLED * ranges).collect()), key=str.encode)
        edges = sorted({found[i * len(found) // ranges] for i in range(1, ranges)}, key=str.encode) if found else []
        # ranges begin with a block, but a block that is larger than a range is cut
        blocks = [e[:BLOCK] for e in edges]
        cuts = {e if i and blocks[i] == blocks[i - 1] else blocks[i] for i, e in enumerate(edges)}
        self.splits = sorted(cuts, key=str.encode)

    def _add(self, rows: DataFrame) -> str:
        """Persist a run, a folder a range, each sorted by key; returns its name."""
        run, seen = f"{self.next:06d}", Observation()
        self.next += 1
        rows = rows.observe(seen, F.count_if("fresh").alias("fresh"))
        rows.select("key", "first_id", "n", "fresh", "b", "grams", "r").write.mode("overwrite").partitionBy("r").parquet(
            f"{self.path}/runs/run={run}"
        )
        self.runs[run] = int(seen.get.get("fresh") or 0)
        return run

    def merge(self, keyed: DataFrame, b: str = "") -> str:
        """Merge a batch (id, keys, grams) named ``b`` into the store; returns the name of its run.

        The run has one row per key of the batch: ``first_id`` is the smallest id with that key or with a like text,
        ``n`` the rows of the batch with it, and ``fresh`` says whether the key was new. Only fresh rows belong to the
        history, and a key is fresh in one run only.
        """
        each = keyed.select("id", "grams", F.explode("keys").alias("key"))
        new = each.groupBy("key").agg(F.min("id").alias("id"), F.count("*").alias("n"), F.first("grams").alias("grams"))
        if self.splits is None:
            new = cut(new, "first-keys")
            self._cut_ranges(new, new.count())
        # the sorted batch, a folder a range
        batch, seen = scratch(self.spark, "batch"), Observation()
        new = new.select("key", F.col("id").alias("first_id"), "n", "grams", self._range(F.col("key")).alias("r"))
        new.observe(seen, F.count("*").alias("keys")).write.mode("overwrite").partitionBy("r").parquet(batch)
        new = self.spark.read.schema("key string, first_id long, n long, grams array<long>, r int").parquet(batch)
        rows = new.withColumn("mine", F.lit(True))
        if any(self.runs.values()):
            # ranges without a new key are not read
            touched = [int(r.removeprefix("r=")) for r in list_names(self.spark, batch) if r.startswith("r=")]
            block = F.substring("key", 1, BLOCK).alias("block")
            blocks = new.select(block).distinct()
            if seen.get.get("keys", 0) <= BROADCAST_KEYS:
                blocks = F.broadcast(blocks)
            old = self.read(list(self.runs), touched).where("fresh").withColumns({"block": block, "n": F.lit(0).cast("long"), "mine": F.lit(False)})
            near = old.join(blocks, "block", "left_semi")
            rows = rows.unionByName(near.select(*rows.columns))
        run = self._add(self._compared(rows, b))
        remove(self.spark, batch)
        self.compact()
        self._save()
        return run

    def _compared(self, rows: DataFrame, b: str) -> DataFrame:
        """The batch's rows after comparison with their neighbours in the order of keys."""
        near = F.struct(F.col("key").alias("k"), F.col("first_id").alias("f"), F.col("grams").alias("g"))
        w = Window.partitionBy("r").orderBy("key", "mine").rowsBetween(-self.window, self.window)
        beside = rows.select("*", F.collect_list(near).over(w).alias("beside")).where("mine")
        # a key occurs at most twice: in the history, and behind it in the batch, which sees itself too
        return beside.select(
            "r", "key", F.expr(f"array_min(transform(filter(beside, x -> x.k = key or {_LIKE}), x -> x.f))").alias("first_id"),
            "n", F.expr("size(filter(beside, x -> x.k = key)) = 1").alias("fresh"), F.lit(b).alias("b"), "grams",
        )

    def check(self, keyed: DataFrame, b: str = "") -> DataFrame:
        """(id, first_id) of the rows of a batch that repeat an earlier row; the batch is accepted on the way."""
        run = self.read([self.merge(keyed, b)])
        return found_in(keyed.withColumn("b", F.lit(b)), run).drop("b")

    def compact(self) -> None:
        """Merge runs of like size; their files stay until ``vacuum``, as results may still need them."""
        tiers: dict[int, list[str]] = {}
        for run, n in self.runs.items():
            tiers.setdefault(int(math.log(max(n, 1), self.fan)), []).append(run)
        for tier in sorted(tiers):
            if len(tiers[tier]) >= self.fan:
                old = tiers[tier]
                everything = self.read(old).where("fresh")
                ranges = len(self.splits or []) + 1
                if len(old) == len(self.runs) and sum(self.runs.values()) > 2 * self.range_rows * ranges and ranges < MAX_RANGES:
                    self._cut_ranges(everything, sum(self.runs.values()))
                    everything = everything.withColumn("r", self._range(F.col("key")))
                ranges = len(self.splits or []) + 1
                merged = everything.repartition(ranges, "r").sortWithinPartitions("r", "key")
                self._add(merged)
                for run in old:
                    del self.runs[run]
                return

    def vacuum(self) -> None:
        """Delete the files of runs that were merged into others."""
        for name in list_names(self.spark, f"{self.path}/runs"):
            if name.removeprefix("run=") not in self.runs:
                remove(self.spark, f"{self.path}/runs/{name}")


#: Whether the shingles of a neighbour x and of a row are alike; null shingles are like nothing.
_LIKE = f"""(grams is not null and x.g is not null and
 size(array_intersect(grams, x.g)) >= {SIMILARITY} * size(array_union(grams, x.g)))"""


def found_in(keyed: DataFrame, runs: DataFrame) -> DataFrame:
    """(b, id, first_id) of the rows (b, id, keys) that repeat an earlier row, given the runs of their batches."""
    rows = keyed.select("b", "id", F.explode("keys").alias("key"))
    many = runs.where("n > 1 or not fresh or grams is not null").select("b", "key", "first_id", "n")
    pairs = join_to_groups(rows, many, ["b", "key"], "n").where("first_id < id")
    return pairs.groupBy("b", "id").agg(F.min("first_id").alias("first_id"))


def keyed_rows(df: DataFrame, id_col: str, text_col: str, *extra: str, key: Callable[[Column], Column] = sort_keys) -> DataFrame:
    """(id, keys, grams, extra…): ids, sort keys and shingles of the rows that have an operation."""
    rows = df.select(F.col(id_col).alias("id"), *[F.col(c).alias(f"x{i}") for i, c in enumerate(extra)], key(F.col(text_col)).alias("k"))
    rows = rows.select("id", *[F.col(f"x{i}").alias(c) for i, c in enumerate(extra)], "k.keys", "k.grams")
    return rows.where(F.col("id").isNotNull() & (F.size("keys") > 0))


def _place(b: str | None) -> tuple:
    """Batches in the order of their numbers, other names behind by text, null last."""
    try:
        return (0, float(b), "") if b is not None else (2, 0.0, "")
    except ValueError:
        return (1, 0.0, b)


def repeats_of_history(
    history: DataFrame, batches: DataFrame, id_col: str, text_col: str, batch_col: str, **options
) -> DataFrame:
    """(first_id, id) of every row of ``batches`` that repeats an earlier row, batch after batch against the runs.

    With ``path`` the store in that folder is continued: ``history`` then holds what was accepted otherwise since.
    """
    spark = history.sparkSession
    store = AcceptedRuns(spark, **options)
    store.merge(keyed_rows(history, id_col, text_col), "history")
    keyed = cut(keyed_rows(batches.withColumn("_b", F.col(batch_col).cast("string")), id_col, text_col, "_b"), "batch-keys", "_b")
    names = [r["_b"] for r in keyed.select("_b").distinct().collect()]  # one row a batch
    runs = [store.merge(keyed.where(F.col("_b").eqNullSafe(b)).drop("_b"), f"b{b}") for b in sorted(names, key=_place)]
    if not runs:
        return keyed.select(F.col("id").alias("first_id"), F.col("id").alias(id_col)).where(F.lit(False))
    found = found_in(keyed.withColumn("b", F.concat(F.lit("b"), F.coalesce("_b", F.lit("None")))), store.read(runs))
    return found.select("first_id", F.col("id").alias(id_col))
