"""Run-log queries over ``history`` (records as JSON lines), ``events`` and ``lineitem`` (an order's lines as the
checkpoints of an iteration)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.operators import runlog as R


def _history(spark: SparkSession, sf: str) -> DataFrame:
    """Readable records with their typed headline fields; ``ord`` orders the lines of a run."""
    h = R.readable(spark.read.parquet(f"{sf}/history.parquet"), "record")
    r = F.col("record")
    return h.select(
        "history_id", "run_id", "file_seq", "line_no",
        (F.col("file_seq").cast("long") * 4_294_967_296 + F.col("line_no")).alias("ord"),
        R.path(r, "iteration").try_cast("int").alias("iteration"),
        R.path(r, "generation").try_cast("int").alias("generation"),
        R.path(r, "train_pool_size").try_cast("int").alias("train_pool_size"),
        R.accuracy(r, "heldout.pre").alias("heldout_pre"),
        R.accuracy(r, "heldout.post").alias("heldout_post"),
        R.number(r, "delta.overfit_gap").alias("overfit_gap"),
        R.path(r, "train.state_path").alias("state_path"), R.path(r, "kind").alias("kind"), R.path(r, "source").alias("source"),
    )


_OK = "json_valid(record) and json_type(record) = 'OBJECT'"
_D = lambda *ps: "coalesce(" + ", ".join(f"try_cast(case when json_type(record, '$.{p}') in ('DOUBLE','BIGINT','UBIGINT','HUGEINT') then record->>'$.{p}' end as double)" for p in ps) + ")"
_ACC = lambda p: _D(p, f"{p}.instant.accuracy", f"{p}.accuracy", f"{p}.instant_accuracy")
_H = f"""h as (select history_id, run_id, file_seq, line_no, cast(file_seq as bigint) * 4294967296 + line_no as ord,
 try_cast(record->>'$.iteration' as int) as iteration, try_cast(record->>'$.generation' as int) as generation,
 try_cast(record->>'$.train_pool_size' as int) as train_pool_size, {_ACC('heldout.pre')} as heldout_pre, {_ACC('heldout.post')} as heldout_post,
 {_D('delta.overfit_gap')} as overfit_gap, record->>'$.train.state_path' as state_path, record->>'$.kind' as kind, record->>'$.source' as source from (select * from history where {_OK}))"""

_IMP = f"(iteration = -1 or kind in {R.IMPORTED_KINDS} or source in {R.IMPORTED_SOURCES})"


def history_fields(spark: SparkSession, sf: str) -> DataFrame:
    return _history(spark, sf)


def history_generation(spark: SparkSession, sf: str) -> DataFrame:
    h = _history(spark, sf)
    imported = R.is_imported(F.col("kind"), F.col("source"), F.col("iteration"))
    slots = h.groupBy("run_id").agg(F.max(imported).alias("any_imported"))
    j = h.join(slots, h["run_id"].eqNullSafe(slots["run_id"])).select(h["*"], "any_imported")
    return j.select("history_id", R.generation(F.col("generation"), imported, F.col("iteration"), F.col("any_imported")).alias("generation"))


def history_series(spark: SparkSession, sf: str) -> DataFrame:
    """One row a run with the iterations and pool sizes in order of writing."""
    h = _history(spark, sf)
    rows = F.array_sort(F.collect_list(F.struct("ord", "iteration", "train_pool_size")))
    g = h.groupBy("run_id").agg(rows.alias("rows"))
    join = lambda f: F.array_join(F.transform("rows", lambda x: F.coalesce(x[f].cast("string"), F.lit("-"))), ",")
    return g.select("run_id", join("iteration").alias("iterations"), join("train_pool_size").alias("pool_sizes"))


def latest_eval(spark: SparkSession, sf: str) -> DataFrame:
    """The last record of each run that holds a held-out post accuracy."""
    h = _history(spark, sf).where("heldout_post is not null")
    return h.groupBy("run_id").agg(F.max_by(F.struct("iteration", "heldout_post"), F.struct("ord", "history_id")).alias("r")).select("run_id", "r.*")


def history_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Each run's records merged by iteration: written again, the last record takes the place of the first."""
    h = _history(spark, sf).where("run_id is not null and iteration is not null").withColumn("k", F.concat_ws(":", "run_id", "iteration"))
    spots = h.groupBy("k").agg(F.min("ord").alias("place"), F.max_by("history_id", F.struct("ord", "history_id")).alias("history_id"))
    return spots


def history_merge_files(spark: SparkSession, sf: str) -> DataFrame:
    """The first file of every run as base, the later ones merged into it."""
    h = _history(spark, sf).where("run_id is not null and iteration is not null").select(
        F.concat_ws(":", "run_id", "iteration").alias("k"), "ord", "history_id", "file_seq"
    )
    base = h.where("file_seq = 0").drop("file_seq")
    new = h.where("file_seq > 0").drop("file_seq")
    return R.upsert(base, new, "k", "ord").select("k", "history_id")


def marginal_history(spark: SparkSession, sf: str) -> DataFrame:
    """Whether the gain of each record is marginal: held-out pair, training pair, or post against that of the record before."""
    h = R.readable(spark.read.parquet(f"{sf}/history.parquet"), "record")
    out = R.with_marginal(h, "record", ["run_id"], ["file_seq", "line_no", "history_id"], 0.005, 1.0)
    return out.select("history_id", F.round("gain", 9).alias("gain"), F.round("band", 9).alias("band"), "marginal")


def marginal_cases(spark: SparkSession, sf: str) -> DataFrame:
    """Golden histories: with the noise band and without."""
    rows = spark.createDataFrame([(c, i, r) for c, records in enumerate(MARGINAL) for i, r in enumerate(records[0])], "c int, i int, record string")
    on, off = (R.with_marginal(rows, "record", ["c"], ["i"], 0.005, z).select("c", "i", F.col("marginal").alias(n)) for n, z in (("with_band", 1.0), ("without", 0.0)))
    return on.join(off, ["c", "i"])


def interim_records(spark: SparkSession, sf: str) -> DataFrame:
    """Imported and interim records."""
    h = R.readable(spark.read.parquet(f"{sf}/history.parquet"), "record")
    r, v = F.col("record"), F.try_parse_json("record")
    role = F.coalesce(R.path(r, "heldout.post.role"), F.when(R.path(r, "heldout.post").isNull(), F.coalesce(R.path(r, "post_heldout.role"), R.path(r, "post.role"))))
    pending = F.schema_of_variant(F.try_variant_get(v, "$.ci_refine_pending", "variant")) == "BOOLEAN"
    pending = F.coalesce(pending, F.lit(False)) & (R.path(r, "ci_refine_pending") == "true")
    imported = R.is_imported(R.path(r, "kind"), R.path(r, "source"), R.path(r, "iteration").try_cast("int"))
    return h.select("history_id", imported.alias("imported"), R.is_interim(pending, role, R.path(r, "note")).alias("interim"))


def latest_interim(spark: SparkSession, sf: str) -> DataFrame:
    """The last interim record of each run."""
    h = spark.read.parquet(f"{sf}/history.parquet").select("history_id", "run_id", "file_seq", "line_no")
    rows = interim_records(spark, sf).where("interim").join(h, "history_id")
    return rows.groupBy("run_id").agg(F.max_by("history_id", F.struct("file_seq", "line_no", "history_id")).alias("history_id"))


# golden histories (records) with the marks of their records, with the noise band and without
_P = '{"pre_heldout": {"instant": {"accuracy": %s%s}}, "post_heldout": {"instant": {"accuracy": %s%s}}}'
_C = ', "correct": %d, "total": 200'
MARGINAL = [
    ([_P % ("0.10", "", "0.101", "")], [(True, True)]),
    ([_P % ("0.50", _C % 100, "0.515", _C % 103)], [(True, False)]),
    ([_P % ("0.50", _C % 100, "0.62", _C % 124)], [(False, False)]),
    ([_P % ("0.50", "", "0.515", _C % 103)], [(False, False)]),
    ([_P % ("0.10", "", "0.20", ""), '{"pre_heldout": {"instant": {"accuracy": 0.20}}, "post": {"instant": {"accuracy": 0.201}}}'], [(False, False), (True, True)]),
    ([_P % ("0.10", "", "0.20", ""), _P % ("0.20", "", "0.202", ""), _P % ("0.202", "", "0.203", "")], [(False, False), (True, True), (True, True)]),
    (['{"train_seed": {"pre": 0.3, "post": 0.9}, "heldout": {"pre": 0.3}}', '{"accuracy": 0.91}'], [(False, False), (False, False)]),
    (['{"post": 0.5}', '{"post_eval": {"instant_accuracy": 0.504}}', "{}"], [(False, False), (True, True), (False, False)]),
]


def pre_post_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """pre of an iteration against post of the one before in its run."""
    h = _history(spark, sf).where("run_id is not null")
    w = Window.partitionBy("run_id").orderBy("ord", "history_id")
    return h.select("history_id", "heldout_pre", F.lag("heldout_post").over(w).alias("previous_post"))


def chart_points(spark: SparkSession, sf: str) -> DataFrame:
    """Mean held-out accuracy per generation with a live overlay of the unfinished ones."""
    h = _history(spark, sf).where("generation is not null")
    points = h.groupBy("generation").agg(F.round(F.avg("heldout_post"), 6).alias("accuracy"), F.count("*").alias("n"))
    live = h.where("heldout_post is null").groupBy((F.col("generation") + 1).alias("generation")).agg(
        F.lit(None).cast("double").alias("accuracy"), F.lit(0).cast("long").alias("n")
    )
    return R.overlay(points, live, "generation", ["accuracy", "n"])


def refine_overlay(spark: SparkSession, sf: str) -> DataFrame:
    """Refinements with more observations replace a generation's count, others do not."""
    h = _history(spark, sf).where("generation is not null")
    base = h.groupBy("generation").agg(F.count("*").alias("n"), F.max("train_pool_size").alias("pool"))
    late = h.groupBy((F.col("generation") + 1).alias("generation")).agg(F.count("*").alias("n"), F.min("train_pool_size").alias("pool"))
    return R.refine(base, late, "generation", "n", ["pool"])


def headline_fallback(spark: SparkSession, sf: str) -> DataFrame:
    h = _history(spark, sf)
    return h.select("history_id", R.headline(F.col("overfit_gap"), F.col("heldout_post")).alias("headline"), R.headline(F.col("overfit_gap"), F.col("heldout_post"), keep_zero=True).alias("strict"))


def reuse_check(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a record's checkpoint equals that of the record before in its run."""
    h = _history(spark, sf).where("run_id is not null")
    out = R.reusable(h.withColumn("sample", F.lit("s")), ["run_id"], "ord", "state_path", "sample")
    return out.select("history_id", "reuse")


def checkpoint_roles(spark: SparkSession, sf: str) -> DataFrame:
    li = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_linenumber", F.col("l_partkey").cast("string").alias("name"))
    roles = R.checkpoint_roles(li, ["l_orderkey"], "l_linenumber", "name")
    return roles.groupBy("l_linenumber", "role").agg(F.count("*").alias("n"))


def checkpoint_index_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Checkpoints indexed twice are one; nulls are equal."""
    li = spark.read.parquet(f"{sf}/lineitem.parquet").select(F.col("l_orderkey").alias("iteration"), F.nullif("l_returnflag", F.lit("N")).alias("state_path"), F.col("l_linestatus").alias("name"))
    return li.dropDuplicates(["iteration", "name", "state_path"]).groupBy("name", "state_path").agg(F.count("*").alias("n"))


def events_tail(spark: SparkSession, sf: str) -> DataFrame:
    e = spark.read.parquet(f"{sf}/events.parquet")
    return R.tail(e, 80, "event_id").select("event_id", "event_type", "user_id")


def status_last_value(spark: SparkSession, sf: str) -> DataFrame:
    """Every user's current event type and last value, and the last value of errors alone."""
    e = spark.read.parquet(f"{sf}/events.parquet").withColumn("error_value", F.when(F.col("event_type") == "error", F.col("value")))
    return R.last_values(e, ["user_id"], ["ts", "event_id"], ["event_type", "value", "error_value"])


def eval_progress_by_tag(spark: SparkSession, sf: str) -> DataFrame:
    """Last progress of each (user, type), and how many reports it took."""
    e = spark.read.parquet(f"{sf}/events.parquet")
    k = F.get_json_object("props", "$.k").cast("long")
    return e.groupBy("user_id", "event_type").agg(F.max_by(k, F.struct("ts", "event_id")).alias("progress"), F.count("*").alias("reports"))


def event_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly counts per kind: the batch form of the event stream."""
    e = spark.read.parquet(f"{sf}/events.parquet")
    return e.groupBy(F.date_format(F.date_trunc("hour", F.col("ts")), "yyyy-MM-dd HH:mm").alias("hour"), "event_type").agg(F.count("*").alias("n"))


def baseline_view(spark: SparkSession, sf: str) -> DataFrame:
    """The first record of every run as its baseline, with the flat field as fallback of the nested one."""
    h = R.readable(spark.read.parquet(f"{sf}/history.parquet"), "record").where("run_id is not null")
    r = F.col("record")
    rows = h.select("run_id", F.struct("file_seq", "line_no", "history_id").alias("o"), F.coalesce(R.accuracy(r, "train_seed.pre"), R.accuracy(r, "pre")).alias("baseline"))
    return rows.groupBy("run_id").agg(F.min_by("baseline", "o").alias("baseline"))


def list_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Runs by their latest writing, with records and files."""
    h = spark.read.parquet(f"{sf}/history.parquet")
    return h.groupBy("run_id").agg(F.count("*").alias("n_lines"), F.count_distinct("file_seq").alias("n_files"), F.date_format(F.max("written_at"), "yyyy-MM-dd HH:mm:ss").alias("last_written"))


QUERIES = {
    f.__name__: f
    for f in (
        history_fields, history_generation, history_series, latest_eval, history_upsert, history_merge_files, marginal_history, marginal_cases, interim_records, latest_interim, pre_post_pairs,
        chart_points, refine_overlay, headline_fallback, reuse_check, checkpoint_roles, checkpoint_index_dedup, events_tail, status_last_value,
        eval_progress_by_tag, event_counts, baseline_view, list_runs,
    )
}


def _telling(path: str) -> str:
    x, k = f"record->'$.{path}'", f"json_type(record, '$.{path}')"
    none = f"{k} is null or {k} = 'NULL' or cast({x} as varchar) in ('\"\"', '{{}}', '[]', 'false') or ({k} in ('DOUBLE','BIGINT','UBIGINT','HUGEINT') and try_cast(record->>'$.{path}' as double) = 0)"
    return f"case when not ({none}) then {x} end"


_NUMS = "('DOUBLE','BIGINT','UBIGINT','HUGEINT')"


def _acc_sql(x: str) -> str:
    return f"""case when json_type({x}) in {_NUMS} then try_cast({x}->>'$' as double) when json_type({x}) <> 'OBJECT' then null
when json_type({x}, '$.instant') = 'OBJECT' then try_cast({x}->>'$.instant.accuracy' as double)
else coalesce(try_cast({x}->>'$.accuracy' as double), try_cast({x}->>'$.instant_accuracy' as double)) end"""


def _count_sql(x: str, name: str) -> str:
    at = lambda p: f"case when json_type({x}, '$.{p}') in {_NUMS} then floor(try_cast({x}->>'$.{p}' as double)) end"
    return f"case when json_type({x}, '$.instant') = 'OBJECT' then {at('instant.' + name)} else {at(name)} end"


def _blob_sql(*paths: str) -> str:
    return f"coalesce({', '.join(map(_telling, paths))})"


_KEPT = ("a0", "b0", "a1", "b1")
_BLOBS = dict(zip(_KEPT, [_blob_sql(*p) for pair in R.PAIRS for p in pair], strict=True))
_MARGINAL_SQL = f"""with x as (select history_id, run_id, file_seq, line_no, {', '.join(f'{b} as {n}' for n, b in _BLOBS.items())},
 coalesce({_telling('post')}, {_telling('post_eval')}, cast(record as json)) as own from history where {_OK}),
y as (select *, {', '.join(f'{_acc_sql(n)} as acc_{n}' for n in _KEPT)} from x),
z as (select *, case when acc_a0 is not null and acc_b0 is not null then a0 when acc_a1 is not null and acc_b1 is not null then a1 end as pre,
 case when acc_a0 is not null and acc_b0 is not null then b0 when acc_a1 is not null and acc_b1 is not null then b1 end as post from y),
p as (select history_id, coalesce(pre, lag(coalesce(post, own)) over (partition by run_id order by file_seq, line_no, history_id)) as a, coalesce(post, own) as b from z),
q as (select history_id, {_acc_sql('b')} - ({_acc_sql('a')}) as gain, {_count_sql('a', 'correct')} as ca, {_count_sql('a', 'total')} as na,
 {_count_sql('b', 'correct')} as cb, {_count_sql('b', 'total')} as nb from p),
r as (select *, case when gain is not null and na > 0 and nb > 0 then coalesce(sqrt((ca/na)*(1-ca/na)/na + (cb/nb)*(1-cb/nb)/nb), 0.0) else 0.0 end as band from q)
select history_id, round(gain, 9) as gain, round(band, 9) as band, coalesce(gain < greatest(0.005, band), false) as marginal from r"""

SQL = {
    "history_fields": f"with {_H} select * from h",
    "history_generation": f"""with {_H}, s as (select run_id, coalesce(bool_or({_IMP}), false) as any_imported from h group by 1)
select history_id, cast(coalesce(generation, case when {_IMP} then 1 else iteration + case when any_imported then 2 else 1 end end, 1) as bigint) as generation
from h join s on h.run_id is not distinct from s.run_id""",
    "history_series": f"""with {_H} select run_id, string_agg(coalesce(cast(iteration as varchar), '-'), ',' order by ord, iteration, train_pool_size) as iterations,
string_agg(coalesce(cast(train_pool_size as varchar), '-'), ',' order by ord, iteration, train_pool_size) as pool_sizes from h group by 1""",
    "latest_eval": f"""with {_H} select run_id, iteration, heldout_post from (select *, row_number() over (partition by run_id order by ord desc, history_id desc) as rn from h where heldout_post is not null) where rn = 1""",
    "history_upsert": f"""with {_H}, x as (select *, concat(run_id, ':', iteration) as k from h where run_id is not null and iteration is not null)
select k, min(ord) as place, arg_max(history_id, (ord, history_id)) as history_id from x group by 1""",
    "history_merge_files": f"""with {_H}, x as (select *, concat(run_id, ':', iteration) as k from h where run_id is not null and iteration is not null),
n as (select k, arg_max(history_id, ord) as history_id from x where file_seq > 0 group by 1),
b as (select k, arg_min(history_id, ord) as history_id from x where file_seq = 0 group by 1)
select * from n union all select * from b where k not in (select k from n)""",
    "marginal_history": _MARGINAL_SQL,
    "marginal_cases": "select * from (values " + ", ".join(
        f"({c}, {i}, {str(a).lower()}, {str(b).lower()})" for c, (_, marks) in enumerate(MARGINAL) for i, (a, b) in enumerate(marks)
    ) + ") as t(c, i, with_band, without)",
    "interim_records": f"""select history_id, coalesce(record->>'$.kind' in {R.IMPORTED_KINDS}, false) or coalesce(record->>'$.source' in {R.IMPORTED_SOURCES}, false)
 or coalesce(try_cast(record->>'$.iteration' as int) = -1, false) as imported,
coalesce(json_type(record, '$.ci_refine_pending') = 'BOOLEAN' and record->>'$.ci_refine_pending' = 'true', false)
 or coalesce(coalesce(record->>'$.heldout.post.role', case when record->>'$.heldout.post' is null then coalesce(record->>'$.post_heldout.role', record->>'$.post.role') end) in {R.INTERIM_ROLES}, false)
 or (contains(lower(coalesce(record->>'$.note', '')), 'interim') and contains(lower(coalesce(record->>'$.note', '')), 'ci refine')) as interim
from history where {_OK}""",
    "latest_interim": """with i as (select run_id, history_id, row_number() over (partition by run_id order by file_seq desc, line_no desc, history_id desc) as rn
from history join (__interim__) using (history_id) where interim) select run_id, history_id from i where rn = 1""",
    "pre_post_pairs": f"""with {_H} select history_id, heldout_pre, lag(heldout_post) over (partition by run_id order by ord, history_id) as previous_post from h where run_id is not null""",
    "chart_points": f"""with {_H}, p as (select generation, round(avg(heldout_post), 6) as accuracy, count(*) as n from h where generation is not null group by 1),
l as (select generation + 1 as generation, 0 as n from h where generation is not null and heldout_post is null group by 1)
select coalesce(l.generation, p.generation) as generation, p.accuracy, coalesce(l.n, p.n) as n from p full join l on p.generation = l.generation""",
    "refine_overlay": f"""with {_H}, b as (select generation, count(*) as n, max(train_pool_size) as pool from h where generation is not null group by 1),
r as (select generation + 1 as generation, count(*) as n, min(train_pool_size) as pool from h where generation is not null group by 1)
select b.generation, case when r.n >= b.n then r.n else b.n end as n, case when r.n >= b.n then r.pool else b.pool end as pool, coalesce(r.n >= b.n, false) as refined
from b left join r on b.generation = r.generation""",
    "headline_fallback": f"with {_H} select history_id, coalesce(nullif(overfit_gap, 0), heldout_post) as headline, coalesce(overfit_gap, heldout_post) as strict from h",
    "reuse_check": f"""with {_H} select history_id, coalesce(nullif(state_path, '') = lag(nullif(state_path, '')) over (partition by run_id order by ord), false) as reuse from h where run_id is not null""",
    "checkpoint_roles": """with x as (select l_linenumber, row_number() over (partition by l_orderkey order by l_linenumber desc, cast(l_partkey as varchar) desc) as rn,
rank() over (partition by l_orderkey order by l_linenumber desc, cast(l_partkey as varchar) desc) as rk from lineitem)
select l_linenumber, case when rk = 1 then 'finalized' else 'intermediate' end as role, count(*) as n from x group by 1, 2""",
    "checkpoint_index_dedup": """select name, state_path, count(*) as n from (select distinct l_orderkey, nullif(l_returnflag, 'N') as state_path, l_linestatus as name from lineitem) group by 1, 2""",
    "events_tail": "select event_id, event_type, user_id from events order by event_id desc limit 80",
    "status_last_value": """select user_id, arg_max(event_type, (ts, event_id)) filter (where event_type is not null) as event_type,
arg_max(value, (ts, event_id)) filter (where value is not null) as value, arg_max(value, (ts, event_id)) filter (where event_type = 'error' and value is not null) as error_value from events group by 1""",
    "eval_progress_by_tag": """select user_id, event_type, arg_max(cast(json_extract_string(props, '$.k') as bigint), (ts, event_id)) as progress, count(*) as reports from events group by 1, 2""",
    "event_counts": "select strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') as hour, event_type, count(*) as n from events group by 1, 2",
    "baseline_view": f"""with x as (select run_id, row_number() over (partition by run_id order by file_seq, line_no, history_id) as rn, coalesce({_ACC('train_seed.pre')}, {_ACC('pre')}) as baseline
from (select * from history where {_OK}) where run_id is not null) select run_id, baseline from x where rn = 1""",
    "list_runs": "select run_id, count(*) as n_lines, count(distinct file_seq) as n_files, strftime(max(written_at) at time zone 'UTC', '%Y-%m-%d %H:%M:%S') as last_written from history group by 1",
}
SQL["latest_interim"] = SQL["latest_interim"].replace("__interim__", SQL["interim_records"])
