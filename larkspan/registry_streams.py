"""Streams with state, the standing refresh, and tables that are written in place, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from .registry import query
from .sources import adapters as src
from .sources import files, tables
from .streaming import ordered, refresh

#: Days by which the events below come late at most, and landings that they come in.
LATE_DAYS, LANDINGS = 5, 3
#: Events of a bucket of users and of a partition of the state, about.
BUCKET_ROWS, PARTITION_ROWS = 20_000, 3_000_000


def _streamed(spark, d, rule, label):
    """The rows that ``rule`` makes of the events' stream: they land out of order, each landing worked off by a run that starts from the checkpoint of the one before.

    A last event of nobody, long after all others, lets the watermark pass them.
    """
    events = src.read(spark, d, "events").select("event_id", "ts", "user_id", "event_type")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    arrival = micros + F.col("event_id") * 7919 % (LATE_DAYS + 1) * 86_400_000_000
    low, high, last, rows = events.agg(F.min(arrival), F.max(arrival), F.max("ts"), F.count(F.lit(1))).first()
    cores = spark.sparkContext.defaultParallelism
    buckets, partitions = max(16 * cores, rows // BUCKET_ROWS), max(cores, rows // PARTITION_ROWS)
    part = F.floor((arrival - low) * LANDINGS / ((high or 0) - (low or 0) + 1))
    home = files.fresh_path(spark, label)
    closing = spark.range(1).select(F.lit(-1).cast("long").alias("event_id"), (F.lit(last) + F.expr("interval 70 days")).alias("ts"), F.lit(-1).cast("long").alias("user_id"), F.lit("none").alias("event_type"))
    for n in range(LANDINGS):
        landed = events.where(part == n)
        (landed if n < LANDINGS - 1 else landed.union(closing)).write.mode("append").parquet(f"{home}/landing")
        stream = spark.readStream.schema(events.schema).parquet(f"{home}/landing")
        ordered.run_to_end(rule(stream, buckets), f"{home}/told", f"{home}/checkpoint", **{"spark.sql.shuffle.partitions": str(partitions)})
    return spark.read.parquet(f"{home}/told").where("user_id >= 0")


@query("""m AS (SELECT *, row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id) <= 1 AS by_day FROM events),
a AS (SELECT *, by_day AND sum(by_day::INT) OVER (PARTITION BY user_id, strftime(ts, '%Y-%m') ORDER BY ts, event_id) <= 4 AS by_both FROM m)
SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, by_both AS admitted, CASE WHEN NOT by_day THEN 'day' WHEN NOT by_both THEN 'month' END AS refused_by FROM a""")
def stm1_budget_stream(spark, d):
    """One call a day and four a month, on a stream with state: every call with its answer, as over the whole table at once."""
    return _streamed(spark, d, lambda s, n: ordered.stream_budget(s, 1, 4, f"{LATE_DAYS + 1} days", n), "budget").select("event_id", "day", "admitted", "refused_by")


@query("""w AS (SELECT event_id, user_id, event_type, ts, max(CASE WHEN event_type = 'purchase' THEN ts END) OVER l AS ok, max(CASE WHEN event_type = 'error' THEN ts END) OVER l AS bad FROM events WINDOW l AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, CASE WHEN ok IS NULL THEN 'missing' WHEN epoch_us(ts) - epoch_us(ok) <= 86400000000 THEN 'current' WHEN epoch_us(ts) - epoch_us(ok) <= 604800000000 THEN 'stale' ELSE 'frozen' END AS state FROM w WHERE event_type = 'view')
SELECT event_id, state, state <> 'current' AND coalesce(epoch_us(ts) - epoch_us(bad) >= 86400000000, true) AS fetches FROM s""")
def stm3_state_stream(spark, d):
    """The cache's state at every ask, on a stream with state: fresh for a day, kept for a week, a day's cooldown."""
    rule = lambda s, n: ordered.stream_table_state(s, "purchase", "error", "view", 86_400, 604_800, 86_400, f"{LATE_DAYS + 1} days", n)
    return _streamed(spark, d, rule, "table-state").select("event_id", "state", "fetches")


_RELEASES = (("2025-01-15.0", 3, 0), ("2025-02-19.0", 5, 7), ("2025-02-19.0", 5, 7), ("2025-01-01.0", 2, 1), ("2025-03-19.0", 4, 11))

_LANDED = " UNION ALL ".join(
    f"SELECT {turn} AS turn, '{name}' AS release, opis_id, price_milli + CASE WHEN opis_id % {step} = 0 THEN {plus} ELSE 0 END AS p FROM v_station WHERE opis_id % {step + 4} <> 1" for turn, (name, step, plus) in enumerate(_RELEASES)
)


def _twin() -> str:
    """The turns one after another: each holds its release against the prices known before it."""
    out, known = [f"l AS MATERIALIZED ({_LANDED}), k0 AS (SELECT NULL::INT AS opis_id, NULL::BIGINT AS p WHERE false)"], "k0"
    newest, told = "", []
    for n, (name, _, _) in enumerate(_RELEASES):
        if name < newest:
            told.append(f"SELECT {n}::BIGINT AS turn, release, 'outdated' AS change, p FROM l WHERE turn = {n}")
            continue
        newest = name
        out.append(f"x{n} AS (SELECT coalesce(a.opis_id, b.opis_id) AS opis_id, coalesce(b.p, a.p) AS p, CASE WHEN a.opis_id IS NULL THEN 'created' WHEN b.opis_id IS NULL THEN 'untouched' WHEN a.p = b.p THEN 'unchanged' ELSE 'updated' END AS change FROM {known} a FULL JOIN (SELECT * FROM l WHERE turn = {n}) b ON a.opis_id = b.opis_id)")
        told.append(f"SELECT {n}::BIGINT AS turn, '{name}' AS release, change, p FROM x{n}")
        known = f"x{n}"
    return ", ".join(out) + f" SELECT turn, release, change, count(*) AS stations, sum(p)::BIGINT AS total_milli FROM ({' UNION ALL '.join(told)}) GROUP BY ALL"


@query(_twin())
def stm5_standing_refresh(spark, d):
    """Releases land one by one, one of them twice and one too late; each turn of the loop starts from the checkpoint and tells what it changed."""
    home, k, s = files.fresh_path(spark, "refresh"), F.col("opis_id"), src.stations(spark, d)
    for name, step, plus in _RELEASES:
        price = F.col("price_milli") + F.when(k % step == 0, plus).otherwise(0)
        s.where(k % (step + 4) != 1).select("opis_id", price.alias("price_milli"), F.lit(name).alias("release")).write.mode("append").partitionBy("release").parquet(f"{home}/landing")
        refresh.work_off(spark, f"{home}/landing", home)
    told = refresh.differences(spark, home)
    return told.groupBy("turn", "release", "change").agg(F.count(F.lit(1)).alias("stations"), F.sum("price_milli").alias("total_milli"))


# --- tables written in place

_TABLE = "opis_id int, price_milli long, price_source string"
_FILES = """f AS (SELECT opis_id, 1 AS file_no, price_milli + CASE WHEN opis_id % 6 = 0 THEN 5 ELSE 0 END AS p FROM v_station WHERE opis_id % 4 = 2 UNION ALL SELECT opis_id + 1000000, 1, price_milli FROM v_station WHERE opis_id % 64 = 5 UNION ALL SELECT opis_id, 2, price_milli FROM v_station WHERE opis_id % 18 = 0),
n AS (SELECT opis_id, arg_max(p, file_no) AS p FROM f GROUP BY opis_id),
c AS (SELECT coalesce(n.opis_id, s.opis_id) AS opis_id, coalesce(n.p, s.price_milli) AS p, coalesce(n.opis_id, s.opis_id) % 16 AS folder, CASE WHEN s.opis_id IS NULL THEN 'created' WHEN n.opis_id IS NULL THEN 'untouched' WHEN s.price_milli = n.p THEN 'unchanged' ELSE 'updated' END AS change FROM v_station s FULL JOIN n ON s.opis_id = n.opis_id)"""


def _landed_files(s):
    k, price = F.col("opis_id"), F.col("price_milli")
    row = lambda rows, key, no, p: rows.select(key.cast("int").alias("opis_id"), F.lit(no).alias("file_no"), p.alias("price_milli"), "price_source", key.alias("line_no"))
    return row(s.where(k % 4 == 2), k, 1, price + F.when(k % 6 == 0, 5).otherwise(0)).union(row(s.where(k % 64 == 5), k + 1_000_000, 1, price)).union(row(s.where(k % 18 == 0), k, 2, price))


@query(_FILES + """, t AS (SELECT DISTINCT folder FROM c WHERE change IN ('created', 'updated')), w AS (SELECT count(*) AS rows_left, sum(p)::BIGINT AS total_milli, count(DISTINCT folder) AS folders FROM c)
SELECT 1 AS run, change, count(*) AS stations, (SELECT count(*) FROM t) AS folders_written, folders - (SELECT count(*) FROM t) AS folders_kept, rows_left, total_milli FROM c, w GROUP BY change, folders, rows_left, total_milli
UNION ALL SELECT 2, CASE change WHEN 'untouched' THEN 'untouched' ELSE 'unchanged' END, count(*), 0, folders, rows_left, total_milli FROM c, w GROUP BY 2, folders, rows_left, total_milli""")
def snk4_written_upsert(spark, d):
    """Two runs of the same files on a table on disk: what each changed, whose folders were written (told by their files) and what the table holds after."""
    s, path, out = src.stations(spark, d), files.fresh_path(spark, "stations"), None
    tables.create(s.select("opis_id", "price_milli"), path)
    shape = "opis_id int, price_milli long"
    for run in (1, 2):
        before = files.written(tables.file_times(spark, path, shape), "file-times")
        plan = tables.upsert(spark, path, shape, _landed_files(s).drop("price_source"), "price_milli")
        after = files.written(tables.file_times(spark, path, shape), "file-times")
        stayed = after.join(before, ["file", "modified", "folder"], "left_semi").agg(F.countDistinct("folder").alias("folders_kept"))
        new = after.join(before, ["file", "modified", "folder"], "left_anti").agg(F.countDistinct("folder").alias("folders_written"))
        holds = files.written(tables.read(spark, path, shape), "table-after").agg(F.count(F.lit(1)).alias("rows_left"), F.sum("price_milli").alias("total_milli"))
        one_row = new.crossJoin(stayed).crossJoin(holds)
        told = plan.groupBy("change").agg(F.count(F.lit(1)).alias("stations")).crossJoin(F.broadcast(one_row)).withColumn("run", F.lit(run))
        out = told if out is None else out.union(told)
    return out.select("run", "change", "stations", "folders_written", "folders_kept", "rows_left", "total_milli")


@query("""b AS (SELECT count(*) AS before, count(*) FILTER (price_source = 'eia_regional_estimate') AS deleted, sum(price_milli)::BIGINT AS every, sum(CASE WHEN price_source <> 'eia_regional_estimate' THEN price_milli END)::BIGINT AS rest FROM v_station)
SELECT 1 AS step, true AS dry_run, before, deleted, before - deleted AS after, before AS rows_left, every AS total_milli FROM b UNION ALL SELECT 2, false, before, deleted, before - deleted, before - deleted, rest FROM b UNION ALL SELECT 3, false, before - deleted, 0, before - deleted, before - deleted, rest FROM b""")
def snk6_purged(spark, d):
    """A purge by source on a table on disk: a dry run, which deletes nothing, then two real ones."""
    path, out = files.fresh_path(spark, "stations"), None
    tables.create(src.stations(spark, d).select("opis_id", "price_milli", "price_source"), path)
    for step, dry in enumerate((True, False, False), 1):
        told = tables.purge(spark, path, _TABLE, "eia_regional_estimate", dry)
        holds = files.written(tables.read(spark, path, _TABLE), "table-after").agg(F.count(F.lit(1)).alias("rows_left"), F.sum("price_milli").alias("total_milli"))
        row = told.crossJoin(holds).withColumn("step", F.lit(step)).withColumn("dry_run", F.lit(dry))
        out = row if out is None else out.union(row)
    return out.select("step", "dry_run", "before", "deleted", "after", "rows_left", "total_milli")
