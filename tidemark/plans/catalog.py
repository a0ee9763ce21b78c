"""Registered queries over the driver's tables, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import addresses, codecs
from ..operators import bloom, cache, iterops, lookup, merge, neighbors, ranges
from ..sources import oplog
from ..sources.store import Store
from ..sources.tables import scratch, table
from ..streaming import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

_OPS = """ops AS (
  SELECT event_id AS position, user_id * 1000 + event_id % 7 AS k, CASE WHEN event_type = 'error' THEN 'DELETE' ELSE 'PUT' END AS op, CAST(round(value * 100) AS BIGINT) AS v,
    CASE WHEN ts < TIMESTAMP '2024-01-15' THEN 3 WHEN ts < TIMESTAMP '2024-01-25' THEN 2 WHEN ts < TIMESTAMP '2024-01-30' THEN 1 ELSE 0 END AS gen, ts, user_id, event_type FROM events
), runs AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY gen, k ORDER BY position DESC) AS rn FROM ops) WHERE rn = 1
), state AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY gen, position DESC) AS rn FROM runs) WHERE rn = 1
), live AS (SELECT * FROM state WHERE op = 'PUT'
), probes AS (SELECT DISTINCT c_custkey * 97 % 160000 AS p FROM customer
), req AS (SELECT p AS k FROM probes UNION SELECT k FROM state WHERE k % 2 = 0
), cached AS (SELECT k, v FROM live WHERE k % 3 = 0
), addr AS (SELECT *, position // 1000 AS segment, ((position % 1000) // 16) * 64 AS block, (position % 1000) % 16 AS record FROM ops
), log AS (SELECT *, (segment << 36) + (block << 4) + record AS address FROM addr)
"""


def query(sql: str | None):
    """Register a query under its name, with the rest of its SQL after the shared relations."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = f"WITH {_OPS} {sql}"
        return f

    return register


# Shared relations


def _runs(spark: SparkSession, sf: str) -> DataFrame:
    return merge.runs(oplog.from_events(spark, sf))


def _state(spark: SparkSession, sf: str) -> DataFrame:
    return merge.merged(_runs(spark, sf))


def _live(spark: SparkSession, sf: str) -> DataFrame:
    return merge.live(_state(spark, sf)).select("k", "v")


def _probes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select((F.col("c_custkey") * 97 % 160000).alias("p")).distinct()


def _requested(spark: SparkSession, sf: str) -> DataFrame:
    return _probes(spark, sf).select(F.col("p").alias("k")).union(_state(spark, sf).where("k % 2 = 0").select("k")).distinct()


def _cached(spark: SparkSession, sf: str) -> DataFrame:
    return _live(spark, sf).where("k % 3 = 0")


def _log(spark: SparkSession, sf: str) -> DataFrame:
    return addresses.addressed(oplog.from_events(spark, sf))


# State and generations


@query("SELECT k, v FROM live")
def latest_state(spark: SparkSession, sf: str) -> DataFrame:
    return merge.latest(oplog.from_events(spark, sf)).select("k", "v")


@query("SELECT k, v FROM live")
def state_by_runs(spark: SparkSession, sf: str) -> DataFrame:
    return _live(spark, sf)


@query("SELECT gen, count(*) AS entries, count(*) FILTER (op = 'DELETE') AS tombstones, min(k) AS min_key, max(k) AS max_key, bool_or(op = 'DELETE') AS has_deletions FROM runs GROUP BY gen")
def generation_stats(spark: SparkSession, sf: str) -> DataFrame:
    return merge.generation_stats(_runs(spark, sf))


@query("SELECT k, op, v FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY gen) AS rn FROM runs WHERE gen IN (0, 1)) WHERE rn = 1")
def compact_keep_tombstones(spark: SparkSession, sf: str) -> DataFrame:
    return merge.compacted(_runs(spark, sf), [0, 1], reaches_oldest=False).select("k", "op", "v")


@query("SELECT k, op, v FROM live")
def compact_drop_tombstones(spark: SparkSession, sf: str) -> DataFrame:
    return merge.compacted(_runs(spark, sf), [0, 1, 2, 3], reaches_oldest=True).select("k", "op", "v")


# Lookups


@query("SELECT p, CASE WHEN op IS NULL THEN NULL ELSE op = 'DELETE' END AS is_deleted FROM probes LEFT JOIN state ON k = p")
def tristate_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return lookup.tristate(_state(spark, sf), _probes(spark, sf))


@query("SELECT k, v FROM live WHERE k = (SELECT min(k) FROM live)")
def point_get(spark: SparkSession, sf: str) -> DataFrame:
    first = _live(spark, sf).agg(F.min("k")).first()[0]
    return lookup.get(_state(spark, sf), first).select("k", "v")


@query("SELECT k, v FROM req JOIN live USING (k)")
def multi_get(spark: SparkSession, sf: str) -> DataFrame:
    return lookup.multi_get(_live(spark, sf), _requested(spark, sf))


@query("SELECT k FROM req SEMI JOIN live USING (k)")
def contains(spark: SparkSession, sf: str) -> DataFrame:
    return lookup.hits(_live(spark, sf), _requested(spark, sf))


@query("SELECT k FROM req ANTI JOIN live USING (k)")
def misses(spark: SparkSession, sf: str) -> DataFrame:
    return lookup.misses(_live(spark, sf), _requested(spark, sf))


@query("SELECT k, v FROM req LEFT JOIN live USING (k)")
def get_all_with_nulls(spark: SparkSession, sf: str) -> DataFrame:
    return lookup.get_all(_live(spark, sf), _requested(spark, sf))


# Ranges and order


@query("SELECT k, v FROM live WHERE k >= 20000 AND k < 60003")
def range_slice(spark: SparkSession, sf: str) -> DataFrame:
    return ranges.slice_(_live(spark, sf), 20000, True, 60003, False)


@query("SELECT k, v FROM live WHERE k > 30001 AND k < 60003")
def nested_range(spark: SparkSession, sf: str) -> DataFrame:
    return ranges.slice_(ranges.slice_(_live(spark, sf), 20000, True, 60003, False), 30001, False, 70000, True)


@query("SELECT k, v FROM live WHERE k > 50000 ORDER BY k LIMIT 100")
def page_after(spark: SparkSession, sf: str) -> DataFrame:
    return ranges.page(_live(spark, sf), 50000, 100)


@query("SELECT k, v FROM live WHERE k <= 90000 ORDER BY k DESC LIMIT 50")
def reverse_scan_top(spark: SparkSession, sf: str) -> DataFrame:
    return ranges.scan(_live(spark, sf), reverse=True, start=90000).limit(50)


@query("SELECT min(k) AS first_k, arg_min(v, k) AS first_v, max(k) AS last_k, arg_max(v, k) AS last_v FROM live")
def first_last(spark: SparkSession, sf: str) -> DataFrame:
    return lookup.first_last(_live(spark, sf))


def _neighbor(kind: str, sql: str) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return neighbors.neighbors(_live(spark, sf), _probes(spark, sf), kind)

    run.__name__ = kind
    query(f"SELECT p, {sql} AS found FROM probes LEFT JOIN live ON k {dict(floor='<=', lower='<', ceil='>=', higher='>')[kind]} p GROUP BY p")(run)


for _kind, _sql in (("floor", "max(k)"), ("lower", "max(k)"), ("ceil", "min(k)"), ("higher", "min(k)")):
    _neighbor(_kind, _sql)


@query("SELECT k, gen, v FROM runs WHERE gen IN (0, 1)")
def merge_keep_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    rows = _runs(spark, sf).select("k", "gen", "v")
    return iterops.merge(rows.where("gen = 0"), rows.where("gen = 1"))


@query("SELECT k, v FROM live ORDER BY k")
def ordered_scan(spark: SparkSession, sf: str) -> DataFrame:
    return ranges.scan(_live(spark, sf))


@query("SELECT k, v FROM live WHERE k <= 90000 ORDER BY reverse(k::VARCHAR), k")
def scan_in_own_order(spark: SparkSession, sf: str) -> DataFrame:
    """A scan in an order that the caller gives: by the digits of the key from the last to the first."""
    return ranges.scan(ranges.head(_live(spark, sf), 90000, True), order=F.struct(F.reverse(F.col("k").cast("string")), "k"))


# Sequences


@query("SELECT k, v FROM live WHERE k < coalesce((SELECT min(k) FROM live WHERE v >= 20000), 9223372036854775807)")
def span_prefix(spark: SparkSession, sf: str) -> DataFrame:
    return iterops.span(_live(spark, sf), "k", F.col("v") < 20000)[0]


@query("SELECT k, v FROM live WHERE k >= (SELECT min(k) FROM live WHERE v >= 20000)")
def span_rest(spark: SparkSession, sf: str) -> DataFrame:
    return iterops.span(_live(spark, sf), "k", F.col("v") < 20000)[1]


@query(""", flagged AS (SELECT *, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER (ORDER BY position) THEN 1 ELSE 0 END AS turn FROM ops),
numbered AS (SELECT *, sum(turn) OVER (ORDER BY position) AS run FROM flagged)
SELECT run::BIGINT AS run, any_value(event_type) AS event_type, min(position) AS first, max(position) AS last, count(*) AS n FROM numbered GROUP BY run""")
def adjacent_groups(spark: SparkSession, sf: str) -> DataFrame:
    return iterops.adjacent_groups(oplog.from_events(spark, sf), "position", "event_type")


@query("SELECT chunk, count(*) AS n, min(k) AS min_k, max(k) AS max_k FROM (SELECT k, (row_number() OVER (ORDER BY k) - 1) // 50 AS chunk FROM live) GROUP BY chunk")
def chunks(spark: SparkSession, sf: str) -> DataFrame:
    return iterops.chunks(_live(spark, sf), "k", 50).groupBy("chunk").agg(F.count("*").alias("n"), F.min("k").alias("min_k"), F.max("k").alias("max_k"))


@query(""", placed AS (SELECT row_number() OVER (ORDER BY k) AS n, v FROM live)
SELECT 2 * n - 1 AS place, v FROM placed UNION ALL SELECT 2 * n - 2, -1 FROM placed WHERE n > 1""")
def intersperse(spark: SparkSession, sf: str) -> DataFrame:
    return iterops.interspersed(_live(spark, sf), "k", "v", -1)


@query(""", parts AS (SELECT user_id, position AS v, position AS o FROM ops UNION ALL SELECT user_id, u.v, u.o FROM (SELECT DISTINCT user_id FROM ops), (VALUES (-1, -2), (-2, -1)) u(v, o) WHERE user_id > (SELECT min(user_id) FROM ops))
SELECT row_number() OVER (ORDER BY user_id, o) AS place, v AS value FROM parts""")
def intercalate(spark: SparkSession, sf: str) -> DataFrame:
    return iterops.intercalated_rows(oplog.from_events(spark, sf), "user_id", "position", [-1, -2])


@query(""", placed AS (SELECT row_number() OVER (ORDER BY k) AS n, v FROM live)
SELECT CAST(list_reduce(list_prepend(CAST(0 AS BIGINT), list(v ORDER BY n)), lambda a, x: (a * 31 + x) % 1000003) AS BIGINT) AS fold FROM placed""")
def fold_ordered(spark: SparkSession, sf: str) -> DataFrame:
    return iterops.affine_fold(_live(spark, sf), "k", "v", 31, 1000003)


@query(""", summed AS (SELECT k, v, sum(v) OVER (ORDER BY k) AS total FROM live), half AS (SELECT sum(v) // 2 AS h FROM live)
SELECT k, v, total::BIGINT AS total FROM summed, half WHERE k <= (SELECT min(k) FROM summed, half WHERE total >= h)""")
def process_until_half(spark: SparkSession, sf: str) -> DataFrame:
    """Entries in key order until their values reach half of the sum of all: a fold that stops early."""
    live = _live(spark, sf)
    half = live.agg(F.floor(F.sum("v") / 2)).first()[0] or 0
    return iterops.process(live, "k", F.col("v"), F.lit(half))


# Addresses and logs


@query("SELECT position, address, address >> 36 AS segment, ((address & 68719476735) >> 4) & ~63 AS block, address & 1023 AS record, printf('%03d/%03d/%09d.rec', segment // 1000000, segment // 1000 % 1000, segment) AS path FROM log")
def address_codec(spark: SparkSession, sf: str) -> DataFrame:
    at = F.col("address")
    segment = addresses.segment(at)
    return _log(spark, sf).select("position", "address", segment.alias("segment"), addresses.block(at).alias("block"), addresses.record(at).alias("record"), addresses.segment_path(segment).alias("path"))


@query("SELECT segment, count(*) AS n, min(address) AS low, max(address) AS high FROM log GROUP BY segment")
def segment_stats(spark: SparkSession, sf: str) -> DataFrame:
    return _log(spark, sf).groupBy("segment").agg(F.count("*").alias("n"), F.min("address").alias("low"), F.max("address").alias("high"))


@query("SELECT count(*) AS n, min(position) AS first FROM log WHERE segment >= (SELECT max(segment) // 2 FROM log)")
def gc_survivors(spark: SparkSession, sf: str) -> DataFrame:
    """Segments before the log's middle are deleted from its folder, and what is left is read."""
    folder, ops = scratch(spark, "log"), oplog.from_events(spark, sf)
    ingest.write_segments(ops, folder, 1000)
    last = ops.agg(F.max("position")).first()[0] or 0
    ingest.collected(spark, folder, last // 1000 // 2)
    return spark.read.parquet(folder).agg(F.count("*").alias("n"), F.min("position").alias("first"))


@query("SELECT position, k FROM log WHERE segment < (SELECT max(segment) // 2 FROM log)")
def gap_cutoff(spark: SparkSession, sf: str) -> DataFrame:
    """The log's middle segment is gone; reading ends there."""
    log = _log(spark, sf)
    middle = F.broadcast(log.agg(F.floor(F.max("segment") / 2).alias("middle")))
    return oplog.before_gap(log.crossJoin(middle).where("segment <> middle").drop("middle")).select("position", "k")


@query("SELECT position, k FROM log WHERE position < (SELECT min(position) FROM log WHERE position >= (SELECT max(position) * 9 // 10 FROM log))")
def corrupt_cutoff(spark: SparkSession, sf: str) -> DataFrame:
    """A record at nine tenths of the log doesn't have the checksum that was kept; reading ends before it."""
    log = _log(spark, sf).withColumn("payload", F.concat_ws(":", F.col("k").cast("string"), F.col("v").cast("string")))
    at = F.broadcast(log.agg(F.floor(F.max("position") * 9 / 10).alias("at")))
    kept = log.crossJoin(at).withColumn("crc", codecs.record_crc(F.concat("payload", F.when(F.col("position") >= F.col("at"), "!").otherwise(""))))
    return oplog.before_first(kept, F.col("crc") != codecs.record_crc(F.col("payload"))).select("position", "k")


@query("SELECT position, k FROM log WHERE address >= (SELECT min(address) FROM log WHERE position >= (SELECT max(position) // 2 FROM log))")
def read_from_address(spark: SparkSession, sf: str) -> DataFrame:
    """From the address of the middle position on, through all segments."""
    log = _log(spark, sf)
    middle = log.agg(F.floor(F.max("position") / 2)).first()[0] or 0
    start = log.where(F.col("position") >= middle).agg(F.min("address")).first()[0]
    return log.where(F.col("address") >= F.lit(start)).select("position", "k").orderBy("address")


@query("SELECT l.k, s.address, l.v FROM (SELECT k, address FROM live JOIN log USING (k, position)) s JOIN log l USING (address) WHERE l.k = s.k")
def indirect_lookup(spark: SparkSession, sf: str) -> DataFrame:
    log = _log(spark, sf)
    index = merge.latest(oplog.from_events(spark, sf)).select("k", "position")
    return lookup.indirect(addresses.addressed(index).select("k", "address"), log.select("address", "k", "v"))


@query(""", idx AS (SELECT k, segment, min(address) AS address FROM log WHERE op = 'PUT' GROUP BY k, segment), last AS (SELECT k, segment, max(address) AS "right" FROM log WHERE op = 'PUT' GROUP BY k, segment)
SELECT k, segment, address, "right" FROM idx JOIN last USING (k, segment) WHERE address <> "right\"""")
def reindex_repair(spark: SparkSession, sf: str) -> DataFrame:
    log = _log(spark, sf)
    index = log.where("op = 'PUT'").groupBy("k", "segment").agg(F.min("address").alias("address"))
    return lookup.reindexed(index, log)


@query("SELECT k, CASE WHEN l.address IS NOT NULL THEN l.v END AS v, CASE WHEN l.address IS NULL THEN 'missing' END AS error FROM req LEFT JOIN (SELECT k, address, v FROM live JOIN (SELECT k, position, address FROM log) USING (k, position)) l USING (k)")
def streamed_lookup(spark: SparkSession, sf: str) -> DataFrame:
    index = addresses.addressed(merge.latest(oplog.from_events(spark, sf)).select("k", "position")).select("k", "address")
    return lookup.streamed(index, _log(spark, sf).select("address", "k", "v"), _requested(spark, sf))


# Caches


@query("SELECT k, CASE WHEN c.k IS NOT NULL THEN c.v ELSE l.v END AS v, CASE WHEN c.k IS NOT NULL THEN 'cache' WHEN l.k IS NOT NULL THEN 'store' ELSE 'miss' END AS source FROM req r LEFT JOIN cached c USING (k) LEFT JOIN live l USING (k)")
def read_through(spark: SparkSession, sf: str) -> DataFrame:
    return cache.read_through(_requested(spark, sf), _cached(spark, sf), _live(spark, sf))


@query("SELECT k, v FROM req ANTI JOIN cached USING (k) JOIN live USING (k)")
def prime_plan(spark: SparkSession, sf: str) -> DataFrame:
    return cache.prime_plan(_requested(spark, sf), _cached(spark, sf), _live(spark, sf))


@query("SELECT k, v FROM cached UNION ALL SELECT k, v FROM req JOIN live USING (k) WHERE k NOT IN (SELECT k FROM cached)")
def cache_written_back(spark: SparkSession, sf: str) -> DataFrame:
    return cache.written_back(cache.read_through(_requested(spark, sf), _cached(spark, sf), _live(spark, sf)), _cached(spark, sf))


@query("SELECT count(*) AS requested, count(c.k) AS cache_hits, count(l.k) - count(c.k) AS store_hits, count(*) - count(l.k) AS misses FROM req r LEFT JOIN cached c USING (k) LEFT JOIN live l USING (k)")
def cache_stats(spark: SparkSession, sf: str) -> DataFrame:
    return cache.stats(cache.read_through(_requested(spark, sf), _cached(spark, sf), _live(spark, sf)))


@query("SELECT user_id, count(*) AS n FROM events WHERE event_type = 'purchase' OR ts + INTERVAL 6 HOUR > TIMESTAMP '2024-01-30' GROUP BY user_id")
def ttl_live(spark: SparkSession, sf: str) -> DataFrame:
    """Purchases are set, which has no end; all else is added, and ends after six hours."""
    rows = cache.alive(table(spark, sf, "events"), "ts", 6, F.lit("2024-01-30").cast("timestamp_ntz"), F.col("event_type") == "purchase")
    return rows.groupBy("user_id").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS requested, count(c.k) AS skipped, count(l.k) - count(c.k) AS primed, count(*) - count(l.k) AS missing FROM req r LEFT JOIN cached c USING (k) LEFT JOIN live l USING (k)")
def prime_status(spark: SparkSession, sf: str) -> DataFrame:
    return _primed(spark, sf)[1]


@query("SELECT k, v FROM cached UNION SELECT k, v FROM req JOIN live USING (k)")
def primed_cache(spark: SparkSession, sf: str) -> DataFrame:
    """A cache on disk after it was primed with the requested keys."""
    return _primed(spark, sf)[0].view()


def _primed(spark: SparkSession, sf: str) -> tuple[Store, DataFrame]:
    with _store(spark, "cache") as store:
        store.commit(_cached(spark, sf).select(F.lit(0).cast("long").alias("position"), "k", F.lit("PUT").alias("op"), "v"))
        return store, cache.primed(_requested(spark, sf), store, _live(spark, sf))


@query("SELECT count(*) AS asked, count(l.k) AS found, count(*) - count(l.k) AS missing, 0::BIGINT AS wrong_key FROM req LEFT JOIN live l USING (k)")
def streamed_counts(spark: SparkSession, sf: str) -> DataFrame:
    return lookup.skipping(streamed_lookup(spark, sf))


# Checkpoints


@query(""", cps AS (SELECT share, (SELECT max(position) + 1 FROM ops) * share // 10 AS checkpoint FROM (SELECT unnest([2, 5, 9]) AS share)), st AS (SELECT share, k, op, v, row_number() OVER (PARTITION BY share, k ORDER BY position DESC) AS rn FROM cps JOIN ops ON position < checkpoint)
SELECT share::BIGINT AS share, count(*) FILTER (op = 'PUT') AS live, count(*) FILTER (op = 'DELETE') AS deleted FROM st WHERE rn = 1 GROUP BY share""")
def checkpoint_counts(spark: SparkSession, sf: str) -> DataFrame:
    """The state at two, five and nine tenths of the log."""
    ops = oplog.from_events(spark, sf)
    size = (ops.agg(F.max("position")).first()[0] or 0) + 1
    rows = oplog.checkpointed(ops, [size * share // 10 for share in (2, 5, 9)])
    state = merge.newest(rows, ["checkpoint", "k"], F.desc("position"))
    share = F.element_at(F.create_map(*(F.lit(x).cast("long") for share in (9, 5, 2) for x in (size * share // 10, share))), F.col("checkpoint"))
    return state.groupBy(share.alias("share")).agg(F.count_if(F.col("op") == "PUT").alias("live"), F.count_if(F.col("op") == "DELETE").alias("deleted"))


@query(""", a AS (SELECT k, v FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY position DESC) AS rn FROM ops WHERE position < (SELECT (max(position) + 1) * 9 // 10 FROM ops)) WHERE rn = 1 AND op = 'PUT')
SELECT k, a.v AS before, b.v AS after FROM a FULL JOIN (SELECT k, v FROM live) b USING (k) WHERE a.v IS DISTINCT FROM b.v""")
def checkpoint_diff(spark: SparkSession, sf: str) -> DataFrame:
    """Keys whose value at nine tenths of the log differs from the one now, in either direction."""
    ops = oplog.from_events(spark, sf)
    cut = ((ops.agg(F.max("position")).first()[0] or 0) + 1) * 9 // 10
    before = merge.latest(ops.where(F.col("position") < cut)).select("k", F.col("v").alias("before"))
    return before.join(_live(spark, sf).select("k", F.col("v").alias("after")), "k", "full").where(~F.col("before").eqNullSafe(F.col("after")))


@query("SELECT date_trunc('minute', ts) AS minute, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1")
def minute_counts(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.minute_counts(table(spark, sf, "events").where("event_type = 'error'"))


# Codecs and tools


@query("SELECT min(position) OVER (PARTITION BY position // 100) AS position, k FROM (SELECT DISTINCT k, first AS position FROM (SELECT k, min(position) OVER (PARTITION BY position // 100) AS first, position FROM ops WHERE op = 'DELETE'))")
def batch_delete_explode(spark: SparkSession, sf: str) -> DataFrame:
    batches = oplog.batch_deletes(oplog.from_events(spark, sf))
    return oplog.exploded(batches.select("position", "keys", F.lit(None).cast("long").alias("k"))).select("position", "k")


@query("SELECT user_id, event_id, event_id - coalesce(lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id), 0) AS delta FROM events")
def delta_encode(spark: SparkSession, sf: str) -> DataFrame:
    """The ids of each user's events as differences, a row each, so that a user may have any number."""
    return iterops.deltas(table(spark, sf, "events"), "user_id", "event_id")


@query("SELECT user_id, event_id AS decoded FROM events")
def delta_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Those differences summed up again, in the order of user and event."""
    coded = iterops.deltas(table(spark, sf, "events"), "user_id", "event_id").withColumn("key", F.struct("user_id", "event_id"))
    return iterops.undeltas(coded.drop("event_id"), "key", "user_id", "delta", "decoded").select("user_id", "decoded")


@query("SELECT k, 'u:' || k AS text, k AS parsed FROM live")
def key_texts(spark: SparkSession, sf: str) -> DataFrame:
    text = codecs.key_text(F.col("k"), "u:")
    return _live(spark, sf).select("k", text.alias("text"), codecs.text_key(text, "u:").alias("parsed"))


@query("SELECT position, strftime(ts, '%Y-%m-%d %H:%M:%S') AS text FROM ops")
def epoch_texts(spark: SparkSession, sf: str) -> DataFrame:
    millis = F.unix_millis(F.to_timestamp(F.concat(F.col("ts").cast("string"), F.lit("Z"))))
    return oplog.from_events(spark, sf).select("position", codecs.epoch_text(millis).alias("text"))


@query("SELECT date_trunc('day', ts)::DATE AS day, count(*) AS n FROM ops GROUP BY 1")
def segments_by_day(spark: SparkSession, sf: str) -> DataFrame:
    """A log rolled by time: as many segments as days with operations, read back in order."""
    folder, ops = scratch(spark, "log"), oplog.from_events(spark, sf)
    ingest.roll_by_time(ops, folder)
    log = oplog.before_gap(spark.read.parquet(folder))
    return log.join(ops.select("position", "ts"), "position").groupBy("segment").agg(F.min("ts").cast("date").alias("day"), F.count("*").alias("n")).select("day", "n")


@query("""SELECT '{"key":' || k || ',"value":' || v || '}' AS line FROM live""")
def store_cat_json(spark: SparkSession, sf: str) -> DataFrame:
    return _live(spark, sf).select(codecs.entry_json(F.col("k"), F.col("v")).alias("line"))


@query("""SELECT '{"position":' || position || ',"type":"' || lower(op) || '","key":' || k || CASE WHEN op = 'PUT' THEN ',"value":' || v ELSE '' END || '}' AS line FROM ops""")
def oplog_cat_json(spark: SparkSession, sf: str) -> DataFrame:
    return oplog.from_events(spark, sf).select(codecs.operation_json().alias("line"))


@query("""SELECT md5(string_agg(d, ',' ORDER BY s)) AS md5 FROM (SELECT n // 4096 AS s, md5(string_agg(k || ':' || v, ',' ORDER BY k)) AS d FROM (SELECT k, v, row_number() OVER (ORDER BY k) - 1 AS n FROM live) GROUP BY s)""")
def store_md5(spark: SparkSession, sf: str) -> DataFrame:
    return codecs.digest(_live(spark, sf), "k", "v")


@query(None)
def record_crc(spark: SparkSession, sf: str) -> DataFrame:
    return oplog.from_events(spark, sf).select("position", codecs.record_crc(F.concat_ws(":", F.col("k").cast("string"), F.col("v").cast("string"))).alias("crc"))


@query("SELECT count(*) AS n, 0::BIGINT AS rejected FROM live")
def bloom_no_false_negative(spark: SparkSession, sf: str) -> DataFrame:
    live = _live(spark, sf).select("k")
    return bloom.maybe(live, bloom.built(live)).agg(F.count("*").alias("n"), F.count_if(~F.col("maybe")).alias("rejected"))


# Stores and streams: what is read back is the latest state


def _store(spark: SparkSession, name: str) -> Store:
    return Store(spark, scratch(spark, name))


@query("SELECT k, v FROM live")
def store_commits_compacted(spark: SparkSession, sf: str) -> DataFrame:
    """Each generation is committed, oldest first, then size-tiered and full compaction fold them."""
    ops = oplog.from_events(spark, sf)
    with _store(spark, "store") as store:
        for gen in (3, 2, 1, 0):
            store.commit(ops.where(F.col("gen") == gen))
            store.compact()
        store.compact(everything=True)
        store.vacuum()
        return store.view()


@query("SELECT k, v FROM live WHERE k >= 20000 AND k <= 60003")
def store_range_scan(spark: SparkSession, sf: str) -> DataFrame:
    ops = oplog.from_events(spark, sf)
    with _store(spark, "store") as store:
        store.commit(ops.where("gen >= 2"))
        store.commit(ops.where("gen < 2"))
        return store.view(20000, 60003)


@query("SELECT k, v FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY position DESC) AS rn FROM ops WHERE gen >= 2) WHERE rn = 1 AND op = 'PUT'")
def store_checkpoint_read(spark: SparkSession, sf: str) -> DataFrame:
    ops = oplog.from_events(spark, sf)
    with _store(spark, "store") as store:
        store.commit(ops.where("gen >= 2"))
        store.checkpoint("before")
        store.commit(ops.where("gen < 2"))
        store.compact(everything=True)
        store.vacuum()
        return store.view(checkpoint="before")


@query("SELECT k, v FROM live")
def stream_ingested(spark: SparkSession, sf: str) -> DataFrame:
    """The log as segment files, tailed by a stream into a store in batches of files; a second run adds nothing."""
    folder, ops = scratch(spark, "log"), oplog.from_events(spark, sf)
    total = ops.agg(F.max("position")).first()[0] or 0
    rows = max(1, min(1 << 20, -(-(total + 1) // 4)))  # of a segment: bounded, so that tasks are
    ingest.write_segments(ops, folder, rows)
    marks = scratch(spark, "stream")
    with _store(spark, "store") as store:
        for _ in range(2):
            ingest.ingest(ingest.tail(spark, folder, max(2, total // rows // 8)), [store], marks).awaitTermination()
        return store.view()
