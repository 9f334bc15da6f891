"""The driver's queries over the library's own operators, each with the same result in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.api import Emberlog
from emberlog.config import Config
from emberlog.functions.terms import is_term
from emberlog.functions.times import micros
from emberlog.operators import catalogue as cat
from emberlog.operators import digest as dig
from emberlog.operators import search
from emberlog.plans import logsql
from emberlog.plans.filters import ALIASES, LogFilter
from emberlog.session import scratch
from emberlog.sources import ndjson, transfer
from emberlog.sources.model import conversations_view, documents_view, events_view
from emberlog.sources.store import LogStore
from emberlog.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
#: The driver's events span 2024-01-01 to 2024-01-30; these cut out parts of it.
FROM, UNTIL, NOW = 1_704_240_000_000_000, 1_705_104_000_000_000, 1_706_572_800_000_000
BLOCK = 500
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_view(table(spark, sf_dir, "events"))


LOGS = """WITH logs AS (SELECT event_id, epoch_us(ts) AS timestamp_us,
  CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'warning' WHEN 'view' THEN 'debug' ELSE 'info' END AS level,
  event_type || ' by user ' || CAST(user_id AS VARCHAR) AS message, json_extract_string(props, '$.k') AS k,
  event_type AS service, 'web-' || CAST(user_id % 5 AS VARCHAR) AS host, CAST(event_id AS VARCHAR) AS request_id FROM events)"""
BLOCKS = LOGS + f""", placed AS (SELECT *, (row_number() OVER (ORDER BY timestamp_us, event_id) - 1) // {BLOCK} AS block FROM logs),
 manifest AS (SELECT block, count(*) AS entry_count, min(timestamp_us) AS ts_min, max(timestamp_us) AS ts_max, sum(length(message)) AS byte_size FROM placed GROUP BY block),
 terms AS (SELECT block, term, count(*) AS entry_count FROM (SELECT block, 'level:' || level AS term FROM placed UNION ALL SELECT block, 'service:' || service FROM placed UNION ALL SELECT block, 'host:' || host FROM placed) GROUP BY ALL)"""
SHOWN = ["event_id", "timestamp_us", "level", "message"]


def query(sql: str | None):
    """Registers a query under its function's name, with its SQL."""

    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cat.blocks(logs(spark, sf_dir), BLOCK, "timestamp_us", "event_id")


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cat.manifest(placed(spark, sf_dir), "block", F.sum(F.length("message")).alias("byte_size"))


# filters and pages


@query(LOGS + " SELECT event_id, timestamp_us, level, message FROM logs WHERE level = 'error' ORDER BY timestamp_us DESC, message, event_id LIMIT 100")
def level_eq(spark, sf_dir):
    return search.rows(logs(spark, sf_dir), LogFilter.of(level="error"), tie=("event_id",)).select(*SHOWN)


@query(LOGS + " SELECT event_id, timestamp_us, level, message FROM logs WHERE level = 'info' ORDER BY timestamp_us, message, event_id LIMIT 50 OFFSET 100")
def page_asc(spark, sf_dir):
    return search.rows(logs(spark, sf_dir), LogFilter.of(level="info"), True, 50, 100, ("event_id",)).select(*SHOWN)


@query(LOGS + f" SELECT event_id, timestamp_us, level, message FROM logs WHERE timestamp_us >= {FROM} AND timestamp_us <= {UNTIL}")
def time_range(spark, sf_dir):
    return LogFilter.of(since=FROM, until=UNTIL).apply(logs(spark, sf_dir)).select(*SHOWN)


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'the')")
def message_contains(spark, sf_dir):
    return LogFilter.of(message="THE").apply(documents_view(table(spark, sf_dir, "documents"))).select("doc_id")


@query("SELECT doc_id, md5(lower(text)) AS low FROM documents")
def message_lower(spark, sf_dir):
    return documents_view(table(spark, sf_dir, "documents")).select("doc_id", F.md5(F.lower("message").cast("binary")).alias("low"))


@query("SELECT conv_id, turn FROM conversations WHERE role = 'user' AND contains(lower(text), 'th')")
def conversation_search(spark, sf_dir):
    return LogFilter.of(message="th", metadata={"role": "user"}).apply(conversations_view(table(spark, sf_dir, "conversations"))).select("conv_id", "turn")


@query(LOGS + " SELECT event_id FROM logs WHERE k = '7' AND service = 'click'")
def metadata_exact(spark, sf_dir):
    return LogFilter.of(metadata={"k": 7, "service": "click"}).apply(logs(spark, sf_dir)).select("event_id")


@query(LOGS + " SELECT count(*) AS total FROM logs")
def metadata_missing_empty(spark, sf_dir):
    return search.totals(logs(spark, sf_dir), LogFilter.of(metadata={"no_such_key": ""}))


@query(LOGS + " SELECT event_id FROM logs WHERE host = 'web-3'")
def host_alias(spark, sf_dir):
    return LogFilter.of(metadata={"host": "web-3"}).apply(logs(spark, sf_dir)).select("event_id")


@query(LOGS + " SELECT event_id FROM logs WHERE service = 'purchase' AND host = 'web-1'")
def service_alias(spark, sf_dir):
    return LogFilter.of(metadata={"service": "purchase", "host": "web-1"}).apply(logs(spark, sf_dir)).select("event_id")


@query(LOGS + f" SELECT event_id, timestamp_us, level, message FROM logs WHERE level = 'info' AND contains(lower(message), 'click') AND host = 'web-2' AND timestamp_us BETWEEN {FROM} AND {UNTIL}")
def combined(spark, sf_dir):
    return LogFilter.of("info", "CLICK", FROM, UNTIL, {"host": "web-2"}).apply(logs(spark, sf_dir)).select(*SHOWN)


@query("SELECT x AS value, CASE WHEN abs(x) < 100000000000 THEN x * 1000000 WHEN abs(x) < 100000000000000 THEN x * 1000 WHEN abs(x) < 100000000000000000 THEN x ELSE x // 1000 END AS us FROM (SELECT epoch_s * m AS x FROM (SELECT epoch_us(ts) // 1000000 AS epoch_s FROM events) CROSS JOIN (VALUES (1), (1000), (1000000), (1000000000)) t(m))")
def unit_normalize(spark, sf_dir):
    """All four units of every event's second come out as the same microsecond."""
    s = logs(spark, sf_dir).select(F.floor(F.col("timestamp_us") / 1_000_000).cast("long").alias("s"))
    x = s.select(F.explode(F.array(*[F.col("s") * m for m in (1, 1000, 10**6, 10**9)])).alias("value"))
    return x.select("value", micros(F.col("value")).alias("us"))


# LogsQL


@query(LOGS + " SELECT event_id, timestamp_us, level, message FROM logs WHERE level = 'error' AND contains(lower(message), 'by user') AND service = 'error' AND timestamp_us >= 1704240000000000 ORDER BY timestamp_us, message, event_id LIMIT 40 OFFSET 20")
def logsql_query(spark, sf_dir):
    q = logsql.parse('level:error "by user" service:error _time:>=2024-01-03T00:00:00Z | sort by (_time) asc | limit 40 | offset 20')
    return search.rows(logs(spark, sf_dir), q.where, q.ascending, q.limit, q.offset, ("event_id",)).select(*SHOWN)


def _logsql(text: str) -> Query:
    def run(spark, sf_dir):
        q = logsql.parse(text, now=NOW)
        if q.count:
            return search.totals(logs(spark, sf_dir), q.where)
        return search.rows(logs(spark, sf_dir), q.where, q.ascending, q.limit, q.offset, ("event_id",)).select(*SHOWN)

    return run


_AGO = lambda seconds: NOW - seconds * 1_000_000
_LATEST = " ORDER BY timestamp_us DESC, message, event_id"
#: The five kinds of request that a log viewer makes, with the clock stopped at NOW.
for _name, _text, _sql in (
    ("logsql_errors", "_time:1d level:error | limit 100", f"level = 'error' AND timestamp_us >= {_AGO(86400)}{_LATEST} LIMIT 100"),
    ("logsql_service", "_time:2d service:signup | limit 100", f"service = 'signup' AND timestamp_us >= {_AGO(172800)}{_LATEST} LIMIT 100"),
    ("logsql_text", '_time:12h "purchase" | limit 50', f"contains(lower(message), 'purchase') AND timestamp_us >= {_AGO(43200)}{_LATEST} LIMIT 50"),
    ("logsql_count", "_time:24h level:info | stats count() as total", f"level = 'info' AND timestamp_us >= {_AGO(86400)}"),
    ("logsql_tail", "_time:300m | sort by (_time) desc | limit 100", f"timestamp_us >= {_AGO(18000)}{_LATEST} LIMIT 100"),
):
    QUERIES[_name] = _logsql(_text)
    ORACLE_SQL[_name] = LOGS + f" SELECT {'count(*) AS total' if 'count' in _name else 'event_id, timestamp_us, level, message'} FROM logs WHERE {_sql}"


# counts and summaries


@query(LOGS + " SELECT count(*) AS total FROM logs")
def count_all(spark, sf_dir):
    return search.totals(logs(spark, sf_dir), LogFilter())


@query(LOGS + " SELECT count(*) AS total FROM logs WHERE level = 'warning'")
def count_level(spark, sf_dir):
    return search.totals(logs(spark, sf_dir), LogFilter.of(level="warning"))


@query("SELECT count(*) AS total FROM documents WHERE contains(lower(text), 'tion')")
def count_message(spark, sf_dir):
    return search.totals(documents_view(table(spark, sf_dir, "documents")), LogFilter.of(message="tion"))


@query(LOGS + " SELECT level AS value, count(*) AS hits FROM logs GROUP BY level")
def field_values_level(spark, sf_dir):
    return search.field_values(logs(spark, sf_dir), "level", LogFilter())


@query(LOGS + " SELECT host AS value, count(*) AS hits FROM logs WHERE level = 'error' GROUP BY host")
def field_values_host(spark, sf_dir):
    return search.field_values(logs(spark, sf_dir), "host", LogFilter.of(level="error"))


@query(LOGS + " SELECT k AS value, count(*) AS hits FROM logs WHERE k = 'none of these' GROUP BY k")
def field_values_missing(spark, sf_dir):
    return search.field_values(logs(spark, sf_dir), "no_such_key", LogFilter())


@query(LOGS + " SELECT message AS value, count(*) AS hits FROM logs GROUP BY message")
def field_values_msg(spark, sf_dir):
    return search.field_values(logs(spark, sf_dir), "_msg", LogFilter())


@query(LOGS + " SELECT value, count(*) AS hits FROM (SELECT unnest(['_msg', '_time', 'level', 'service', 'host', 'request_id'] || CASE WHEN k IS NULL THEN [] ELSE ['k'] END) AS value FROM logs) GROUP BY value")
def field_names(spark, sf_dir):
    return search.field_names(logs(spark, sf_dir), LogFilter())


@query("SELECT key AS value, count(*) AS hits FROM (SELECT unnest(json_keys(props)) AS key FROM events) GROUP BY key")
def props_keys(spark, sf_dir):
    keys = table(spark, sf_dir, "events").select(F.explode(F.map_keys(F.from_json("props", "map<string,string>"))).alias("value"))
    return keys.groupBy("value").agg(F.count("*").alias("hits"))


@query(LOGS + " SELECT timestamp_us - timestamp_us % 3600000000 AS start, level, count(*) AS hits FROM logs GROUP BY ALL")
def time_buckets(spark, sf_dir):
    return search.buckets(logs(spark, sf_dir), LogFilter())


@query("WITH r AS (SELECT user_id, row_number() OVER (ORDER BY user_id) AS rn, count(*) OVER () AS n FROM events) SELECT max(user_id) FILTER (WHERE rn = ceil(0.5 * n)) AS p50, max(user_id) FILTER (WHERE rn = ceil(0.95 * n)) AS p95, max(user_id) FILTER (WHERE rn = ceil(0.99 * n)) AS p99 FROM r")
def bench_percentile(spark, sf_dir):
    return search.nearest_rank(table(spark, sf_dir, "events"), "user_id", 50, 95, 99)


# NDJSON


@query("""SELECT event_id, epoch_us(ts) AS timestamp_us, CASE event_type WHEN 'error' THEN 'error' ELSE 'info' END AS level, event_type AS message, json_extract_string(props, '$.k') AS k FROM events WHERE event_id % 10 <> 0""")
def ndjson_parse(spark, sf_dir):
    """Events as NDJSON lines, every tenth one cut off; parsed, the broken ones left out."""
    e = table(spark, sf_dir, "events")
    text = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    k = F.get_json_object("props", "$.k")
    line = F.to_json(F.struct(F.col("event_type").alias("_msg"), text.alias("_time"), F.col("event_type").alias("level"), F.col("event_id").alias("id"), k.alias("k")))
    lines = e.select(F.when(F.col("event_id") % 10 == 0, F.substring(line, 1, 20)).otherwise(line).alias("value"))
    d = ndjson.parse(lines).where("not malformed")
    return d.select(F.col("metadata.id").cast("long").alias("event_id"), "timestamp_us", "level", "message", F.col("metadata.k").alias("k"))


@query("SELECT CAST(event_id % 10 = 0 AS BOOLEAN) AS malformed, count(*) AS n FROM events GROUP BY ALL")
def ndjson_malformed(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    line = F.concat(F.lit('{"_msg":"'), F.col("event_type"), F.when(F.col("event_id") % 10 == 0, "").otherwise('"}'))
    return ndjson.parse(e.select(line.alias("value"))).groupBy("malformed").agg(F.count("*").alias("n"))


@query(LOGS + """ SELECT event_id, strftime(make_timestamp(timestamp_us), '%Y-%m-%dT%H:%M:%S.%fZ') AS t, message AS m, level AS l, k, host FROM logs""")
def ndjson_render(spark, sf_dir):
    """Entries rendered as NDJSON and read again, field by field."""
    line = ndjson.render(logs(spark, sf_dir))
    got = lambda key: F.get_json_object("value", f"$.{key}")
    return line.select(got("request_id").cast("long").alias("event_id"), got("_time").alias("t"), got("_msg").alias("m"), got("level").alias("l"), got("k").alias("k"), got("host").alias("host"))


# blocks, index, maintenance


@query(BLOCKS + " SELECT block, entry_count, ts_min, ts_max FROM manifest")
def block_manifest(spark, sf_dir):
    return manifest(spark, sf_dir).drop("byte_size")


@query(BLOCKS + f" SELECT block, entry_count FROM manifest WHERE ts_max >= {FROM} AND ts_min <= {UNTIL}")
def block_prune(spark, sf_dir):
    return cat.overlapping(manifest(spark, sf_dir), FROM, UNTIL).select("block", "entry_count")


@query(BLOCKS + " SELECT block, term, entry_count FROM terms")
def term_extract(spark, sf_dir):
    return cat.postings(placed(spark, sf_dir))


_VALUES = ("api", "a" * 64, "a" * 65, "0123456789ab", "feed-beef-01", "short-one", "12345", "123456", "abc_def_ghi_jkl", "deadbeefcafe", "user 123456", "v1.2.3", "ÄÖÜ-straße-long", "")
_LIST = ", ".join(f"('{v}')" for v in _VALUES)


@query(f"""SELECT key, value, count(*) AS n FROM (SELECT DISTINCT event_type FROM events), (VALUES ('path'), ('host'), ('other')) t(key), (VALUES {_LIST}) u(value)
WHERE key <> 'other' AND CASE WHEN key = 'host' THEN strlen(value) <= 255 ELSE strlen(value) <= 64 AND NOT (((contains(value, '-') OR contains(value, '_')) AND length(value) >= 12) OR regexp_full_match(value, '[0-9a-fA-F]{{12,}}')
OR length(regexp_replace(value, '[^0-9]', '', 'g')) >= greatest(length(value) * 3 // 4, 6)) END GROUP BY ALL""")
def term_shapes(spark, sf_dir):
    """Which values are worth a posting under which key."""
    kinds = table(spark, sf_dir, "events").select("event_type").distinct()
    d = kinds.select(F.explode(F.array(*map(F.lit, ("path", "host", "other")))).alias("key")).select("key", F.explode(F.array(*map(F.lit, _VALUES))).alias("value"))
    return d.where(is_term(F.col("key"), F.col("value"))).groupBy("key", "value").agg(F.count("*").alias("n"))


@query(BLOCKS + " SELECT m.block, m.entry_count FROM manifest m JOIN (SELECT block FROM terms WHERE term IN ('level:error', 'host:web-4', 'service:signup') GROUP BY block HAVING count(DISTINCT term) = 3) t USING (block)")
def posting_intersect(spark, sf_dir):
    p = placed(spark, sf_dir)
    return cat.holding(cat.manifest(p), cat.postings(p), ["level:error", "host:web-4", "service:signup"]).select("block", "entry_count")


@query(BLOCKS + f" SELECT CAST(coalesce(sum(t.entry_count), 0) AS BIGINT) AS covered FROM terms t JOIN manifest m USING (block) WHERE t.term = 'level:error' AND m.ts_min >= {FROM} AND m.ts_max <= {UNTIL}")
def term_join_blocks(spark, sf_dir):
    p = placed(spark, sf_dir)
    return cat.index_count(cat.manifest(p), cat.postings(p), "level:error", FROM, UNTIL)


@query(BLOCKS + " SELECT m.block, coalesce(t.n, 0) AS terms FROM manifest m LEFT JOIN (SELECT block, count(*) AS n FROM terms GROUP BY block) t USING (block)")
def terms_per_block(spark, sf_dir):
    p = placed(spark, sf_dir)
    return cat.term_counts(cat.manifest(p), cat.postings(p)).select("block", "terms")


@query(BLOCKS + f" SELECT block FROM manifest WHERE NOT ts_max < {FROM}")
def retention_age(spark, sf_dir):
    m = manifest(spark, sf_dir)
    return m.join(cat.expired(m, FROM).select("block"), "block", "left_anti").select("block")


@query(BLOCKS + " SELECT block FROM (SELECT block, sum(byte_size) OVER () - coalesce(sum(byte_size) OVER (ORDER BY ts_min, block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remaining FROM manifest) WHERE remaining > 60000")
def retention_size(spark, sf_dir):
    return cat.over_budget(manifest(spark, sf_dir), "byte_size", 60_000).select("block")


@query(BLOCKS + ", counted AS (SELECT m.block, m.ts_min, coalesce(t.n, 0) AS n FROM manifest m LEFT JOIN (SELECT block, count(*) AS n FROM terms GROUP BY block) t USING (block)) SELECT block FROM (SELECT block, sum(n) OVER () - coalesce(sum(n) OVER (ORDER BY ts_min, block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remaining FROM counted) WHERE remaining > 100")
def retention_terms(spark, sf_dir):
    p = placed(spark, sf_dir)
    return cat.over_budget(cat.term_counts(cat.manifest(p), cat.postings(p)), "terms", 100).select("block")


@query(BLOCKS + " SELECT block FROM (SELECT block, coalesce(sum(entry_count) OVER (ORDER BY ts_min, block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM manifest) WHERE spent < 3200")
def compact_budget(spark, sf_dir):
    return cat.within_budget(manifest(spark, sf_dir), 3200).select("block")


@query(LOGS + """, daily AS (SELECT timestamp_us // 7200000000 AS block, count(*) AS n, min(timestamp_us) AS ts_min FROM logs GROUP BY 1), seq AS (SELECT *, row_number() OVER (ORDER BY ts_min, block) AS rn FROM daily),
fold AS (WITH RECURSIVE f(rn, block, batch, held) AS (SELECT rn, block, 0, n FROM seq WHERE rn = 1 UNION ALL SELECT s.rn, s.block, CASE WHEN f.held + s.n > 120 THEN f.batch + 1 ELSE f.batch END, CASE WHEN f.held + s.n > 120 THEN s.n ELSE f.held + s.n END FROM f JOIN seq s ON s.rn = f.rn + 1) SELECT * FROM f)
SELECT block, CAST(batch AS BIGINT) AS batch FROM fold WHERE batch < (SELECT max(batch) FROM fold) OR (SELECT count(*) FROM fold WHERE batch = (SELECT max(batch) FROM fold)) >= 2""")
def merge_groups(spark, sf_dir):
    """Blocks of two hours, merged greedily into batches of at most 120 entries."""
    d = logs(spark, sf_dir).withColumn("block", F.floor(F.col("timestamp_us") / F.lit(7_200_000_000)).cast("long"))
    return cat.merge_groups(cat.manifest(d), 120)


@query(LOGS + " SELECT count(*) AS violations FROM (SELECT timestamp_us < lag(timestamp_us) OVER (ORDER BY event_id) AS back FROM logs) WHERE back")
def ts_ordered(spark, sf_dir):
    return cat.out_of_order(logs(spark, sf_dir), "event_id", 1000)


@query("""WITH log AS (SELECT user_id, event_id, CASE event_type WHEN 'error' THEN 'delete' ELSE 'put' END AS op FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM log) SELECT user_id, event_id, op FROM r WHERE rn = 1 AND op <> 'delete'""")
def latest_state(spark, sf_dir):
    """Snapshot and log reduced to what is alive."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("event_type") == "error", "delete").otherwise("put").alias("op"))
    return cat.latest(e, "user_id", "event_id")


_RAW = "unhex(printf('%016x', timestamp_us)) || unhex(printf('%08x', strlen(level))) || encode(level) || unhex(printf('%08x', strlen(message))) || encode(message) || unhex(printf('%08x', strlen(host))) || encode(host)"


@query(LOGS + f", h AS (SELECT sha256({_RAW}) AS h FROM logs) SELECT count(*) AS n, " + ", ".join(f"CAST(coalesce(sum(CAST('0x' || substr(h, {8 * i + 1}, 8) AS BIGINT)), 0) AS VARCHAR) AS limb_{i}" for i in range(8)) + " FROM h")
def digest(spark, sf_dir):
    """The limbs of the exact digest, over time, level, message and host."""
    d = dig.limbs(logs(spark, sf_dir), F.col("metadata.host"))
    return d.select("n", *(F.col(f"limb_{i}").cast("string").alias(f"limb_{i}") for i in range(8)))


@query(LOGS + f", h AS (SELECT sha256({_RAW}) AS h FROM logs) SELECT count(*) AS n, bit_xor(CAST('0x' || substr(h, 1, 15) AS BIGINT)) AS digest FROM h")
def digest_quick(spark, sf_dir):
    return dig.quick(logs(spark, sf_dir), F.col("metadata.host"))


# the same through a store


class Held:
    """Stores made of the events, one for each session and folder; kept until Python ends."""

    made: dict[tuple, LogStore] = {}

    @classmethod
    def store(cls, spark: SparkSession, sf_dir: str, kind: str = "raw") -> LogStore:
        """raw: four appended parts of the events.  zstd: the same, compacted to blocks of BLOCK entries and merged."""
        key = (spark.sparkContext.applicationId, sf_dir, kind)
        if key not in cls.made:
            store = LogStore(spark, scratch(spark, f"store-{kind}"), Config(compaction_rows=BLOCK, merge_target_rows=4 * BLOCK, retention_max_age=None))
            for part in range(4):
                store.append(logs(spark, sf_dir).where(F.col("event_id") % 4 == part), batch=f"events#{part}")
            if kind == "zstd":
                while store.compact(force=True) == "more":
                    pass
                store.merge()
            cls.made[key] = store
        return cls.made[key]


def shown(entries: DataFrame) -> DataFrame:
    return entries.select(F.col("metadata.request_id").cast("long").alias("event_id"), "timestamp_us", "level", "message")


@query(LOGS + " SELECT event_id, timestamp_us, level, message FROM logs")
def store_entries(spark, sf_dir):
    """Everything that was appended, from raw blocks; a batch that is appended again is not in twice."""
    store = Held.store(spark, sf_dir)
    store.append(logs(spark, sf_dir).where(F.col("event_id") % 4 == 3), batch="events#3")
    return shown(store.entries())


@query(LOGS + " SELECT event_id, timestamp_us, level, message FROM logs")
def store_compacted(spark, sf_dir):
    """Everything, after compaction and merging."""
    return shown(Held.store(spark, sf_dir, "zstd").entries())


@query(LOGS + f" SELECT event_id, timestamp_us, level, message FROM logs WHERE level = 'error' AND service = 'error' AND host = 'web-2' AND timestamp_us BETWEEN {FROM} AND {UNTIL}")
def store_search(spark, sf_dir):
    """Blocks are chosen by time, level and terms before any is read."""
    return shown(Held.store(spark, sf_dir, "zstd").entries(LogFilter.of("error", None, FROM, UNTIL, {"service": "error", "host": "web-2"})))


@query(LOGS + " SELECT event_id, timestamp_us, level, message FROM logs WHERE level = 'warning' ORDER BY timestamp_us DESC, message, event_id LIMIT 100")
def store_newest(spark, sf_dir):
    """A page that reads the newest blocks only."""
    found = shown(Held.store(spark, sf_dir, "zstd").newest_first(LogFilter.of(level="warning"), 100))
    return found.orderBy(F.desc("timestamp_us"), "message", "event_id").limit(100)


_COUNTS = {
    "all": (LogFilter(), "true"), "level": (LogFilter.of(level="error"), "level = 'error'"), "range": (LogFilter.of(since=FROM, until=UNTIL), f"timestamp_us BETWEEN {FROM} AND {UNTIL}"),
    "level in range": (LogFilter.of("info", None, FROM, UNTIL), f"level = 'info' AND timestamp_us BETWEEN {FROM} AND {UNTIL}"), "service": (LogFilter.of(metadata={"service": "signup"}), "service = 'signup'"),
    "host in range": (LogFilter.of(since=FROM, metadata={"host": "web-4"}), f"host = 'web-4' AND timestamp_us >= {FROM}"), "text": (LogFilter.of(message="user 77"), "contains(message, 'user 77')"), "nothing": (LogFilter.of(level="fatal"), "false"),
}


@query(LOGS + " " + " UNION ALL ".join(f"SELECT '{k}' AS name, count(*) AS total FROM logs WHERE {v[1]}" for k, v in _COUNTS.items()))
def store_counts(spark, sf_dir):
    """Counts from the catalogue, and from the blocks at a range's ends."""
    store = Held.store(spark, sf_dir, "zstd")
    return spark.createDataFrame([(k, store.count(v[0])) for k, v in _COUNTS.items()], "name string, total long")


@query(LOGS + " SELECT host AS value, count(*) AS hits FROM logs WHERE level = 'error' GROUP BY host")
def store_field_values(spark, sf_dir):
    log = Emberlog(spark, Held.store(spark, sf_dir).path)
    return spark.createDataFrame([(r["value"], r["hits"]) for r in log.field_values("host", level="error")], "value string, hits long")


@query(LOGS + " SELECT count(*) AS total_entries, min(timestamp_us) AS oldest_timestamp, max(timestamp_us) AS newest_timestamp, count(*) AS raw_entries, CAST(0 AS BIGINT) AS compressed_entries FROM logs")
def store_stats(spark, sf_dir):
    return Held.store(spark, sf_dir).stats().select("total_entries", "oldest_timestamp", "newest_timestamp", "raw_entries", "compressed_entries")


@query(LOGS + " SELECT 'zstd' AS format, count(*) AS entries, min(timestamp_us) AS oldest, max(timestamp_us) AS newest FROM logs")
def stats_by_format(spark, sf_dir):
    """Of a store after compaction."""
    return cat.by_format(Held.store(spark, sf_dir, "zstd").catalogue()).select("format", "entries", "oldest", "newest")


@query(LOGS + " SELECT term, count(*) AS entry_count FROM (SELECT 'level:' || level AS term FROM logs UNION ALL SELECT 'service:' || service FROM logs UNION ALL SELECT 'host:' || host FROM logs) GROUP BY term")
def store_postings(spark, sf_dir):
    """The stored terms of all blocks, added up."""
    return Held.store(spark, sf_dir, "zstd").postings().groupBy("term").agg(F.sum("entry_count").alias("entry_count"))


@query(LOGS + f", r AS (SELECT *, row_number() OVER (ORDER BY timestamp_us, event_id) AS rn FROM logs), b AS (SELECT (rn - 1) // 1000 AS b, max(timestamp_us) AS last FROM r GROUP BY 1) SELECT event_id, timestamp_us, level, message FROM r WHERE (rn - 1) // 1000 IN (SELECT b FROM b WHERE last >= {FROM})")
def store_retention(spark, sf_dir):
    """Blocks of 1000 entries whose entries are all too old go; one that straddles the time stays whole."""
    store = LogStore(spark, scratch(spark, "store-retention"), Config(compaction_rows=1000))
    d = cat.blocks(logs(spark, sf_dir), 1000, "timestamp_us", "event_id")
    store.append(d.repartitionByRange(10_000, "block").sortWithinPartitions("block"), rebalance=False)
    store.delete_before(FROM)
    return shown(store.entries())


@query(LOGS + " SELECT level, count(*) AS n, count(DISTINCT event_id) AS ids FROM logs GROUP BY level")
def tail_union_disk(spark, sf_dir):
    """A log with most entries in its store and the last two hours' in its tail: together every entry, once."""
    d = logs(spark, sf_dir)
    last = d.agg(F.max("timestamp_us")).first()[0] - 7_200_000_000
    log = Emberlog(spark, scratch(spark, "store-tail"), Config(flush_rows=10**9, soft_watermark=10**9, raw_debt_limit=10**15))
    log.append(d.where(F.col("timestamp_us") < last))
    log.ingest({"timestamp": r["timestamp_us"], "level": r["level"], "message": r["message"], "metadata": r["metadata"], "_exact": True} for r in d.where(F.col("timestamp_us") >= last).toLocalIterator())
    return log.entries().groupBy("level").agg(F.count("*").alias("n"), F.count_distinct("metadata.request_id").alias("ids"))


@query(LOGS + " SELECT event_id, ordinal FROM (SELECT event_id, row_number() OVER (ORDER BY timestamp_us, event_id) - 1 AS ordinal FROM logs) WHERE ordinal BETWEEN 100 AND 399")
def page_cursor(spark, sf_dir):
    """Three pages of 100 behind the first page's cursor, numbered from the first entry.  Blocks are ranges of the order, each sorted by its own task."""
    from itertools import chain, islice

    store = LogStore(spark, scratch(spark, "store-pages"))
    order = ("timestamp_us", "event_id")
    store.append(logs(spark, sf_dir).repartitionByRange(*order).sortWithinPartitions(*order), rebalance=False)
    first = next(store.pages(100), [])
    behind = chain.from_iterable(islice(store.pages(100, first[-1][:2]), 3)) if first else ()
    rows = [(int(e["metadata"]["request_id"]), i) for i, (_, _, e) in enumerate(behind, len(first))]
    return spark.createDataFrame(rows, "event_id long, ordinal long")


@query(LOGS + " SELECT ('0x' || substr(md5(request_id), 1, 8))::BIGINT % 8 AS shard, count(*) AS n FROM logs GROUP BY 1")
def ingest_shards(spark, sf_dir):
    """Entries by the queue that they wait in."""
    return logs(spark, sf_dir).groupBy(ingest.shard(8).cast("long").alias("shard")).agg(F.count("*").alias("n"))


@query(LOGS + " SELECT level, count(*) AS n, min(timestamp_us) AS oldest FROM logs GROUP BY level")
def store_copy(spark, sf_dir):
    """A store that was copied into another, which a digest confirms, and backed up from there."""
    source, target = Held.store(spark, sf_dir), LogStore(spark, scratch(spark, "store-copy"))
    transfer.copy(source, target)
    if not transfer.same(source, target):
        raise ValueError("the copy differs")
    path = scratch(spark, "store-backup")
    target.backup(path)
    return LogStore(spark, path).entries().groupBy("level").agg(F.count("*").alias("n"), F.min("timestamp_us").alias("oldest"))


@query("SELECT CASE event_type WHEN 'error' THEN 'error' ELSE 'info' END AS level, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events WHERE event_id % 10 <> 0 GROUP BY 1")
def stream_ingest(spark, sf_dir):
    """NDJSON files as a stream into a store, run twice over the same files; every tenth line is cut off."""
    e = table(spark, sf_dir, "events")
    line = F.to_json(F.struct(F.col("event_type").alias("_msg"), F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("_time"), F.col("event_type").alias("level"), F.col("event_id").alias("id")))
    home = scratch(spark, "stream")
    e.select(F.when(F.col("event_id") % 10 == 0, F.substring(line, 1, 20)).otherwise(line).alias("value")).write.text(f"{home}/landing")
    store = LogStore(spark, f"{home}/store")
    for _ in range(2):
        ingest.into_store(store, f"{home}/landing", f"{home}/checkpoint", once=True).awaitTermination()
    return store.entries().groupBy("level").agg(F.count("*").alias("n"), F.sum(F.col("metadata.id").cast("long")).alias("ids"))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship query: the latest errors."""
    return level_eq(spark, sf_dir)


__all__ = ["ALIASES", "ORACLE_SQL", "QUERIES", "entry"]
