import json
import logging
import threading
import urllib.error
import urllib.request

import pytest

from emberlog import telemetry
from emberlog.api import Emberlog
from emberlog.config import Config
from emberlog.http import App, serve
from emberlog.operators import digest
from emberlog.plans.filters import LogFilter
from emberlog.sources.handler import EmberlogHandler
from emberlog.sources.store import LogStore
from emberlog.streaming import ingest
from emberlog.streaming.live import Tail, boundary, tail_and_disk

BASE = 1_700_000_000_000_000
DAY = 86_400_000_000


def records(n, start=0, **more):
    return [{"timestamp": BASE + (start + i) * 1_000_000, "level": "error" if i % 4 == 0 else "info", "message": f"entry {start + i}", "metadata": {"service": "api" if i % 2 else "web", "request_id": f"{start + i:032x}"} | more} for i in range(n)]


@pytest.fixture
def log(spark, tmp_path):
    return Emberlog(spark, str(tmp_path / "store"), Config(flush_rows=10**9, compaction_rows=50, merge_target_rows=100), clock=lambda: BASE + 10_000_000_000)


def messages(page):
    return [r["message"] for r in page.entries]


def test_entries_are_there_before_and_after_a_flush(log):
    log.ingest(records(10))
    before = messages(log.query("asc"))
    assert log.count() == 10 and log.flush() == 10 and log.flush() == 0
    assert messages(log.query("asc")) == before == [f"entry {i}" for i in range(10)]
    assert log.count() == 10 and log.count(level="error") == 3
    assert log.query(level="error", limit=2, count_total=False).has_more
    assert messages(log.query(limit=3, count_total=False)) == ["entry 9", "entry 8", "entry 7"]


def test_answers_survive_compaction_and_merging(log):
    for k in range(6):
        log.ingest(records(30, 30 * k))
        log.flush()
    ask = lambda: (messages(log.query("asc", 7, 100)), log.count(level="error"), log.count(since=BASE + 5_000_000, until=BASE + 50_000_000), log.field_values("service"), digest.digest(log.entries()))
    before = ask()
    assert log.stats()["raw_blocks"] >= 6
    assert log.compact_now() == "ok" and log.compact_now() == "noop"
    s = log.stats()
    assert s["raw_blocks"] == 0 and s["compressed_entries"] == 180 == s["total_entries"] and s["compactions"] == 1
    assert ask() == before
    assert log.merge_now() == "ok"
    assert ask() == before
    log.store.vacuum()
    assert ask() == before and log.store.reindex() > 0 and ask() == before


def test_too_little_and_fresh_is_not_compacted(log):
    log.store.clock = lambda: BASE
    log.ingest(records(5))
    log.flush()
    assert log.store.compact() == "noop" and log.store.merge() == "noop"
    log.store.clock = lambda: BASE + 61_000_000
    assert log.store.compact() == "ok"


def test_count_uses_the_index_and_agrees(log):
    log.ingest(records(100))
    log.flush()
    log.ingest(records(100, 100))
    log.flush()
    for where in (LogFilter.of(level="error"), LogFilter.of(level="error", since=BASE + 20_000_000, until=BASE + 150_000_000), LogFilter.of(), LogFilter.of(level="notice")):
        assert log.store.count(where) == where.apply(log.store.entries()).count()


def test_time_and_level_prune_blocks(log):
    for k in range(3):
        log.append(log.spark.createDataFrame([(BASE + k * DAY, "error" if k == 1 else "info", "m", {})], "timestamp_us long, level string, message string, metadata map<string,string>"))
    assert log.store.blocks_for(LogFilter.of(since=BASE + DAY)).count() == 2
    assert log.store.blocks_for(LogFilter.of(level="error")).count() == 1
    assert log.store.newest_first(LogFilter(), 1).count() == 1


def test_every_severity_is_kept(log):
    levels = ["debug", "info", "notice", "warning", "error", "critical", "alert", "emergency", "fatal"]
    log.ingest([{"timestamp": BASE + i, "level": x} for i, x in enumerate(levels)])
    log.compact_now()
    assert [r["level"] for r in log.query("asc").entries] == levels


def test_retention(log):
    for k in range(4):
        log.ingest([{"timestamp": BASE + k * DAY, "message": str(k)}, {"timestamp": BASE + k * DAY + 1, "message": str(k)}])
        log.flush()
    assert log.store.delete_before(BASE + DAY + 1) == 1  # the block that straddles the cutoff stays
    assert log.count() == 6
    sizes = [r["byte_size"] for r in log.store.catalogue().orderBy("ts_min").collect()]
    assert log.store.delete_over_size(sum(sizes) - 1) == 1 and log.store.delete_over_size(sum(sizes)) == 0
    assert log.store.delete_over_terms(1) == 1
    assert [r["message"] for r in log.query("asc").entries] == ["3", "3"]
    assert LogStore(log.spark, log.store.path, Config(retention_max_age=None)).retain() == "noop"
    assert LogStore(log.spark, log.store.path, Config(retention_max_age=0), clock=lambda: BASE + 9 * DAY).retain() == ("ok", 1)


def test_backup_and_moving(log, spark, tmp_path):
    log.ingest(records(20))
    said = log.backup(str(tmp_path / "copy"))
    assert said["files"] > 2 and said["total_bytes"] > 0
    (tmp_path / "copy").rename(tmp_path / "moved")
    assert Emberlog(spark, str(tmp_path / "moved")).count() == 20


def test_missing_and_broken_files_are_skipped(log, tmp_path):
    log.ingest(records(8))
    log.flush()
    log.ingest(records(8, 8))
    log.flush()
    blocks = [r["block"] for r in log.store.catalogue().orderBy("ts_min").collect()]
    file = tmp_path / "store" / "segments" / blocks[0]
    file.write_bytes(b"broken")
    for crc in file.parent.glob(".*.crc"):
        crc.unlink()
    assert len(messages(log.query())) == 16 - 8 * len([b for b in blocks if b == blocks[0]]) or len(blocks) > 2


def test_pages_resume_behind_a_cursor(log):
    log.ingest(records(25))
    log.compact_now()
    pages = list(log.store.pages(7))
    assert sum(map(len, pages)) == 25
    block, ordinal, _ = pages[1][-1]
    rest = list(log.store.pages(7, (block, ordinal)))
    assert sum(map(len, rest)) == 25 - sum(map(len, pages[:2]))


def test_digest_ignores_order_and_sees_changes(spark, log):
    log.ingest(records(50))
    n, d = digest.digest(log.entries())
    assert digest.verify(log.entries().repartition(7), n, d)
    other = log.entries().selectExpr("timestamp_us + 1 as timestamp_us", "level", "message", "metadata")
    assert digest.digest(other) != (n, d) and digest.digest(other.limit(0)) == (0, "0" * 64)


def test_subscriptions(log):
    got, errors = [], []
    a, b = log.subscribe(got.append), log.subscribe(errors.append, level="error", metadata={"service": "web"})
    log.ingest(records(8))
    assert len(got) == 8 and [e[1] for e in errors] == ["error", "error"]
    log.unsubscribe(a)
    log.unsubscribe(b)
    log.ingest(records(1))
    assert len(got) == 8


def test_in_memory(spark):
    log = Emberlog(spark)
    log.ingest(records(5))
    assert log.count() == 5 and log.flush() == 0 and log.stats()["total_entries"] == 5


def test_tail(spark, log):
    tail = Tail()
    names = tail.add([(BASE + i, "info", str(i), {}) for i in (3, 1, 2)])
    assert [r["message"] for r in tail.frame(spark, BASE + 2).collect()] == ["2", "3"]
    tail.stored(names[:1])
    tail.prune_before(BASE + 2)
    assert len(tail) == 1
    assert boundary(100, 5, None, None) == 100 and boundary(100, 5, None, 10) == 95 and boundary(100, 5, 98, 10) == 98
    log.ingest(records(30))
    whole = log.entries()
    assert tail_and_disk(whole, whole, BASE + 10_000_000).count() == 30


def test_stream_ingest_is_stored_once(spark, log, tmp_path):
    landing = tmp_path / "landing"
    landing.mkdir()
    (landing / "a.json").write_text('{"_msg":"one","_time":1700000000,"level":"warn","n":1}\n{broken\n\n{"_msg":"two","meta":{"x":[1]}}\n[1]\n')
    for _ in range(2):
        q = ingest.into_store(log.store, str(landing), str(tmp_path / "check"), once=True)
        q.awaitTermination()
    rows = log.query("asc").entries
    assert [r["message"] for r in rows] == ["one", "two"] and rows[0]["level"] == "warning"
    assert rows[0]["metadata"] == {"n": "1"} and rows[1]["metadata"] == {"meta": '{"x":[1]}'}
    assert log.stats()["malformed"] == 2
    assert log.store.append(log.entries(), batch=f"{tmp_path / 'check'}#0") == 0


def test_handler(log):
    logger = logging.getLogger("shop")
    logger.setLevel(logging.DEBUG)
    handler = EmberlogHandler(log)
    logger.addHandler(handler)
    try:
        logger.warning("sold %d", 3, extra={"order": 7})
        logger.log(35, "between")
    finally:
        logger.removeHandler(handler)
    rows = {r["message"]: r for r in log.query().entries}
    assert rows["sold 3"]["level"] == "warning" == rows["between"]["level"] and rows["sold 3"]["metadata"]["order"] == "7"


def test_bad_single_entries_never_raise(log):
    log.ingest_one({"timestamp": "not a time"})
    log.ingest_one({"message": "fine"})
    assert log.count() == 1


def test_telemetry(log):
    seen = []
    telemetry.attach("t", ["flush.stop", "query.stop"], lambda *e: seen.append(e))
    telemetry.attach("bad", ["flush.stop"], lambda *e: 1 / 0)
    log.ingest(records(3))
    log.flush()
    log.query()
    telemetry.detach("t")
    assert [e[0] for e in seen] == ["flush.stop", "query.stop"] and seen[1][1]["total"] == 3


def test_http(log, tmp_path):
    server = serve(App(log, token="secret"))
    base = f"http://127.0.0.1:{server.server_port}"

    def ask(path, body=None, token="secret"):
        request = urllib.request.Request(base + path, data=body, headers={"Authorization": f"Bearer {token}"} if token else {})
        try:
            with urllib.request.urlopen(request) as r:
                return r.status, r.read().decode()
        except urllib.error.HTTPError as e:
            return e.code, e.read().decode()

    try:
        lines = b'{"_msg":"a","_time":"2024-01-15T10:30:00Z","level":"error","service":"api"}\n{"_msg":"b","_time":1705314601,"service":"web"}\n'
        assert ask("/insert/jsonline", lines) == (204, "")
        assert json.loads(ask("/insert/jsonline", b'junk\n{"_msg":"c"}\n{"x')[1]) == {"entries": 1, "errors": 2}
        assert ask("/insert/jsonline?_msg_field=body&_time_field=ts", b'{"body":"d","ts":"2024-01-15T10:30:02Z"}')[0] == 204
        status, text = ask("/select/logsql/query?order=asc&end=2024-01-15T10:30:01Z")
        rows = [json.loads(x) for x in text.split("\n")]
        assert status == 200 and [r["_msg"] for r in rows] == ["a", "b"]
        assert rows[0] == {"_time": "2024-01-15T10:30:00.000000Z", "_msg": "a", "level": "error", "service": "api"}
        assert ask("/select/logsql/query", b"query=service:api")[1].count("\n") == 0
        assert json.loads(ask("/select/logsql/query", b"query=*+|+stats+count()")[1]) == {"total": 4}
        assert ask("/select/logsql/query", b"query=level:bogus") == (200, "")
        values = json.loads(ask("/select/logsql/field_values?field=service", b"query=*")[1])["values"]
        assert values == [{"value": "api", "hits": 1}, {"value": "web", "hits": 1}]
        names = {v["value"]: v["hits"] for v in json.loads(ask("/select/logsql/field_names", b"query=*")[1])["values"]}
        assert names["_msg"] == 4 and names["service"] == 2
        assert ask("/api/v1/flush")[0] == 200 and json.loads(ask("/health", token=None)[1])["entries"] == 4
        assert json.loads(ask("/select/logsql/stats")[1])["total_entries"] == 4
        assert json.loads(ask("/api/v1/backup", json.dumps({"path": str(tmp_path / "b")}).encode())[1])["files"] > 0
        assert ask("/select/logsql/stats", token=None)[0] == 401 and ask("/select/logsql/stats", token="no")[0] == 403
        assert ask("/select/logsql/stats?token=secret", token=None)[0] == 200 and ask("/nothing")[0] == 404
        assert ask("/select/logsql/query?limit=-1")[0] == 400 and ask("/select/logsql/field_values", b"")[0] == 400
    finally:
        server.shutdown()


def test_writers_in_threads_lose_nothing(log):
    threads = [threading.Thread(target=lambda k=k: log.ingest(records(20, 20 * k))) for k in range(5)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    log.flush()
    assert log.count() == 100 and log.store.count(LogFilter()) == 100


def test_sql(log):
    log.ingest(records(4))
    assert log.sql("select count(*) as n from logs where level = :x", x="error").first()["n"] == 1


def test_copies_resume_and_are_verified(log, spark, tmp_path):
    from emberlog.sources import transfer

    for k in range(3):
        log.ingest(records(10, 10 * k))
        log.flush()
    target = LogStore(spark, str(tmp_path / "target"))

    class Stop(Exception):
        pass

    def stop(done, of):
        if done == 2:
            raise Stop

    with pytest.raises(Stop):
        transfer.copy(log.store, target, stop, rows=1)
    assert not transfer.same(log.store, target) and not transfer.remove_copied(log.store, target)
    assert transfer.copy(log.store, target, rows=1) == 30 - 20 and transfer.copy(log.store, target, rows=1) == 0
    n, d = digest.digest(log.store.entries())
    assert digest.validate(target.entries(), n, d) == [] and digest.validate(target.entries(), n + 1, "0" * 64) == ["count", "digest"]
    assert transfer.remove_copied(log.store, target) and not (tmp_path / "store").exists()


def test_pressure_lowers_the_codec_level(log, spark):
    log.ingest(records(5))
    log.flush()
    assert log.store.codec_level() == 9
    assert LogStore(spark, log.store.path, Config(raw_debt_limit=10)).codec_level() == 3


def test_compaction_goes_in_bounded_passes(log, spark):
    for k in range(4):
        log.ingest(records(10, 10 * k))
        log.flush()
    store = LogStore(spark, log.store.path, Config(compaction_pass_rows=15, retention_max_age=None))
    assert store.compact(force=True) == "more" and store.stats().first()["raw_entries"] == 20
    assert store.compact(force=True) == "ok" and store.stats().first()["total_entries"] == 40
