"""The store loses nothing and doubles nothing: damage, races, retries, many blocks."""

import json
import threading
import time

import pytest
from pyspark.sql import functions as F

from emberlog import telemetry
from emberlog.api import Emberlog
from emberlog.config import Config
from emberlog.functions.terms import is_term, term_like
from emberlog.operators import digest
from emberlog.plans.filters import LogFilter
from emberlog.sources import store as store_module
from emberlog.sources import transfer
from emberlog.sources.handler import EmberlogHandler, install, uninstall
from emberlog.sources.store import LogStore
from emberlog.streaming.ingest import shard, shard_of
from emberlog.streaming.live import Tail

BASE = 1_700_000_000_000_000
SCHEMA = "timestamp_us long, level string, message string, metadata map<string,string>"


def rows(n, start=0):
    return [(BASE + (start + i) * 1_000_000, "error" if i % 4 == 0 else "info", f"entry {start + i}", {"service": "api" if i % 2 else "web", "n": str(start + i)}) for i in range(n)]


@pytest.fixture
def store(spark, tmp_path):
    return LogStore(spark, str(tmp_path / "store"), Config(compaction_rows=50, retention_max_age=None), clock=lambda: BASE + 10_000_000_000)


def add(store, n, start=0, **more):
    return store.append(store.spark.createDataFrame(rows(n, start), SCHEMA).coalesce(1), rebalance=False, **more)


def spoil(store, block):
    import pathlib

    file = pathlib.Path(store.path) / "segments" / block
    raw = bytearray(file.read_bytes())
    raw[4 : len(raw) // 2] = bytes(len(raw) // 2 - 4)
    file.write_bytes(bytes(raw))
    for crc in file.parent.glob(".*.crc"):
        crc.unlink()


def numbers(df):
    return sorted(int(r["metadata"]["n"]) for r in df.collect())


def test_compaction_leaves_damaged_blocks_as_they_are(store):
    add(store, 50)
    add(store, 50, 50)
    bad = store.catalogue().orderBy("ts_min").first()["block"]
    spoil(store, bad)
    seen = []
    telemetry.attach("damage", ["block.error"], lambda *e: seen.append(e))
    try:
        assert store.compact(force=True) == "ok"
    finally:
        telemetry.detach("damage")
    assert [e[2] for e in seen] == [{"block": bad, "reason": "corrupt_block"}] and seen[0][1]["entry_count"] == 50
    left = {r["block"]: r["format"] for r in store.catalogue().collect()}
    assert left[bad] == "raw" and len(left) > 1 and store.stats().first()["total_entries"] == 100
    assert numbers(store.entries()) == list(range(50, 100)) and store.fs.exists(store._hadoop(f"segments/{bad}"))
    assert store.compact(force=True) == "noop" and store.count(LogFilter()) == 50


def test_a_rewrite_that_lost_entries_is_not_published(store):
    add(store, 20)
    before = store.seen().version
    with pytest.raises(store_module.Damaged):
        store._replace(store.catalogue(), lambda blocks: store._rows(blocks).where("level = 'info'"))
    assert store.seen().version == before and numbers(store.entries()) == list(range(20))


def test_queries_report_damage_and_go_on(spark, tmp_path):
    log = Emberlog(spark, str(tmp_path / "s"))
    add(log.store, 8)
    add(log.store, 8, 8)
    spoil(log.store, log.store.catalogue().orderBy("ts_min").first()["block"])
    seen = []
    telemetry.attach("damage", ["block.error"], lambda *e: seen.append(e))
    try:
        page = log.query("asc")
    finally:
        telemetry.detach("damage")
    assert len(seen) == 1 and page.total == 8 == len(page.entries) and log.count(message="entry") == 8 == log.count()
    assert not transfer.remove_copied(log.store, LogStore(spark, str(tmp_path / "t")))


def test_an_append_during_a_compaction_is_kept(store):
    add(store, 30)
    write = store._write

    def slow(*args, **more):
        out = write(*args, **more)
        other = LogStore(store.spark, store.path)
        add(other, 10, 30)
        return out

    store._write = slow
    assert store.compact(force=True) == "ok"
    store._write = write
    assert numbers(store.entries()) == list(range(40)) and numbers(LogStore(store.spark, store.path).entries()) == list(range(40))


def test_retention_during_a_compaction_stays_deleted(store):
    add(store, 30)
    write = store._write

    def slow(*args, **more):
        out = write(*args, **more)
        assert LogStore(store.spark, store.path).delete_before(BASE + 10**9) == 1
        return out

    store._write = slow
    assert store.compact(force=True) == "conflict"
    assert store.entries().count() == 0 and store.raw_debt() == 0


def test_a_version_is_made_once(store):
    assert store._create("versions/x.json", "a") and not store._create("versions/x.json", "b") and store._read("versions/x.json") == "a"


def test_threads_that_write_and_maintain_lose_nothing(spark, tmp_path):
    log = Emberlog(spark, str(tmp_path / "s"), Config(flush_rows=10, flush_seconds=0.05, compaction_threshold=1, compaction_rows=1000, merge_min_blocks=2, merge_target_rows=1000, retention_max_age=None))
    log.start(0.1)
    threads = [threading.Thread(target=lambda k=k: [log.ingest([{"timestamp": BASE + k * 1000 + i, "message": f"{k} {i}"}]) for i in range(40)]) for k in range(4)]
    counts = []
    for t in threads:
        t.start()
    while any(t.is_alive() for t in threads):
        counts.append((log.count(), log.entries().count()))
    for t in threads:
        t.join()
    log.close()
    assert log.count() == 160 == log.store.count(LogFilter()) == log.entries().select("message").distinct().count()
    assert all(a <= b for a, b in counts) and counts == sorted(counts)  # never fewer than before, and none twice


def test_a_batch_is_in_once(store, monkeypatch):
    assert add(store, 5, batch="s#3") == 5 and add(store, 5, batch="s#3") == 0 and add(store, 5, batch="s#2") == 0 and add(store, 5, 5, batch="s#4") == 5
    monkeypatch.setattr(store, "_commit", lambda *a, **k: (_ for _ in ()).throw(OSError("gone")))
    with pytest.raises(OSError):
        add(store, 5, 10, batch="s#5")
    monkeypatch.undo()
    other = LogStore(store.spark, store.path)  # after a restart
    assert other.count(LogFilter()) == 10 and add(other, 5, 10, batch="s#5") == 5 and add(other, 5, 10, batch="s#5") == 0
    assert add(other, 0, batch="s#6") == 0 and other.seen().holds("s#6")
    other.fold()
    assert LogStore(store.spark, store.path).seen().holds("s#6") and add(store, 1, batch="s#5") == 0


def test_a_reader_outlives_compaction_and_vacuum_waits(store):
    add(store, 30)
    add(store, 30, 30)
    before = store.entries()
    assert store.compact(force=True) == "ok"
    store.vacuum()
    assert numbers(before) == list(range(60))
    files = lambda: sum(1 for x in store._names("segments") for f in store.fs.listStatus(x.getPath()) if f.getPath().getName().endswith(".parquet"))
    n = files()
    time.sleep(1.1)
    assert store.vacuum(grace=1.0) > 0 and files() < n and numbers(store.entries()) == list(range(60))
    assert numbers(LogStore(store.spark, store.path).entries()) == list(range(60))


def test_folding_changes_nothing(store, monkeypatch):
    monkeypatch.setattr(store_module, "FOLD_EVERY", 3)
    for k in range(7):
        add(store, 4, 4 * k)
    assert store.seen().fold >= 6
    other = LogStore(store.spark, store.path)
    assert numbers(other.entries()) == list(range(28)) and other.raw_debt() == store.raw_debt() > 0
    assert other.compact(force=True) == "ok" and other.raw_debt() == 0 and store.raw_debt() == 0


def test_many_blocks_are_read_by_segment(store, monkeypatch):
    for k in range(5):
        add(store, 10, 10 * k)
    wheres = [LogFilter(), LogFilter.of(level="error"), LogFilter.of(since=BASE + 15_000_000, until=BASE + 33_000_000), LogFilter.of(metadata={"service": "api"}), LogFilter.of(message="entry 4")]
    want = [(numbers(store.entries(w)), store.count(w), numbers(store.newest_first(w, 3).orderBy(F.desc("timestamp_us")).limit(3))) for w in wheres]
    assert want[0][0] == list(range(50)) and all(len(a) == b for a, b, _ in want)
    monkeypatch.setattr(store_module, "NAMED_FILES", 1)
    monkeypatch.setattr(store_module, "LOCAL_BLOCKS", 2)  # so that rows are in parts and folds
    other = LogStore(store.spark, store.path, store.config, store.clock)
    other.append(store.spark.createDataFrame(rows(30, 50), SCHEMA).repartition(4), rebalance=False)
    other.delete_before(BASE + 9_000_001)
    other.append(store.spark.createDataFrame(rows(10), SCHEMA).coalesce(1), rebalance=False)
    wheres[0] = LogFilter.of(until=BASE + 49_500_000)
    got = [(numbers(other.entries(w.but(until=(*w.until, BASE + 49_500_000)))), other.count(w.but(until=(*w.until, BASE + 49_500_000))), numbers(other.newest_first(w.but(until=(*w.until, BASE + 49_500_000)), 3).orderBy(F.desc("timestamp_us")).limit(3))) for w in wheres]
    assert got == want and other.count(LogFilter()) == 80 and not other.seen().local
    assert other.compact(force=True) == "ok" and numbers(other.entries()) == list(range(80))
    again = LogStore(store.spark, store.path)
    assert numbers(again.entries()) == list(range(80)) and again.postings().where("term = 'service:web'").agg(F.sum("entry_count")).first()[0] == 40


def test_counts_by_terms_agree_with_the_entries(store):
    odd = [({"service": "api", "application": "api"}, "error"), ({"application": "api"}, "info"), ({"service.name": "api"}, "info"), ({"service": None}, "info"), ({"status": "500"}, "error"), ({"status": "0123456789ab"}, "info"), ({}, "fatal"), (None, None)]
    for part in (odd[:2], odd[2:4], odd[4:], odd):
        store.append(store.spark.createDataFrame([(BASE + i, level, "m", m) for i, (m, level) in enumerate(part)], SCHEMA).coalesce(1), rebalance=False)
    for meta in ({"service": "api"}, {"application": "api"}, {"status": "500"}, {"status": 500}, {"status": "0123456789ab"}, {"service": ""}, {"service": None}, {"service": "null"}, {"service": "none"}, {"service": "api", "status": ""}):
        for level in (None, "error"):
            where = LogFilter.of(level=level, metadata=meta)
            assert store.count(where) == where.apply(store._rows(store.catalogue())).count() == store.entries(where).count(), (meta, level)
    assert store.blocks_for(LogFilter.of(metadata={"service": "nowhere"})).count() == 2  # those that hold service.name may match
    assert store.blocks_for(LogFilter.of(metadata={"status": "500"})).count() == 2
    assert store.count(LogFilter.of(level="fatal")) == 2


def test_blocks_of_many_terms_are_read_instead(store, monkeypatch):
    monkeypatch.setattr(store_module, "MAX_TERMS", 3)
    store.append(store.spark.createDataFrame([(BASE + i, "info", "m", {"path": f"/p{i % 7}"}) for i in range(21)], SCHEMA).coalesce(1), rebalance=False)
    row = store.catalogue().first()
    assert not row["complete"] and row["counts"] == {"level:info": 21} and row["terms"] == 8
    assert store.count(LogFilter.of(metadata={"path": "/p3"})) == 3 and store.count(LogFilter.of(metadata={"path": "/q"})) == 0
    assert {r["term"]: r["entry_count"] for r in store.postings().collect()} == {"level:info": 21} | {f"path:/p{i}": 3 for i in range(7)}


def test_term_shapes_agree(spark):
    values = ["api", "a" * 64, "a" * 65, "0123456789ab", "feed-beef-01", "short-one", "12345", "123456", "1234567x", "deadbeefcafe", "ÄÖÜ-straße-long", "", "x1y2z3a4b5c6d7", "h" * 255, "h" * 256]
    d = spark.createDataFrame([(k, v) for k in ("path", "host", "other") for v in values], "k string, v string")
    assert all(r["t"] == term_like(r["k"], r["v"]) for r in d.select("k", "v", is_term(F.col("k"), F.col("v")).alias("t")).collect())


def test_pages_go_on_behind_a_cursor_only_while_its_block_is_there(store):
    add(store, 12)
    first = next(iter(store.pages(5)))
    block, ordinal, entry = first[-1]
    assert [int(e["metadata"]["n"]) for p in store.pages(5, (block, ordinal)) for _, _, e in p] == list(range(5, 12)) and entry["message"] == "entry 4"
    store.compact(force=True)
    with pytest.raises(ValueError):
        next(store.pages(5, (block, ordinal)))


def test_entries_go_to_the_shard_of_their_key(spark):
    entries = [(1, "info", "m", {"request_id": "r1", "service": "a"}), (2, "info", "m", {"trace_id": "t"}), (3, "info", "only text", {}), (4, "info", None, None), (5, "info", "m", {"request_id": None, "service": "b"})]
    got = [r["s"] for r in spark.createDataFrame(entries, SCHEMA).orderBy("timestamp_us").select(shard(8).alias("s")).collect()]
    assert got == [shard_of(e, 8) for e in entries] and len(set(got)) > 1


def test_a_full_queue_is_flushed(spark, tmp_path):
    log = Emberlog(spark, str(tmp_path / "s"), Config(flush_rows=10, shards=2))
    log.ingest([{"message": "same key", "metadata": {"service": "a"}}] * 9)
    assert log.queued == 9 and log.store.count(LogFilter()) == 0
    log.ingest([{"message": "same key", "metadata": {"service": "a"}}])
    assert log.queued == 0 and log.store.count(LogFilter()) == 10 and len(log.tail) == 0 and len(log.recent(100)) == 10


def test_upkeep_flushes_by_time(spark, tmp_path):
    log = Emberlog(spark, str(tmp_path / "s"), Config(flush_seconds=0.05))
    log.start()
    log.ingest([{"message": "one"}])
    end = time.monotonic() + 20
    while log.queued or len(log.tail):
        assert time.monotonic() < end
        time.sleep(0.05)
    log.close()
    assert log.store.count(LogFilter()) == 1


def test_uncompacted_bytes_hold_writers_back(spark, tmp_path):
    seen = []
    telemetry.attach("held", ["ingest.backpressure"], lambda *e: seen.append(e))
    try:
        log = Emberlog(spark, str(tmp_path / "s"), Config(raw_debt_limit=10, retention_max_age=None))
        log.ingest([{"message": "one"}])
        log.flush()
        assert log.store.raw_debt() > 10
        log.ingest([{"message": "two"}])  # compacts first
    finally:
        telemetry.detach("held")
    assert seen and log.store.raw_debt() == 0 and log.count() == 2


def test_the_tail_is_swept_and_bounded():
    tail = Tail(most=4, seconds=10)
    names = tail.add([(i * 1_000_000, "info", str(i), {}) for i in range(8)])
    tail.sweep(100_000_000)
    assert len(tail) == 8  # nothing that isn't stored goes
    tail.stored(names[:6])
    assert len(tail) == 2 and [e[2] for e in tail.take(LogFilter(), 3)] == ["7", "6", "5"]
    tail.sweep(14_000_000)
    assert [e[2] for e in tail.take(LogFilter(), 9, True)] == ["4", "5", "6", "7"]
    tail.sweep(100_000_000)
    assert [e[2] for e in tail.take(LogFilter.of(message="7"), 9)] == ["7"] and len(tail.fresh()) == 2
    memory = Tail(most=3, only=True)
    memory.add([(i, "info", str(i), {}) for i in range(10)])
    assert [e[2] for e in memory.fresh()] == ["7", "8", "9"] and memory.prune_before(9) == 2


def test_handlers_are_installed_once(spark):
    import logging

    log, logger = Emberlog(spark), logging.getLogger("install")
    a, b = install(log, logger), install(log, logger, logging.ERROR)
    assert a is b and isinstance(a, EmberlogHandler) and logger.handlers == [a] and a.level == logging.ERROR
    uninstall(a, logger)
    assert not logger.handlers


def test_a_store_without_versions_is_empty_and_one_that_lost_some_is_refused(store):
    assert store.count(LogFilter()) == 0 and store.entries().count() == 0 and list(store.pages(3)) == [] and store.damaged() == []
    assert digest.digest(store.entries())[0] == 0 and store.vacuum() == 0
    add(store, 1)
    add(store, 1, 1)
    store.fs.delete(store._hadoop(store._version_file(1)), False)
    with pytest.raises(store_module.Damaged):
        LogStore(store.spark, store.path).count(LogFilter())
    assert json.loads(store._read(store._version_file(2)))["add"]


@pytest.mark.parametrize("local", [20_000, 3])
def test_merging_more_blocks_than_one_read_names(spark, tmp_path, monkeypatch, local):
    monkeypatch.setattr(store_module, "NAMED_FILES", 2)
    monkeypatch.setattr(store_module, "LOCAL_BLOCKS", local)
    store = LogStore(spark, str(tmp_path / "store"), Config(compaction_rows=5, merge_target_rows=20, retention_max_age=None))
    add(store, 40)
    assert store.compact(force=True) == "ok" and store.catalogue().count() >= 8
    before = digest.digest(store.entries())
    assert store.merge() == "ok" and store.catalogue().count() <= 3
    assert digest.digest(store.entries()) == before and numbers(store.entries()) == list(range(40))


def test_pages_go_on_in_the_next_block_and_sort_pieces(store, monkeypatch):
    monkeypatch.setattr(store_module, "PAGE_READ", 2, raising=False)
    monkeypatch.setattr(store_module, "MOST_PAGE_READ", 3, raising=False)
    for k in range(3):
        add(store, 7, 7 * k)
    pages = list(store.pages(5))
    assert [len(p) for p in pages] == [5, 5, 5, 5, 1] and [int(e["metadata"]["n"]) for p in pages for _, _, e in p] == list(range(21))
    for p in range(4):
        assert list(store.pages(5, pages[p][-1][:2])) == pages[p + 1 :]
