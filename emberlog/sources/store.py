"""A store of entries: immutable Parquet blocks, a versioned catalogue, and their maintenance.

Layout below the store's path:

* ``segments/<id>/``: the blocks (files) of one write.
* ``versions/<n>.json``: what version n adds to the catalogue and takes from it, the store's counters, and the name of the batch that it holds.
* ``folds/<n>/`` with ``folds/<n>.json``: the whole catalogue at version n, made now and then so that few versions are read.
* ``parts/<id>/``: catalogue rows of a write that has too many for a version file.  ``terms/<id>/``: terms of blocks that have too many for a catalogue row.

A catalogue row names a block with its counts, times and size, how many entries each of its terms has, and which looked-up keys it has
that terms don't cover.  So blocks are chosen, and most counts answered, before any file is opened.

**Writers.**  Files are written first; then one version file is created, which fails if another writer has made that version.  The loser
looks at the new version and tries again, and gives up if blocks that it meant to replace are gone.  Writers in one process also share a lock.  A rewrite
is published only if it holds as many entries as what it replaces, and nothing is read leniently: a block that can't be
read stays as it is.  A batch's name is in the version that adds its entries: a batch is in once, or not at all.

**Readers** work on one version.  Files that a version gave up are deleted by ``vacuum`` only after ``vacuum_grace`` seconds, which must be longer than
any query or write takes.  File names are relative: a store may be moved.
"""

from __future__ import annotations

import json
import os
import re
import threading
import time
import uuid
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberlog import telemetry
from emberlog.config import Config
from emberlog.functions.terms import COLUMN_KEYS, TERM_KEYS, is_term, term_like
from emberlog.operators import catalogue as cat
from emberlog.plans.filters import ALIASES, LogFilter, as_text, column_name
from emberlog.sources.model import ENTRY, from_records

SCHEMA_VERSION = 2
_NUMBERS = ("entry_count", "byte_size", "ts_min", "ts_max", "terms", "written_us")
BLOCK = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("block", "segment", "format")]
    + [T.StructField(n, T.LongType()) for n in _NUMBERS]
    + [T.StructField("counts", T.MapType(T.StringType(), T.LongType())), T.StructField("complete", T.BooleanType()), T.StructField("unposted", T.ArrayType(T.StringType()))]
)
_ARROW = pa.schema(
    [(n, pa.string()) for n in ("block", "segment", "format")]
    + [(n, pa.int64()) for n in _NUMBERS]
    + [("counts", pa.map_(pa.string(), pa.int64())), ("complete", pa.bool_()), ("unposted", pa.list_(pa.string()))]
)
STORED = T.StructType([*ENTRY.fields, *[T.StructField(column_name(k), T.StringType()) for k in COLUMN_KEYS]])
LEVEL_TERM = "level:"
#: Looked-up keys whose values get no terms.
UNPOSTED = tuple(k for k in COLUMN_KEYS if k not in TERM_KEYS)
#: Terms that a catalogue row holds at most.
MAX_TERMS = 200
#: Catalogue rows that are kept in this process, or written into a version file, at most; beyond, they are Parquet.
LOCAL_BLOCKS = 20_000
#: Files that one read names at most; beyond, whole segments are read and joined with the names.
NAMED_FILES = 10_000
#: Names up to which that join is by broadcast (some 100 MB).
NAMES_BROADCAST = 1_000_000
#: Versions after which the catalogue is folded.
FOLD_EVERY = 50
#: Entries of a page and before it up to which its first time is looked for.
MOST_TIMES = 100_000
#: Entries of a block that pages sort at once: so many first, then four times as many each time, up to the second.
PAGE_READ, MOST_PAGE_READ = 1_000, 100_000
NO_LIFE = {"compactions": 0, "raw_bytes_in": 0, "bytes_out": 0, "malformed": 0, "raw_bytes": 0}

_LOCKS: dict[str, threading.RLock] = {}
_LOCKS_LOCK = threading.Lock()


class Conflict(RuntimeError):
    """Another writer took away blocks that this one meant to replace."""


class Damaged(RuntimeError):
    """A rewrite didn't hold what it should replace."""


@dataclass
class Seen:
    """The catalogue at one version: a fold, and what came since."""

    version: int = 0
    fold: int = 0
    fold_at: str = ""
    base: dict[str, dict] | None = field(default_factory=dict)  # the fold's rows, if they are few
    added: dict[str, dict] = field(default_factory=dict)
    parts: list[str] = field(default_factory=list)
    gone: set[str] = field(default_factory=set)
    life: dict = field(default_factory=lambda: dict(NO_LIFE))
    batches: dict[str, int] = field(default_factory=dict)
    frame: DataFrame | None = None

    @property
    def local(self) -> bool:
        return self.base is not None and not self.parts

    def rows(self) -> list[dict]:
        return [r for k, r in {**(self.base or {}), **self.added}.items() if k not in self.gone]

    def holds(self, batch: str) -> bool:
        name, number = _numbered(batch)
        return self.batches.get(name, -1) >= number


def _numbered(batch: str) -> tuple[str, int]:
    """A stream's batches come in order: ``name#7`` means that those before it are in, too."""
    m = re.fullmatch(r"(.*)#(\d+)", batch, re.DOTALL)
    return (m[1] + "#", int(m[2])) if m else (batch, 0)


class LogStore:
    """Entries at a path that Spark can write."""

    def __init__(self, spark: SparkSession, path: str, config: Config | None = None, clock=None):
        self.spark, self.path, self.config = spark, path.rstrip("/"), config or Config()
        self.clock = clock or (lambda: time.time_ns() // 1000)
        self._jvm = spark.sparkContext._jvm
        root = self._hadoop("")
        self.fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._is_local = str(self.fs.getUri()).startswith("file:")
        with _LOCKS_LOCK:
            self.lock = _LOCKS.setdefault(str(self.fs.makeQualified(root)), threading.RLock())
        self.fs.mkdirs(root)
        self._now: Seen | None = None
        self.bad: set[str] = set()  # blocks that this process found unreadable

    # small files

    def _hadoop(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _read(self, name: str) -> str | None:
        path = self._hadoop(name)
        if not self.fs.exists(path):
            return None
        stream = self.fs.open(path)
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def _create(self, name: str, text: str) -> bool:
        """Makes a small file whole, unless there is one: then False."""
        target = self._hadoop(name)
        self.fs.mkdirs(target.getParent())
        if self._is_local:  # Hadoop's local rename is not exclusive, a hard link is
            own = target.toUri().getPath()
            beside = f"{os.path.dirname(own)}/.{uuid.uuid4().hex}"
            with open(beside, "w") as f:
                f.write(text)
                f.flush()
                os.fsync(f.fileno())
            try:
                os.link(beside, own)
                return True
            except FileExistsError:
                return False
            finally:
                os.unlink(beside)
        beside = self._hadoop(f".{uuid.uuid4().hex}")
        stream = self.fs.create(beside, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        try:
            context.rename(beside, target, self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0))
            return True
        except Exception:
            self.fs.delete(beside, False)
            if self.fs.exists(target):
                return False
            raise

    def _names(self, folder: str) -> list:
        path = self._hadoop(folder)
        return list(self.fs.listStatus(path)) if self.fs.exists(path) else []

    # catalogue

    def _version_file(self, n: int) -> str:
        return f"versions/{n:020d}.json"

    def seen(self) -> Seen:
        """The newest version."""
        with self.lock:
            now = self._now
            if now is None or now.version and not self.fs.exists(self._hadoop(self._version_file(now.version))):
                now = self._loaded()
            while (text := self._read(self._version_file(now.version + 1))) is not None:
                now = self._after(now, json.loads(text))
            self._now = now
            return now

    def _loaded(self) -> Seen:
        folds = [int(n[:-5]) for x in self._names("folds") if (n := x.getPath().getName()).endswith(".json") and n[0] != "."]
        if not folds:
            versions = [int(n[:-5]) for x in self._names("versions") if (n := x.getPath().getName()).endswith(".json") and n[0] != "."]
            if versions and min(versions) > 1:
                raise Damaged("versions are missing")
            return Seen()
        n = max(folds)
        said = json.loads(self._read(f"folds/{n}.json"))
        base = None
        if said["rows"] <= LOCAL_BLOCKS:
            base = {r["block"]: r for r in map(_plain, self.spark.read.schema(BLOCK).parquet(f"{self.path}/{said['at']}").collect())}
        return Seen(n, n, said["at"], base, life=said["life"], batches=said["batches"])

    @staticmethod
    def _after(now: Seen, change: dict) -> Seen:
        gone = set(change["gone"])
        added = {k: r for k, r in now.added.items() if k not in gone} | {r["block"]: r for r in change["add"]}
        batches = now.batches
        if change["batch"] is not None:
            name, number = _numbered(change["batch"])
            batches = {**batches, name: number}
        return Seen(now.version + 1, now.fold, now.fold_at, now.base, added, now.parts + ([change["add_at"]] if change["add_at"] else []), now.gone | gone, change["life"], batches)

    def _frame(self, rows: list[dict]) -> DataFrame:
        """Few catalogue rows as a local relation: Spark filters them without a job."""
        rows = [r | {"counts": None if r["counts"] is None else list(r["counts"].items())} for r in rows]
        return self.spark.createDataFrame(pa.Table.from_pylist(rows, _ARROW), BLOCK)

    def catalogue(self, seen: Seen | None = None) -> DataFrame:
        """A row per block of a version, the newest by default."""
        seen = seen or self.seen()
        if seen.frame is None:
            if seen.local:
                seen.frame = self._frame(seen.rows())
            else:
                gone = self.spark.createDataFrame(pa.table({"block": sorted(seen.gone)}, pa.schema([("block", pa.string())])), "block string")
                found = self._frame([r for k, r in seen.added.items() if k not in seen.gone])
                for part in [*([seen.fold_at] if seen.fold else []), *seen.parts]:
                    kept = self.spark.read.schema(BLOCK).parquet(f"{self.path}/{part}")
                    found = found.unionByName(kept.join(F.broadcast(gone), "block", "left_anti") if seen.gone else kept)  # few: a fold ends them
                seen.frame = found
        return seen.frame

    def postings(self) -> DataFrame:
        """block, term, entry_count of all blocks."""
        live = self.catalogue()
        found = live.where("complete").select("block", F.explode("counts").alias("term", "entry_count"))
        wide = live.where("not complete")
        segments = [r[0] for r in wide.select("segment").distinct().collect()]
        if segments:
            found = found.unionByName(self.spark.read.schema("block string, term string, entry_count long").parquet(*[f"{self.path}/terms/{s}" for s in segments]).join(wide.select("block"), "block", "left_semi"))
        return found

    def _commit(self, make: Callable[[Seen], dict | None], then: Callable[[], None] | None = None) -> Seen | None:
        """Publishes what make returns for the newest version; make is asked again if another writer was first."""
        with self.lock:
            while True:
                seen = self.seen()
                change = make(seen)
                if change is None:
                    return None
                change = {"schema": SCHEMA_VERSION, "at_us": time.time_ns() // 1000, "add": [], "add_at": None, "gone": [], "batch": None, "life": seen.life} | change
                if self._create(self._version_file(seen.version + 1), json.dumps(change)):
                    break
            if then is not None:
                then()
            seen = self.seen()
        if seen.version - seen.fold >= FOLD_EVERY or len(seen.added) + len(seen.gone) > LOCAL_BLOCKS:
            try:
                self.fold()
            except Exception as failed:  # the change is in all the same
                telemetry.event("compaction.error", {}, {"reason": repr(failed)})
        return seen

    def fold(self) -> None:
        """Writes the whole catalogue of the newest version, so that readers start there."""
        seen = self.seen()
        if seen.version == seen.fold:
            return
        rows = self.catalogue(seen)
        n = len(seen.rows()) if seen.local else rows.count()
        at = f"folds/{seen.version}-{uuid.uuid4().hex}"
        rows.coalesce(1 + n // 500_000).write.parquet(f"{self.path}/{at}")
        self._create(f"folds/{seen.version}.json", json.dumps({"at": at, "rows": n, "life": seen.life, "batches": seen.batches}))
        with self.lock:
            self._now = None

    # writing

    def _write(self, entries: DataFrame, fmt: str, batches: int | None = None) -> str:
        """Writes one segment and returns its name.  With batches, entries have a ``_batch`` that keeps files apart."""
        segment = uuid.uuid4().hex
        m = F.coalesce("metadata", F.create_map().cast("map<string,string>"))
        keys = {column_name(k): F.when(F.map_contains_key("metadata", F.lit(k)), F.coalesce(F.try_element_at("metadata", F.lit(k)), F.lit("null"))) for k in COLUMN_KEYS}
        if fmt == "raw":
            d, options = entries, {"compression": "lz4"}
        else:
            if batches is not None:
                d = entries.repartition(batches, "_batch").sortWithinPartitions("_batch", "timestamp_us").drop("_batch")
            else:
                d = entries.repartitionByRange("timestamp_us").sortWithinPartitions("timestamp_us")
            options = {"compression": "zstd", "parquet.compression.codec.zstd.level": self.codec_level(), "maxRecordsPerFile": 0 if batches is not None else self.config.compaction_rows}
        if not set(keys) <= set(d.columns):  # a rewrite may bring them along
            d = d.withColumn("metadata", m).withColumns(keys)
        d.select(*STORED.names).write.options(**options).parquet(f"{self.path}/segments/{segment}")
        return segment

    def _described(self, segment: str, fmt: str) -> tuple[list[dict], str | None, int, int]:
        """A new segment's catalogue rows (or the folder that holds them, if they are many), its entries and bytes: one job over times, levels and term columns."""
        home = f"{self.path}/segments/{segment}"
        files = [x for x in self.fs.listStatus(self._hadoop(f"segments/{segment}")) if x.getPath().getName().endswith(".parquet")]
        if not files:
            return [], None, 0, 0
        d = self.spark.read.schema(STORED).parquet(home).select("*", F.concat(F.lit(f"{segment}/"), F.col("_metadata.file_name")).alias("block"), F.col("_metadata.file_size").alias("byte_size"))
        # equal rows of looked-up values are counted first: they are few, and only they are turned into terms
        values = {"level": F.col("level"), **{k: F.col(column_name(k)) for k in TERM_KEYS}}
        has = {k: F.when(F.col(column_name(k)).isNotNull(), F.lit(k)) for k in UNPOSTED}
        named = [c.alias(f"v{i}") for i, c in enumerate([*values.values(), *has.values()])]
        d = d.groupBy("block", "byte_size", *named).agg(F.count("*").alias("n"), F.min("timestamp_us").alias("lo"), F.max("timestamp_us").alias("hi"))
        pairs = [F.struct(F.lit("#").alias("k"), F.lit("").alias("v")), *(F.struct(F.lit(k).alias("k"), F.col(f"v{i}").alias("v")) for i, k in enumerate([*values, *["?"] * len(has)]))]
        t = d.select("block", "byte_size", "n", "lo", "hi", F.inline(F.array(*pairs))).where("v is not null").groupBy("block", "byte_size", "k", "v").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        term = F.col("k").isin(*TERM_KEYS) & is_term(F.col("k"), F.col("v"))
        t = t.where(F.col("k").isin("#", "?", "level") | term).withColumn("term", F.when(~F.col("k").isin("#", "?"), F.concat_ws(":", "k", "v")))
        by = Window.partitionBy("block")
        t = t.withColumn("c", F.count("term").over(by)).withColumn("cl", F.count_if(F.col("k") == "level").over(by))
        kept = F.when(F.col("term").isNotNull() & ((F.col("c") <= MAX_TERMS) | (F.col("k") == "level") & (F.col("cl") <= MAX_TERMS)), F.struct("term", "n"))
        one = F.col("k") == "#"
        rows = t.groupBy("block", "byte_size").agg(
            F.max(F.when(one, F.col("n"))).alias("entry_count"), F.max(F.when(one, F.col("lo"))).alias("ts_min"), F.max(F.when(one, F.col("hi"))).alias("ts_max"), F.count("term").alias("terms"),
            F.map_from_entries(F.collect_list(kept)).alias("counts"), (F.max("c") <= MAX_TERMS).alias("complete"), F.collect_set(F.when(F.col("k") == "?", F.col("v"))).alias("unposted"), F.max("cl").alias("cl"),
        )
        rows = rows.withColumns({"segment": F.lit(segment), "format": F.lit(fmt), "written_us": F.lit(self.clock()), "counts": F.when(F.col("cl") <= MAX_TERMS, F.col("counts"))}).select(*BLOCK.names)
        if len(files) <= LOCAL_BLOCKS:
            found, at = [_plain(r) for r in rows.collect()], None
            n, size, wide = sum(r["entry_count"] for r in found), sum(r["byte_size"] for r in found), any(not r["complete"] for r in found)
        else:
            found, at = [], f"parts/{segment}"
            rows.write.parquet(f"{self.path}/{at}")
            n, size, wide = self.spark.read.schema(BLOCK).parquet(f"{self.path}/{at}").agg(F.sum("entry_count"), F.sum("byte_size"), F.count_if(~F.col("complete")) > 0).first()
        if wide:
            t.where(F.col("term").isNotNull() & (F.col("c") > MAX_TERMS)).select("block", "term", F.col("n").alias("entry_count")).sortWithinPartitions("term").write.parquet(f"{self.path}/terms/{segment}")
        return found, at, n, size

    def append(self, entries: DataFrame, batch: str | None = None, then: Callable[[], None] | None = None, rebalance: bool = True) -> int:
        """Adds entries; returns how many.  A named batch that is already in is left out.

        Spark deals the entries among files of a good size, in one shuffle; rebalance=False keeps their partitions, where those are good as they are.
        then is called as the entries become visible, under the store's lock.
        """
        if batch is not None and self.seen().holds(batch):
            return 0
        entries = entries.select(*ENTRY.names)
        segment = self._write(entries.hint("rebalance") if rebalance else entries, "raw")
        rows, at, n, size = self._described(segment, "raw")
        if not n:
            self._discard(segment)

        def make(seen: Seen) -> dict | None:
            if batch is not None and seen.holds(batch) or not n and batch is None:
                return None
            return {"add": rows, "add_at": at, "batch": batch, "life": seen.life | {"raw_bytes": seen.life["raw_bytes"] + size}}

        if self._commit(make, then) is None:
            self._discard(segment)
            return 0
        return n

    def _discard(self, segment: str) -> None:
        for part in ("segments", "terms", "parts"):
            self.fs.delete(self._hadoop(f"{part}/{segment}"), True)

    def ingest(self, records: Iterable[dict]) -> int:
        return self.append(from_records(self.spark, records, self.clock()))

    def note_malformed(self, n: int) -> None:
        self._commit(lambda seen: {"life": seen.life | {"malformed": seen.life["malformed"] + n}})

    # reading

    def _rows(self, blocks: DataFrame, named: bool = False) -> DataFrame:
        """The entries of blocks, with their ``block`` if named.  A file that can't be read fails the query."""
        names = [r["block"] for r in blocks.select("block").limit(NAMED_FILES + 1).collect()]
        names = [x for x in names if x not in self.bad]
        if not names:
            none = self.spark.createDataFrame(pa.table({f.name: [] for f in STORED.fields}), STORED)
            return none.withColumn("block", F.lit("")) if named else none
        reader = self.spark.read.schema(STORED)
        if len(names) <= NAMED_FILES:
            d = reader.parquet(*[f"{self.path}/segments/{x}" for x in names])
            return d.withColumn("block", block_of_file()) if named else d
        segments = [r[0] for r in blocks.select("segment").distinct().toLocalIterator()]
        d = reader.parquet(*[f"{self.path}/segments/{s}" for s in segments]).withColumn("block", block_of_file())
        wanted = blocks.select("block").where(~F.col("block").isin(*sorted(self.bad)) if self.bad else F.lit(True))
        d = d.join(F.broadcast(wanted) if blocks.count() <= NAMES_BROADCAST else wanted, "block", "left_semi")
        return d if named else d.drop("block")  # a file's name can't be asked for behind the join

    def blocks_for(self, where: LogFilter, seen: Seen | None = None) -> DataFrame:
        """Blocks that can hold matching entries: by time range, levels, and terms of metadata."""
        found = self.catalogue(seen)
        if where.nothing:
            return found.where(F.lit(False))
        for since in where.since:
            found = cat.overlapping(found, since, None)
        for until in where.until:
            found = cat.overlapping(found, None, until)
        for level in where.levels:
            found = found.where(F.col("counts").isNull() | F.map_contains_key("counts", F.lit(LEVEL_TERM + level)))
        for key, value in where.metadata.items():
            terms = _terms_of(key, value)
            if terms is not None:
                posted, others = terms
                here = F.lit(False)
                for term in posted:
                    here |= F.map_contains_key("counts", F.lit(term))
                found = found.where(F.coalesce(~F.col("complete"), F.lit(True)) | F.col("counts").isNull() | here | _has_any("unposted", others))
        return found

    def entries(self, where: LogFilter | None = None, seen: Seen | None = None) -> DataFrame:
        """The entries that match: pruned files, then one filter that Spark pushes into the scan."""
        where = where or LogFilter()
        return where.apply(self._rows(self.blocks_for(where, seen)))

    def newest_first(self, where: LogFilter, need: int, seen: Seen | None = None) -> DataFrame:
        """Entries that surely contain the newest ``need`` matches.

        Blocks are taken from the newest until those that lie wholly behind a time hold enough: as the catalogue says, where
        the filter is one level or none; else as their times say, of four times as many entries each time.  The times alone are read first, then
        the entries from the time of the last that is needed.
        """
        found = self.blocks_for(where, seen)
        simple = not where.messages and not where.metadata and len(where.levels) <= 1 and not where.since and not where.until
        amount = F.col("entry_count")
        if where.levels:
            amount = F.coalesce(F.try_element_at("counts", F.lit(LEVEL_TERM + where.levels[0])), F.lit(0))
        newest = found.where("ts_min is not null").select("ts_min", amount.alias("n")).coalesce(1).sortWithinPartitions(F.desc("ts_min"))
        held, want, last = 0, need, None
        for r in newest.toLocalIterator():  # stops early; rows of the catalogue
            if held >= want and r["ts_min"] != last:
                part = where.apply(self._rows(found.where(F.col("ts_max") >= last)))
                if need > MOST_TIMES:
                    if simple:
                        return part
                else:
                    times = part.where(F.col("timestamp_us") >= last).select("timestamp_us").orderBy(F.desc("timestamp_us")).limit(need).agg(F.count("*"), F.min("timestamp_us")).first()
                    if times[0] >= need:
                        return part.where(F.col("timestamp_us") >= times[1])
                want *= 4
            held, last = held + r["n"], r["ts_min"]
        return where.apply(self._rows(found))

    def count(self, where: LogFilter, seen: Seen | None = None) -> int:
        """Exact; a filter by time and one level or term takes whole blocks' counts from the catalogue and reads the rest."""
        found = self.blocks_for(where, seen)
        terms = next((_terms_of(k, v) for k, v in where.metadata.items()), None)
        if where.messages or where.nothing or len(where.levels) + len(where.metadata) > 1 or where.metadata and terms is None:
            return where.apply(self._rows(found)).count()
        since, until = max(where.since, default=-(1 << 62)), min(where.until, default=1 << 62)
        sure = (F.col("ts_min") >= since) & (F.col("ts_max") <= until) if where.since or where.until else F.lit(True)
        if where.levels:
            amount, sure = F.coalesce(F.try_element_at("counts", F.lit(LEVEL_TERM + where.levels[0])), F.lit(0)), sure & F.col("counts").isNotNull()
        elif terms is not None:
            each = [F.coalesce(F.try_element_at("counts", F.lit(t)), F.lit(0)) for t in terms[0]]
            amount = sum(each[1:], each[0])
            # an entry may have two of the aliases: then the block is read
            several = sum(((x > 0).cast("int") for x in each[1:]), (each[0] > 0).cast("int"))
            sure = sure & F.coalesce(F.col("complete"), F.lit(False)) & (several <= 1) & ~_has_any("unposted", terms[1])
        else:
            amount = F.col("entry_count")
        sure = F.coalesce(sure, F.lit(False))
        if self.bad:
            found = found.where(~F.col("block").isin(*sorted(self.bad)))
        n, rest = found.agg(F.coalesce(F.sum(F.when(sure, amount)), F.lit(0)), F.count_if(~sure)).first()
        return n + (where.apply(self._rows(found.where(~sure))).count() if rest else 0)

    def pages(self, size: int, after: tuple[str, int] | None = None) -> Iterator[list]:
        """Pages of (block, ordinal, entry) in a fixed order, from behind a cursor (block, ordinal).

        A page goes on in the next block where one ends: only the last is shorter.  A block is sorted in pieces of bounded size.
        """
        order = F.struct(F.coalesce("ts_min", F.lit(-(1 << 62))), "block")
        live = self.catalogue()
        if after is not None:
            at = live.where(F.col("block") == after[0]).select(order.alias("o")).first()
            if at is None:
                raise ValueError("the cursor's block is not in the store any more")
            live = live.where(order >= F.struct(F.lit(at["o"][0]), F.lit(at["o"][1])))
        page = []
        for r in live.coalesce(1).sortWithinPartitions(order).select("block", "entry_count").toLocalIterator():
            d = self.spark.read.schema(STORED).parquet(f"{self.path}/segments/{r['block']}").select("*", F.col("_metadata.row_index").alias("_i"))
            lo, width = after[1] + 1 if after is not None and r["block"] == after[0] else 0, PAGE_READ
            while lo < r["entry_count"]:
                part = d.where((F.col("_i") >= lo) & (F.col("_i") < lo + width))
                for row in part.repartition(1).sortWithinPartitions("_i").toLocalIterator():
                    page.append((r["block"], row["_i"], row))
                    if len(page) == size:
                        yield page
                        page = []
                lo, width = lo + width, min(4 * width, MOST_PAGE_READ)
        if page:
            yield page

    def damaged(self, blocks: DataFrame | None = None) -> list[str]:
        """Blocks of which fewer entries can be read than they have.  Reported as ``block.error`` and left out by this process from now on."""
        live = (blocks if blocks is not None else self.catalogue()).select("block", "entry_count")
        if blocks is None and self.bad:
            live = live.where(~F.col("block").isin(*sorted(self.bad)))
        names = [(r["block"], r["entry_count"]) for r in live.toLocalIterator()]
        if not names:
            return []
        reader = self.spark.read.schema(STORED).option("ignoreMissingFiles", True).option("ignoreCorruptFiles", True)
        there = [x for x, _ in names if self.fs.exists(self._hadoop(f"segments/{x}"))]
        got = {}
        for lo in range(0, len(there), NAMED_FILES):
            d = reader.parquet(*[f"{self.path}/segments/{x}" for x in there[lo : lo + NAMED_FILES]])
            whole = F.xxhash64("message", "level", F.size("metadata"))  # makes the scan read the columns, not only the footer
            got |= {r["b"]: r["n"] for r in d.select(block_of_file().alias("b"), whole.alias("h")).groupBy("b").agg(F.count("*").alias("n"), F.max("h")).collect()}
        bad = [x for x, n in names if got.get(x, 0) != n]
        for x in bad:
            telemetry.event("block.error", {"entry_count": dict(names)[x]}, {"block": x, "reason": "corrupt_block" if x in there else "missing_block"})
        self.bad |= set(bad)
        return bad

    # figures

    def stats(self) -> DataFrame:
        """One row of totals, by format and over the store's life."""
        sums = lambda test, name: [F.count_if(test).alias(f"{name}_blocks"), F.coalesce(F.sum(F.when(test, F.col("byte_size"))), F.lit(0)).alias(f"{name}_bytes"), F.coalesce(F.sum(F.when(test, F.col("entry_count"))), F.lit(0)).alias(f"{name}_entries")]
        raw = F.col("format") == "raw"
        seen = self.seen()
        return self.catalogue(seen).agg(
            F.count("*").alias("total_blocks"), F.coalesce(F.sum("entry_count"), F.lit(0)).alias("total_entries"), F.coalesce(F.sum("byte_size"), F.lit(0)).alias("total_bytes"),
            F.coalesce(F.sum("terms"), F.lit(0)).alias("index_terms"), F.min("ts_min").alias("oldest_timestamp"), F.max("ts_max").alias("newest_timestamp"), F.min(F.when(raw, F.col("written_us"))).alias("oldest_raw_us"),
            *sums(raw, "raw"), *sums(~raw, "compressed"), *(F.lit(seen.life[k]).alias(k) for k in ("compactions", "raw_bytes_in", "bytes_out", "malformed")),
        )

    def raw_debt(self) -> int:
        """Bytes of blocks that aren't compacted."""
        return self.seen().life["raw_bytes"]

    def codec_level(self) -> int:
        """Of new compressed blocks: lower while uncompacted data are beyond half their limit, so that they shrink sooner."""
        c = self.config
        return c.pressure_codec_level if self.raw_debt() > c.raw_debt_limit // 2 else c.idle_codec_level

    # maintenance

    def compact(self, force: bool = False) -> str:
        """Rewrites raw blocks into sorted, compressed ones: ``ok``, or ``noop`` if there is too little and all is fresh.

        One pass takes the oldest blocks up to a number of entries; ``more`` says that others wait, ``conflict`` that another writer
        took some of them away: nothing was changed then.  Blocks that can't be read are reported and stay as they are.
        """
        raw = self.catalogue().where("format = 'raw'")
        if self.bad:
            raw = raw.where(~F.col("block").isin(*sorted(self.bad)))
        said = raw.agg(F.coalesce(F.sum("entry_count"), F.lit(0)).alias("n"), F.min("written_us").alias("t")).first()
        old = said["t"] is not None and self.clock() - said["t"] >= self.config.compaction_max_raw_age * 1_000_000
        if not said["n"] or not (force or old or said["n"] >= self.config.compaction_threshold):
            return "noop"
        with telemetry.span("compaction.stop") as found:
            part = cat.within_budget(raw, self.config.compaction_pass_rows)
            took = self._replace(part, self._rows)
            if took is None:
                return "conflict"
            found |= {"entry_count": took[0], "byte_size": took[1]}
        return "ok" if took[2] or took[0] == said["n"] else "more"

    def _replace(self, old: DataFrame, read: Callable[[DataFrame], DataFrame], batches: int | None = None) -> tuple[int, int, bool] | None:
        """Rewrites old blocks.  (entries, bytes, was any block left out as damaged); None if another writer was at them."""
        rows = [_plain(r) for r in old.select(*BLOCK.names).collect()]  # of one bounded pass
        left = False
        try:
            segment = self._write(read(self._frame(rows)), "zstd", batches)
        except Exception:
            bad = set(self.damaged(self._frame(rows)))
            if not bad:
                raise
            rows, left = [r for r in rows if r["block"] not in bad], True
            if not rows:
                return 0, 0, True
            segment = self._write(read(self._frame(rows)), "zstd", batches)
        new, at, n, size = self._described(segment, "zstd")
        want, was = sum(r["entry_count"] for r in rows), sum(r["byte_size"] for r in rows)
        if n != want:
            self._discard(segment)
            telemetry.event("compaction.error", {"entry_count": want, "read": n}, {"reason": "count"})
            raise Damaged(f"a rewrite of {want} entries holds {n}")
        gone = {r["block"] for r in rows}
        raw = sum(r["byte_size"] for r in rows if r["format"] == "raw")

        def make(seen: Seen) -> dict:
            if not self._all_live(seen, gone):
                raise Conflict
            life = seen.life
            return {"add": new, "add_at": at, "gone": sorted(gone), "life": life | {"compactions": life["compactions"] + 1, "raw_bytes_in": life["raw_bytes_in"] + was, "bytes_out": life["bytes_out"] + size, "raw_bytes": life["raw_bytes"] - raw}}

        try:
            self._commit(make)
        except Conflict:
            self._discard(segment)
            return None
        return n, was, left

    def _all_live(self, seen: Seen, blocks: set[str]) -> bool:
        if seen.local:
            return blocks <= {r["block"] for r in seen.rows()}
        wanted = self.spark.createDataFrame(pa.table({"block": sorted(blocks)}), "block string")
        return self.catalogue(seen).join(F.broadcast(wanted), "block", "left_semi").count() == len(blocks)

    def merge(self) -> str:
        """Joins small compressed blocks, oldest first, into batches of the target size."""
        small = self.catalogue().where((F.col("format") != "raw") & (F.col("entry_count") < self.config.merge_target_rows))
        if self.bad:
            small = small.where(~F.col("block").isin(*sorted(self.bad)))
        if small.count() < self.config.merge_min_blocks:
            return "noop"
        small = cat.within_budget(small, self.config.compaction_pass_rows)
        groups = cat.merge_groups(small, self.config.merge_target_rows)
        groups = self.spark.createDataFrame(groups.toArrow(), "block string, batch long")
        groups = groups.join(groups.groupBy("batch").count().where("count > 1"), "batch", "left_semi")
        n = groups.select("batch").distinct().count()
        if not n:
            return "noop"
        with telemetry.span("merge_compaction.stop") as found:
            batch = F.broadcast(groups.withColumnRenamed("batch", "_batch"))  # of one bounded pass
            read = lambda rows: self._rows(rows, named=True).join(batch, "block").drop("block")
            if self._replace(small.join(groups.select("block"), "block", "left_semi"), read, n) is None:
                return "conflict"
            found |= {"batches_merged": n, "blocks_consumed": groups.count()}
        return "ok"

    def _drop(self, choose: Callable[[DataFrame], DataFrame]) -> int:
        """Takes the chosen blocks out of the catalogue, LOCAL_BLOCKS a version."""
        dropped = 0
        while True:
            took: list = []

            def make(seen: Seen, took=took) -> dict | None:
                rows = choose(self.catalogue(seen)).select("block", "format", "byte_size").limit(LOCAL_BLOCKS).collect()
                took[:] = [r["block"] for r in rows]
                raw = sum(r["byte_size"] for r in rows if r["format"] == "raw")
                return {"gone": took, "life": seen.life | {"raw_bytes": seen.life["raw_bytes"] - raw}} if rows else None

            self._commit(make)
            dropped += len(took)
            if len(took) < LOCAL_BLOCKS:
                return dropped

    def delete_before(self, cutoff: int) -> int:
        """Blocks whose entries are all older than cutoff."""
        return self._drop(lambda c: cat.expired(c, cutoff))

    def delete_over_size(self, most: int) -> int:
        return self._drop(lambda c: cat.over_budget(c, "byte_size", most))

    def delete_over_terms(self, most: int) -> int:
        n = self._drop(lambda c: cat.over_budget(c, "terms", most))
        if n:
            telemetry.event("retention.term_pressure", {"deleted": n, "limit": most})
        return n

    def retain(self) -> str | tuple[str, int]:
        """Applies the configured limits: ``noop`` if there are none, else ("ok", blocks deleted).

        Limits of size and terms wait while raw blocks are beyond their limit: those would shrink first.
        """
        c = self.config
        if c.retention_max_age is None and c.retention_max_size is None and c.retention_max_terms is None:
            return "noop"
        with telemetry.span("retention.stop") as found:
            n = 0 if c.retention_max_age is None else self.delete_before(self.clock() - c.retention_max_age * 1_000_000)
            calm = self.raw_debt() < c.raw_debt_limit
            if calm and c.retention_max_size is not None:
                n += self.delete_over_size(c.retention_max_size)
            if calm and c.retention_max_terms is not None:
                n += self.delete_over_terms(c.retention_max_terms)
            found["blocks_deleted"] = n
        return ("ok", n)

    def vacuum(self, grace: float | None = None) -> int:
        """Deletes files that no version of the last ``grace`` seconds lists, and versions and folds that nobody needs; returns how many files and folders went."""
        grace = self.config.vacuum_grace if grace is None else grace
        since = time.time() - grace
        self.fold()
        seen = self.seen()
        gone = 0
        # what versions of the grace period gave up stays, and those versions as well
        kept, young = set(), []
        for x in self._names("versions"):
            name = x.getPath().getName()
            if not name.endswith(".json") or name[0] == ".":
                continue
            said = json.loads(self._read(f"versions/{name}") or "null")
            if said is not None and (said["at_us"] / 1e6 >= since or int(name[:-5]) >= seen.fold):
                kept |= set(said["gone"]) if said["at_us"] / 1e6 >= since else set()
                young.append(int(name[:-5]))
            elif said is not None:
                gone += bool(self.fs.delete(x.getPath(), False))
        for x in self._names("folds"):
            number = int(re.match(r"\.?(\d+)|", x.getPath().getName())[1] or 0)
            if number < min([seen.fold, *young]) and x.getModificationTime() / 1000 < since:
                gone += bool(self.fs.delete(x.getPath(), True))
        kept_segments = {b.split("/")[0] for b in kept}
        live: dict[str, set[str]] = {}
        for r in self.catalogue(seen).select("segment", "block").toLocalIterator():
            live.setdefault(r["segment"], set()).add(r["block"])
        for x in self._names("segments"):
            name = x.getPath().getName()
            if name not in live and name not in kept_segments:
                if x.getModificationTime() / 1000 < since:  # else it may be a write under way
                    gone += bool(self.fs.delete(x.getPath(), True))
                    for part in ("terms", "parts"):
                        self.fs.delete(self._hadoop(f"{part}/{name}"), True)
            elif x.getModificationTime() / 1000 < since:
                for f in self.fs.listStatus(x.getPath()):
                    block = f"{name}/{f.getPath().getName()}"
                    if block.endswith(".parquet") and block not in live.get(name, ()) and block not in kept:
                        gone += bool(self.fs.delete(f.getPath(), False))
        return gone

    def reindex(self) -> int:
        """Counts all terms and stored columns anew by rewriting every block, a bounded pass at a time; returns the number of blocks before."""
        todo = {r["block"] for r in self.catalogue().select("block").toLocalIterator()}
        n = len(todo)
        while todo:
            part = cat.within_budget(self.catalogue().where(F.col("block").isin(*sorted(todo)[:LOCAL_BLOCKS])), self.config.compaction_pass_rows)
            names = {r["block"] for r in part.select("block").collect()}
            if names:
                self._replace(part, lambda rows: self._rows(rows).select(*ENTRY.names))
            todo -= names or todo
        return n

    def backup(self, target: str) -> dict:
        """Copies one version of the store; returns path, files and total_bytes."""
        self.fold()
        seen = self.seen()
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        path = self._jvm.org.apache.hadoop.fs.Path
        to = path(target)
        other = to.getFileSystem(conf)
        other.mkdirs(to)

        def copy(name: str) -> None:
            other.mkdirs(path(f"{target}/{name}").getParent())
            self._jvm.org.apache.hadoop.fs.FileUtil.copy(self.fs, self._hadoop(name), other, path(f"{target}/{name}"), False, True, conf)

        live = self.catalogue(seen)
        with ThreadPoolExecutor(16) as pool:
            list(pool.map(copy, (f"segments/{r['block']}" for r in live.select("block").toLocalIterator())))
        for r in live.where("not complete").select("segment").distinct().collect():
            copy(f"terms/{r[0]}")
        if seen.version:
            copy(self._version_file(seen.version))
            copy(seen.fold_at)
            copy(f"folds/{seen.fold}.json")  # last: a backup that was cut short has none
        said = other.getContentSummary(to)
        return {"path": target, "files": said.getFileCount(), "total_bytes": said.getLength()}


def block_of_file():
    """Of a row that was read from a store: its block."""
    return F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+/[^/]+)$", 1)


def _plain(r: T.Row) -> dict:
    d = r.asDict()
    return d | {"counts": None if d["counts"] is None else dict(d["counts"]), "unposted": list(d["unposted"] or [])}


def _has_any(column: str, wanted: tuple[str, ...]):
    return F.arrays_overlap(column, F.array(*map(F.lit, wanted))) if wanted else F.lit(False)


def _terms_of(key: str, value: object) -> tuple[list[str], tuple[str, ...]] | None:
    """(terms, keys without terms) that a metadata condition can be met by; None if terms don't decide it."""
    text = as_text(value)
    keys = ALIASES.get(key, (key,))
    posted = [k for k in keys if k in TERM_KEYS]
    if text == "" or not posted or any(k not in COLUMN_KEYS for k in keys) or any(not term_like(k, text) for k in posted):
        return None
    return [f"{k}:{text}" for k in posted], tuple(k for k in keys if k not in TERM_KEYS)

