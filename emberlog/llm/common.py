"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import gc
import os
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of rows that go to or come from a Python worker at once; a worker holds several copies of that.
BATCH_BYTES = 4 << 20
#: Bytes of text that one numpy step works on at most (a single longer text is cut at a blank).
CHUNK_BYTES = 1 << 18


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; one of our own only where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        jsc = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = jsc.get() if jsc.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="emberlog-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


_STAGED: list[tuple[SparkSession, str]] = []


def _forget() -> None:
    while _STAGED:
        spark, path = _STAGED.pop()
        try:
            drop_path(spark, path)
        except Exception:  # the session has already ended
            return


atexit.register(_forget)


def drop_path(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def bound_batches(spark: SparkSession) -> None:
    """Lowers the session's limit of an Arrow batch to BATCH_BYTES, so that long texts don't fill the workers' memory."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(re.sub(r"\D", "", spark.conf.get(name)) or 0) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def staged_path(spark: SparkSession, tag: str) -> str:
    bound_batches(spark)
    path = f"{shared_dir(spark)}/emberlog-{tag}-{uuid.uuid4().hex}"
    _STAGED.append((spark, path))
    return path


def stage(df: DataFrame, tag: str, codec: str = "zstd") -> DataFrame:
    """Write df as Parquet in the shared folder and read it back.

    Cuts the lineage durably: a lost executor costs only the tasks it ran, and what
    follows reads files instead of computing df anew.  Deleted when Python ends.
    """
    path = staged_path(df.sparkSession, tag)
    df.write.option("compression", codec).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._emberlog_path = path
    return out


def unstage(*frames: DataFrame) -> None:
    """Deletes tables that stage() made and nothing will read again, and lets Spark drop shuffle files that nothing refers to.

    Spark frees shuffle files when the JVM's collector finds their plans gone, which a long
    driver program would otherwise leave to chance.
    """
    for df in frames:
        drop_path(df.sparkSession, df._emberlog_path)
        _STAGED.remove((df.sparkSession, df._emberlog_path))
    gc.collect()
    frames[0].sparkSession.sparkContext._jvm.System.gc()


def if_small(df: DataFrame, rows: int, limit: int) -> DataFrame:
    """df with a broadcast hint where a count has shown it to be within limit; else as it is."""
    return F.broadcast(df) if rows <= limit else df


def id_crc(col: str) -> Column:
    """crc32 of the id written as text; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary"))


def text_of(col: str = "text") -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def utf8(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array without nulls, and the offset of each text (one more at the end)."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    kind = np.int64 if pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type) else np.int32
    if len(array) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = array.buffers()
    at = np.frombuffer(offsets, kind)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def filled(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A column of texts, null ones empty."""
    column = batch.column(name)
    if not (pa.types.is_string(column.type) or pa.types.is_large_string(column.type)):
        column = column.cast(pa.string())
    return pc.fill_null(column, "") if column.null_count else column


#: Of each byte: is it one of \x20, \x09-\x0D?
BLANK = np.zeros(256, bool)
BLANK[[32, 9, 10, 11, 12, 13]] = True


def runs(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts that hold at most so many bytes together, one text at least."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def odd_multipliers(seed: int, n: int) -> np.ndarray:
    """n fixed odd 64-bit numbers."""
    return np.random.default_rng(seed).integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit (xor-shift and multiply)."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def single_threaded() -> None:
    """Keeps native libraries in a worker to the one core that its task has."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")


def codepoints(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of texts given as bytes, and the offset of each text; bad bytes become U+FFFD."""
    points = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), "<u4")
    lead = (raw & 0xC0) != 0x80
    if int(lead.sum()) == len(points):
        at = np.concatenate([[0], np.cumsum(lead)])[offsets]
        return points, at
    each = [raw[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    return np.frombuffer("".join(each).encode("utf-32-le"), "<u4"), np.concatenate([[0], np.cumsum([len(x) for x in each])]).astype(np.int64)


def pieces(raw: np.ndarray, offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, offsets, index of the text of each piece): whole texts, or parts of a text longer than most, cut before a blank.

    Parts follow one another.  Memory stays bounded however long a text is; a run of more
    than most bytes without a blank is cut at a character.
    """
    for lo, hi in runs(offsets, most):
        if offsets[hi] - offsets[lo] <= most:
            yield raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], np.arange(lo, hi)
            continue
        at, end = int(offsets[lo]), int(offsets[lo + 1])
        while at < end:
            stop = min(at + most, end)
            if stop < end:
                blanks = np.flatnonzero(BLANK[raw[at + 1 : stop]])
                if len(blanks):
                    stop = at + 1 + int(blanks[-1])
                else:
                    while stop > at + 1 and (raw[stop] & 0xC0) == 0x80:
                        stop -= 1
            yield raw[at:stop], np.array([0, stop - at]), np.array([lo])
            at = stop


def appended(df: DataFrame, columns: dict[str, str], make) -> DataFrame:
    """df with columns that make(batch) returns as arrays; make gets an Arrow batch with all of df's columns.

    One pass without a shuffle: rows stream through Python in batches and keep all their columns.
    """
    from pyspark.sql.types import StructType

    added = StructType.fromDDL(", ".join(f"`{k}` {v}" for k, v in columns.items()))
    schema = StructType([*df.schema.fields, *added.fields])
    bound_batches(df.sparkSession)

    def over(batches):
        for batch in batches:
            new = make(batch)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(new[k] for k in columns)], names=[*batch.schema.names, *columns])

    return df.mapInArrow(over, schema)
