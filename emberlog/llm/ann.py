"""Nearest neighbours by randomly rotated one-bit codes.

Vectors are centred, scaled to length one and rotated by a seeded random orthogonal matrix; the signs
of the rotated coordinates are packed into bits, beside the distance to the centre and one
correction scalar, the inner product of the code with its vector.  A query's rotated coordinates are rounded to
PLANES bits each; the inner product with a code is then counted on packed words, bit plane by bit plane.  With
the scalars that gives an estimate of each inner product and an error bound, rounding included.  A vector is reranked by its exact
distance if the bound leaves it a chance to be among the k nearest of its block; so
all ties and all near vectors are compared in double precision.

Every row is coded; only the centre is fitted (on all rows, as column means).  Queries go in blocks of a fixed size
against all rows; each task keeps k rows for a query.

Defined cases: vectors that are null, empty, zero or hold null or non-finite numbers take no part;
vectors of different lengths are not compared; ties go to the smaller id, then to the row read first;
a query whose id repeats is searched once for each row and gives rows for each; other rows of the query's
id are candidates, its own row alone is not.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberlog.llm.common import stage

#: Bytes of query vectors that are sent to the executors at once at most.
QUERY_BLOCK_BYTES = 16 << 20
#: Estimates held at once: rows times queries.
CELLS = 4_000_000
#: Standard deviations of the estimate's error that the bound allows for.
EPSILON = 4.0
#: Bits of each coordinate of a query.
PLANES = 6


def rotation(dim: int, seed: int = 7) -> np.ndarray:
    """A random orthogonal matrix (QR of a Gaussian one, signs fixed)."""
    q, r = np.linalg.qr(np.random.default_rng([seed, dim]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def encode(x: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(packed bits, distance to the centre, correction scalar) of the rows of x."""
    d = x - centre
    far = np.sqrt((d * d).sum(axis=1))
    y = d @ turn / np.maximum(far, 1e-300)[:, None]
    return np.packbits(y > 0, axis=1), far, np.abs(y).sum(axis=1) / np.sqrt(x.shape[1])


def words(codes: np.ndarray) -> np.ndarray:
    """Packed bytes as packed 64-bit words, filled up with zeros."""
    full = np.zeros((len(codes), -(-codes.shape[1] // 8) * 8), np.uint8)
    full[:, : codes.shape[1]] = codes
    return full.view(np.uint64)


def bounds(codes: np.ndarray, far: np.ndarray, fit: np.ndarray, queries: np.ndarray, centre: np.ndarray, turn: np.ndarray, epsilon: float = EPSILON) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the squared distances, rows by queries."""
    dim = len(centre)
    d = queries - centre
    qfar = np.sqrt((d * d).sum(axis=1))
    q = d @ turn / np.maximum(qfar, 1e-300)[:, None]
    least = q.min(axis=1)
    step = np.maximum((q.max(axis=1) - least) / ((1 << PLANES) - 1), 1e-12)
    level = np.rint((q - least[:, None]) / step[:, None]).astype(np.uint8)
    off = np.abs(q - (least[:, None] + step[:, None] * level)).sum(axis=1) / np.sqrt(dim)  # the most that rounding changes
    packed = words(codes)
    ones = np.bitwise_count(packed).sum(axis=1, dtype=np.int64)
    planes = [words(np.packbits((level >> b) & 1, axis=1)) for b in reversed(range(PLANES))]
    inner = np.zeros((len(codes), len(queries)), np.float32)
    for w in range(packed.shape[1]):
        count = np.zeros(inner.shape, np.uint16)  # of 64 bits times the levels
        for plane in planes:
            count <<= 1
            count += np.bitwise_count(packed[:, w, None] & plane[None, :, w])
        inner += count
    # signs are 2 bit - 1 and coordinates least + step * level, so each estimate is inner * by[j] and sums of products of a row's and a query's number
    total = level.sum(axis=1, dtype=np.int64)
    fit = np.maximum(fit, 1e-9)
    scale = 2 * far / fit
    by, ahead, rest = (qfar / np.sqrt(dim) * v for v in (2 * step, 2 * least, -(step * total + least * dim)))
    middle = np.stack([far * far, np.ones(len(far)), -scale * ones, -scale], axis=1) @ np.stack([np.ones(len(qfar)), qfar * qfar, ahead, rest])
    middle -= inner * by * scale[:, None]
    wide = epsilon * np.sqrt(np.maximum(1 - fit * fit, 0) / (fit * fit) / max(dim - 1, 1)) + 1e-5
    reach = np.stack([2 * far * wide, scale], axis=1) @ np.stack([qfar, qfar * off])
    return middle - reach, middle + reach


def vectors(array: pa.Array) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """Rows that take part, by length: {length: matrix}, with the row numbers in the first item as {length: rows}."""
    rows: dict[int, list[int]] = {}
    lengths = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(array), 0))
    for n in np.unique(lengths):
        if n > 0:
            rows[int(n)] = np.flatnonzero(lengths == n)
    out, kept = {}, {}
    for n, at in rows.items():
        flat = array.take(pa.array(at)).flatten()
        m = np.asarray(flat.cast(pa.float64()).fill_null(float("nan"))).reshape(len(at), n)
        ok = np.isfinite(m).all(axis=1) & (m != 0).any(axis=1)
        if ok.any():
            kept[n], out[n] = at[ok], m[ok]
    return kept, out


def build_index(df: DataFrame, key: str = "vec_id", vector: str = "embedding", seed: int = 7) -> tuple[DataFrame, dict[int, np.ndarray]]:
    """(index, centres).  index: id, row (its number in the index), dim, vec (float64 bytes), code, far, fit; one row per vector that takes part."""

    def clean(batches):
        for batch in batches:
            kept, found = vectors(batch.column(1))
            for n, m in found.items():
                ids, no = (batch.column(c).take(pa.array(kept[n])) for c in (0, 2))
                yield pa.RecordBatch.from_arrays([ids, no, pa.array(np.full(len(m), n, np.int32)), pa.array([r.tobytes() for r in m], pa.binary())], names=["id", "row", "dim", "vec"])

    given = df.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("given"), F.monotonically_increasing_id().alias("row")).where("id is not null")
    rows = stage(given.mapInArrow(clean, "id long, row long, dim int, vec binary"), "ann-rows")

    def sums(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            dims = np.asarray(batch.column("dim"))
            for n in np.unique(dims):
                m = np.frombuffer(b"".join(batch.column("vec").take(pa.array(np.flatnonzero(dims == n))).to_pylist())).reshape(-1, n)
                total[n] = total.get(n, np.zeros(n + 1)) + np.append(m.sum(axis=0), len(m))
        for n, t in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([int(n)] * (n + 1), pa.int32()), pa.array(np.arange(n + 1, dtype=np.int32)), pa.array(t)], names=["dim", "at", "v"])

    means = rows.mapInArrow(sums, "dim int, at int, v double").groupBy("dim", "at").agg(F.sum("v").alias("v")).toPandas()
    centres = {}
    for n, part in means.groupby("dim"):
        v = part.sort_values("at")["v"].to_numpy()
        centres[int(n)] = np.round(v[:-1] / v[-1], 6)  # the sums' order varies; rounded, the codes don't

    def code(batches):
        turns = {n: rotation(n, seed) for n in centres}
        for batch in batches:
            dims = np.asarray(batch.column("dim"))
            for n in np.unique(dims):
                own = batch.filter(pa.array(dims == n))
                m = np.frombuffer(b"".join(own.column("vec").to_pylist())).reshape(-1, n)
                bits, far, fit = encode(m, centres[n], turns[n])
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array([r.tobytes() for r in bits], pa.binary()), pa.array(far), pa.array(fit)], names=["id", "row", "dim", "vec", "code", "far", "fit"])

    return stage(rows.mapInArrow(code, "id long, row long, dim int, vec binary, code binary, far double, fit double"), "ann-index"), centres


def _nearest(ids: np.ndarray, x: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest by (distance, id) in double precision."""
    d = np.sqrt(np.square(x - q).sum(axis=1))
    order = np.lexsort((ids, d))[:k]
    return ids[order], d[order]


def search(index: DataFrame, centres: dict[int, np.ndarray], queries: DataFrame, k: int = 10, seed: int = 7, epsilon: float = EPSILON) -> DataFrame:
    """query_id, rank, vec_id, score for each query (rows of the index) and its k nearest."""
    found = None
    for block in query_blocks(queries):
        part = search_block(index, centres, block, k, seed, epsilon)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = index.sparkSession.createDataFrame([], "query_no long, query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id", "query_no").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def query_blocks(queries: DataFrame):
    """Blocks (first query's number, ids, rows in the index, vectors) of bounded bytes; read one partition at a time."""
    ids, own, vecs, held, no = [], [], [], 0, 0
    for row in queries.select("id", "row", "vec").toLocalIterator():
        ids.append(row["id"])
        own.append(row["row"])
        vecs.append(bytes(row["vec"]))
        held += len(row["vec"]) + 64
        if held >= QUERY_BLOCK_BYTES:
            yield no, np.array(ids, np.int64), np.array(own, np.int64), vecs
            no, ids, own, vecs, held = no + len(ids), [], [], [], 0
    if ids:
        yield no, np.array(ids, np.int64), np.array(own, np.int64), vecs


def search_block(index: DataFrame, centres: dict[int, np.ndarray], block, k: int, seed: int, epsilon: float) -> DataFrame:
    shared = index.sparkSession.sparkContext.broadcast(block)

    def over(batches):
        first, qids, qrows, raw = shared.value
        sizes = np.array([len(v) // 8 for v in raw])
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        turns = {n: rotation(n, seed) for n in np.unique(sizes)}
        by = {n: (np.flatnonzero(sizes == n), np.frombuffer(b"".join(v for v in raw if len(v) == 8 * n)).reshape(-1, n)) for n in np.unique(sizes)}
        for batch in batches:
            dims = np.asarray(batch.column("dim"))
            for n in np.unique(dims):
                if n not in by:
                    continue
                own = batch.filter(pa.array(dims == n))
                ids, nos, far, fit = (np.asarray(own.column(c)) for c in ("id", "row", "far", "fit"))
                x = np.frombuffer(b"".join(own.column("vec").to_pylist())).reshape(-1, n)
                codes = np.frombuffer(b"".join(own.column("code").to_pylist()), np.uint8).reshape(len(ids), -1)
                at, q = by[n]
                step = max(1, CELLS // len(ids))
                for lo in range(0, len(at), step):
                    low, high = bounds(codes, far, fit, q[lo : lo + step], centres[n], turns[n], epsilon)
                    kth = np.partition(high, min(k, len(ids) - 1), axis=0)[min(k, len(ids) - 1)]  # one more, as the query itself may be here
                    for j in range(low.shape[1]):
                        i = int(at[lo + j])
                        had = best.get(i)
                        limit = kth[j] if had is None or len(had[0]) < k else min(kth[j], had[1][-1] ** 2 * (1 + 1e-9))
                        rows = np.flatnonzero((low[:, j] <= limit) & (nos != qrows[i]))
                        near, dist = _nearest(ids[rows], x[rows], q[lo + j], k)
                        if had is not None:
                            near, dist = np.concatenate([had[0], near]), np.concatenate([had[1], dist])
                            order = np.lexsort((near, dist))[:k]
                            near, dist = near[order], dist[order]
                        best[i] = (near, dist)
        for lo in range(0, len(best), 1024):
            some = list(best.items())[lo : lo + 1024]
            count = [len(v[0]) for _, v in some]
            no = np.repeat([i for i, _ in some], count).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(no + first), pa.array(qids[no]), pa.array(np.concatenate([v[0] for _, v in some])), pa.array(np.concatenate([v[1] for _, v in some]))], names=["query_no", "query_id", "vec_id", "score"])

    return index.mapInArrow(over, "query_no long, query_id long, vec_id long, score double")
