"""Jaccard self-join on word shingles by a grouped prefix join, and its components.

A document is the set of its distinct five-word shingles (64-bit hashes).  Shingles are ordered by an
estimate of how often they occur (rare ones first), then by hash; two sets of similarity ``percent`` or
more share a shingle among the first ``n - ceil(percent * n / 100) + 1`` of each (their prefixes).

1.  One pass counts shingles in a count-mean sketch of bounded size; the order needs only to be one fixed order, so
    errors of the sketch cost time and never links.
2.  One pass takes every document's prefix.  Documents of one size and prefix form a group; exact copies always do.
3.  Groups are listed under the shingles of their prefix, and pairs of groups are taken from the lists.  A
    list isn't expanded into all its pairs: round one pairs each group with a few hubs of the shingle, the groups with the
    fewest shingles of their own.  Later pairs are needed only between groups whose members are still in different
    components; they meet by size class, a long list's in cells of bounded size, and pairs that sizes and places in the
    prefixes rule out are filtered.
4.  Group pairs are expanded to pairs of distinct sets and verified on the whole sets.
5.  Verified links are joined to components by label propagation with pointer jumping.

Components are exact: every pair that shares a prefix shingle is verified, or already
in one component, or too different in size or place.  Null or wordless texts have no shingles and stay alone;
texts of fewer than five words have one shingle, all their words.  Rows that repeat are copies; extra columns are ignored
(names beginning with ``_el_`` are reserved).  A null id is its own component's id only if all its ids are null.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.llm.common import BLANK, CHUNK_BYTES, mix, odd_multipliers, pieces, runs, stage, text_of, unstage, utf8

WORDS = 5
PERCENT = 80
#: The sketch has 16 to 32 cells a document, in powers of two between these: 32 MB a task and 64 MB in the driver at most.
MIN_SKETCH_BITS, MAX_SKETCH_BITS = 16, 23
SKETCH_CHUNK = 1 << 14
#: The filter of sets that are verified has 16 to 32 bits for each, in powers of two between these: 8 MB at most.
MIN_FILTER_BITS, MAX_FILTER_BITS = 20, 26
#: Bits of one of Spark's bitmaps.
BITMAP = 32_768
#: Postings of one list, about.
LIST_ROWS = 1000
#: Hubs of a shingle's list.
HUBS = 3
_BYTE = odd_multipliers(6, 256)
_PLACE = odd_multipliers(61, 64)
_WORD = odd_multipliers(62, WORDS)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_sums(raw: np.ndarray, offsets: np.ndarray, had: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sum, bytes, index of the text) of every word, in order; A-Z count as a-z.  The bytes before the first blank follow had others of their word."""
    none = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if not len(raw):
        return none
    low = _LOWER[raw]
    inside = ~BLANK[raw]
    before = np.empty(len(raw), bool)
    before[0] = False
    before[1:] = inside[:-1]
    own_start = offsets[:-1][np.diff(offsets) > 0]
    before[own_start] = False
    start = np.flatnonzero(inside & ~before)
    if not len(start):
        return none
    at = np.flatnonzero(inside)
    number = np.cumsum(inside & ~before)[at] - 1
    within = at - start[number]
    if had:
        within[number == 0] += had
    h = _BYTE[low[at]] * (_PLACE[within & 63] + (within >> 6).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C16))
    lead = np.searchsorted(at, start)
    size = np.diff(np.append(lead, len(at))).astype(np.uint64)
    return np.add.reduceat(h, lead), size, np.searchsorted(offsets, start, "right") - 1


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, index of the text) of every word, in order."""
    h, size, own = word_sums(raw, offsets)
    return mix(h + size), own


def long_word_hashes(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The hashes of one text's words, read in pieces; a word that crosses a piece's end goes on in the next."""
    out, held, had = [], np.zeros(1, np.uint64), 0
    for part, at, _ in pieces(raw, offsets):
        if had and BLANK[part[0]]:
            out.append(mix(held + np.uint64(had)))
            had = 0
        h, size, _ = word_sums(part, at, had)
        if had:
            h[:1] += held
            size[:1] += np.uint64(had)
        had = 0
        if len(h) and not BLANK[part[-1]]:
            held, had = h[-1:], int(size[-1])
            h, size = h[:-1], size[:-1]
        out.append(mix(h + size))
    if had:
        out.append(mix(held + np.uint64(had)))
    return np.concatenate(out)


def shingle_hashes(words: np.ndarray) -> np.ndarray:
    """Of one text: its distinct shingles' hashes, sorted."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    if n < WORDS:
        return mix((words * _WORD[:n]).sum(keepdims=True) + _PLACE[n])
    h = np.zeros(n - WORDS + 1, np.uint64)
    for j in range(WORDS):
        h += words[j : n - WORDS + 1 + j] * _WORD[j]
    return np.unique(mix(h))


def sets(raw: np.ndarray, offsets: np.ndarray):
    """The shingle set of each text, one after the other."""
    for lo, hi in runs(offsets, CHUNK_BYTES):
        part, at = raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        if hi - lo == 1 and len(part) > 4 * CHUNK_BYTES:  # a very long text: words in pieces
            yield shingle_hashes(long_word_hashes(part, at))
            continue
        words, own = word_hashes(part, at)
        cuts = np.searchsorted(own, np.arange(hi - lo + 1))
        # shingles of all texts at once; those that reach into the next text are left out
        n = len(words)
        h = np.zeros(max(n - WORDS + 1, 0), np.uint64)
        for j in range(WORDS):
            h += words[j : n - WORDS + 1 + j] * _WORD[j] if n >= WORDS else h
        h = mix(h)
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield np.unique(h[a : b - WORDS + 1]) if b - a >= WORDS else shingle_hashes(words[a:b])


def prefix_length(n, percent: int = PERCENT):
    return n - (percent * n + 99) // 100 + 1


def fingerprint(found: np.ndarray) -> bytes:
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest()


def sketch_bits(n_docs: int) -> int:
    return min(max(int(n_docs).bit_length() + 4, MIN_SKETCH_BITS), MAX_SKETCH_BITS)


def cell(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def named_by(id_: Column, tag: Column) -> Column:
    """A text that names a document's row: its id and a hash of its text."""
    return F.concat_ws(":", F.coalesce(id_.cast("string"), F.lit("\\N")), tag.cast("string"))


def described(d: DataFrame, bits: int) -> DataFrame:
    """_id, _tag, n, print (of the whole set), and the rows of a sketch: chunk, counts."""

    def over(batches):
        sketch = np.zeros(1 << bits, np.uint32)
        for batch in batches:
            size, prints = [], []
            for found in sets(*utf8(batch.column("_text"))):
                size.append(len(found))
                prints.append(fingerprint(found))
                np.add.at(sketch, cell(found, bits), np.uint32(1))
            none = pa.nulls(len(batch), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_tag"), pa.array(size, pa.int64()), pa.array(prints, pa.binary()), pa.nulls(len(batch), pa.int32()), none], names=["_id", "_tag", "n", "print", "chunk", "counts"])
            kind = batch.column("_id").type
        for chunk, part in enumerate(sketch.reshape(-1, SKETCH_CHUNK)):
            if part.any():
                counts = part.astype(np.min_scalar_type(int(part.max())))
                row = [pa.nulls(1, kind), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([chunk], pa.int32()), pa.array([bytes([counts.itemsize]) + zstandard.compress(counts.tobytes(), 1)], pa.binary())]
                yield pa.RecordBatch.from_arrays(row, names=["_id", "_tag", "n", "print", "chunk", "counts"])

    kind = d.schema["_id"].dataType.simpleString()
    return d.mapInArrow(over, f"_id {kind}, _tag long, n long, print binary, chunk int, counts binary")


def gathered(sketches: DataFrame, bits: int) -> np.ndarray:
    """The sum of all tasks' sketches: each chunk is added up as a stream, in a task of its own; a fixed size comes to the driver."""

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, counts in zip(batch.column("chunk").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                had = total.setdefault(chunk, np.zeros(SKETCH_CHUNK, np.int64))
                had += np.frombuffer(zstandard.decompress(counts[1:]), f"<u{counts[0]}")
        for chunk, counts in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([zstandard.compress(counts.tobytes(), 1)], pa.binary())], names=["chunk", "counts"])

    out = np.zeros(1 << bits, np.int64).reshape(-1, SKETCH_CHUNK)
    for r in sketches.repartition(32, "chunk").mapInArrow(add, "chunk int, counts binary").toLocalIterator():
        out[r["chunk"]] = np.frombuffer(zstandard.decompress(bytes(r["counts"])), np.int64)
    return out.reshape(-1)


def ranks(sketch: np.ndarray) -> np.ndarray:
    """For each cell, how far it stands above the mean, in powers of two of the cells' usual spread: 0 for all that could be rare."""
    mean = sketch.mean()
    over = (sketch - mean) / max(np.sqrt(mean), 1.0)
    return np.where(over > 4, np.ceil(np.log2(np.maximum(over, 4))), 0).astype(np.uint8)


def list_counts(sketch: np.ndarray) -> np.ndarray:
    """For each cell, into how many lists the postings of a shingle in it are split: the power of two, 0 for most."""
    over = np.maximum(sketch - sketch.mean() - 4 * np.sqrt(sketch.mean()), 1) / LIST_ROWS
    return np.maximum(np.ceil(np.log2(over)), 0).astype(np.uint8)


def prefixes(d: DataFrame, sketch: np.ndarray, percent: int) -> DataFrame:
    """_id, _tag, n, print, grp (of size and prefix), prefix (shingles in order) and lists (that the shingle's postings are dealt into) of documents with shingles."""
    shared = d.sparkSession.sparkContext.broadcast((ranks(sketch), list_counts(sketch)))

    def over(batches):
        rank, lists = shared.value
        bits = len(rank).bit_length() - 1
        for batch in batches:
            keep, size, prints, groups, found_, lists_ = [], [], [], [], [], []
            for i, found in enumerate(sets(*utf8(batch.column("_text")))):
                n = len(found)
                if not n:
                    continue
                k = prefix_length(n, percent)
                r = rank[cell(found, bits)]  # found is in order of hash: rarer cells come first, hashes decide within
                first = found[np.argsort(r, kind="stable")[:k]] if r.any() else found[:k]
                keep.append(i)
                size.append(n)
                prints.append(fingerprint(found))
                groups.append(int.from_bytes(hashlib.blake2b(n.to_bytes(8, "little") + first.tobytes(), digest_size=8).digest(), "little", signed=True))
                found_.append(first.view(np.int64))
                lists_.append(1 << lists[cell(first, bits)].astype(np.int64))
            ends = pa.array(np.cumsum([0, *(len(x) for x in found_)]).astype(np.int32))
            flat = [np.concatenate([np.zeros(0, np.int64), *x]) for x in (found_, lists_)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(pa.array(keep, pa.int64())) for c in ("_id", "_tag")), pa.array(size, pa.int64()), pa.array(prints, pa.binary()), pa.array(groups, pa.int64()), *(pa.ListArray.from_arrays(ends, pa.array(x)) for x in flat)],
                names=["_id", "_tag", "n", "print", "grp", "prefix", "lists"],
            )

    kind = d.schema["_id"].dataType.simpleString()
    return d.mapInArrow(over, f"_id {kind}, _tag long, n long, print binary, grp long, prefix array<long>, lists array<long>")


def postings(pre: DataFrame) -> DataFrame:
    """token, list, grp, n, at of the shingles that more than one group lists, once for each group.

    A very common shingle's postings are dealt into several lists by group, and told whatever each list holds; others' list is 0.
    """
    e = pre.select("grp", "n", F.posexplode(F.arrays_zip("prefix", "lists")).alias("at", "x")).select(F.col("x.prefix").alias("token"), F.col("x.lists").alias("lists"), "grp", "n", "at")
    spread = F.pmod(F.shiftrightunsigned(F.col("grp"), 8), F.col("lists"))
    e = e.select("token", F.when(F.col("lists") > 1, spread + 1).otherwise(F.lit(0)).alias("list"), "grp", F.col("n").cast("int").alias("n"), "at")
    e = e.repartition("token", "list").sortWithinPartitions("token", "list", "grp")

    def over(batches):
        held, follows_held = None, False  # the last group so far: whether it is told depends on the next
        kinds = (np.int64, np.int64, np.int64, np.int32, np.int32)

        def told(which, columns):
            return pa.RecordBatch.from_arrays([pa.array(c[which].astype(t)) for c, t in zip(columns, kinds, strict=True)], names=["token", "list", "grp", "n", "at"])

        for batch in batches:
            token, list_, grp, n, at = (np.asarray(batch.column(c)) for c in ("token", "list", "grp", "n", "at"))
            if held is not None:
                token, list_, grp, n, at = (np.concatenate([[h], x]) for h, x in zip(held, (token, list_, grp, n, at), strict=True))
            same = (token[1:] == token[:-1]) & (list_[1:] == list_[:-1])
            fresh = np.append(True, ~(same & (grp[1:] == grp[:-1])))
            token, list_, grp, n, at = (x[fresh] for x in (token, list_, grp, n, at))
            follows = np.append(held is not None and follows_held, (token[1:] == token[:-1]) & (list_[1:] == list_[:-1]))
            tell = follows | (list_ > 0)
            tell[:-1] |= follows[1:]
            held, follows_held = tuple(x[-1] for x in (token, list_, grp, n, at)), bool(follows[-1])
            yield told(np.flatnonzero(tell[:-1]), (token, list_, grp, n, at))
        if held is not None and (follows_held or held[1] > 0):
            yield told(np.zeros(1, np.int64), tuple(np.array([h]) for h in held))

    return e.mapInArrow(over, "token long, list long, grp long, n int, at int")


def possible(percent: int, n, at, m, other_at):
    """Can sets of n and m shingles be similar that share a shingle at these places of their prefixes, as the first that they share?

    At most min(n - at, m - other_at) shingles from there on, and none before, are shared; a shingle shared earlier has its own posting.
    """
    least = F.least(n - at, m - other_at)
    return (F.least(n, m) * 100 >= F.greatest(n, m) * percent) & (least * 100 >= (n + m - least) * percent)


def open_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """grp, o_grp of groups that a shingle's postings (token, list, grp, n, at, and r, s: the least and greatest root of their members) put together and that may still join components.

    Sets that can be similar lie in one class of sizes or in neighbouring ones.  A shingle with more than LIST_ROWS open
    postings is dealt into lists by group, and each pair of lists meets in a cell of its own, once.
    """
    each = rows.groupBy("token", "list").agg(F.min("r").alias("_r"), F.max("s").alias("_s"), F.count("*").alias("_c"))
    dealt = each.where("list > 0")
    whole = dealt.groupBy("token").agg(F.min("_r").alias("_r"), F.max("_s").alias("_s"), F.sum("_c").alias("_c"))
    whole = dealt.select("token", "list").join(whole, "token").unionByName(each.where("list = 0"))
    whole = whole.where("_r <> _s").select("token", "list", F.ceil(F.col("_c") / LIST_ROWS).alias("_lists"))
    rows = rows.join(whole, ["token", "list"]).drop("list")
    rows = rows.withColumn("_i", F.pmod(F.xxhash64("grp"), F.col("_lists"))).withColumn("_class", F.floor(F.log("n") / F.log(F.lit(101 / percent))))
    rows = stage(rows, "join-open")
    left = rows.select("token", "grp", "n", "at", "r", "s", "_class", F.col("_i").alias("_x"), F.explode(F.sequence("_i", F.col("_lists") - 1)).alias("_y"))
    right = rows.select("token", *(F.col(c).alias(f"o_{c}") for c in ("grp", "n", "at", "r", "s")), "_class", F.col("_i").alias("_y"), F.explode(F.sequence(F.lit(0).cast("long"), "_i")).alias("_x"))
    right = right.withColumn("_class", F.explode(F.array(*(F.col("_class") + i for i in (-1, 0, 1)))))
    more = left.join(right, ["token", "_x", "_y", "_class"]).where("(_x < _y or grp < o_grp) and not (r = s and o_r = o_s and r = o_r)")
    more = more.where(possible(percent, F.col("n"), F.col("at"), F.col("o_n"), F.col("o_at")))
    return more.select(F.least("grp", "o_grp").alias("grp"), F.greatest("grp", "o_grp").alias("o_grp")).distinct()


def packed(d: DataFrame, wanted: DataFrame) -> DataFrame:
    """_name and compressed text of documents whose _name is in wanted, and of a few others.

    The scan drops most other documents by a filter of bounded size; callers join by name.  Texts are shipped
    rather than sets: compressed, a text is a third of its shingles' hashes.
    """
    bits = min(max(int(wanted.count()).bit_length() + 4, MIN_FILTER_BITS), MAX_FILTER_BITS)
    bit = F.shiftrightunsigned(F.xxhash64("_name"), 64 - bits).cast("int")
    maps = wanted.select(bit.alias("bit")).groupBy(F.floor(F.col("bit") / BITMAP).alias("at")).agg(F.bitmap_construct_agg((F.col("bit") % BITMAP).cast("long")).alias("bits"))
    some = np.zeros((max((1 << bits) // BITMAP, 1), BITMAP // 8), np.uint8)
    for r in maps.toLocalIterator():  # 4 KB a row
        some[r["at"]] = np.frombuffer(r["bits"], np.uint8)
    shared = d.sparkSession.sparkContext.broadcast(some.reshape(-1))

    def over(batches):
        for batch in batches:
            at = np.asarray(batch.column("_bit"))
            keep = pa.array(np.flatnonzero((shared.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1))
            part = batch.select(["_name", "_text"]).take(keep)
            texts = [zstandard.compress(t.encode(), 3) for t in part.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("_name"), pa.array(texts, pa.binary())], names=["_name", "packed"])

    return d.select("_name", "_text", bit.alias("_bit")).mapInArrow(over, "_name string, packed binary")


def _opened(column: pa.Array) -> list[np.ndarray]:
    texts = pa.array([zstandard.decompress(x.as_buffer()) for x in column], pa.binary())
    return list(sets(*utf8(texts)))


def verified(d: DataFrame, nodes: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """pairs (a, b: prints of sets) with ``linked``.  Each set is made from one document that has it."""
    one = nodes.select("print", "_name")
    named = pairs.join(one.select(F.col("print").alias("a"), F.col("_name").alias("a_name")), "a")
    named = stage(named.join(one.select(F.col("print").alias("b"), F.col("_name").alias("b_name")), "b"), "join-named")
    texts = packed(d, named.select(F.explode(F.array("a_name", "b_name")).alias("_name")))

    def compare(batches):
        last: tuple[object, np.ndarray | None] = (None, None)
        for batch in batches:
            for lo in range(0, len(batch), 128):
                some = batch.slice(lo, 128)
                out = []
                names = some.column("b").to_pylist()
                fresh = [i for i, b in enumerate(names) if b != (names[i - 1] if i else last[0])]  # pairs of one b follow each other
                made = dict(zip(fresh, _opened(some.column("y").take(pa.array(fresh, pa.int64()))), strict=True))
                y = last[1]
                for i, x in enumerate(_opened(some.column("x"))):
                    y = made.get(i, y)
                    both = np.concatenate([x, y])
                    both.sort(kind="stable")  # two sorted runs: merged
                    same = int((both[1:] == both[:-1]).sum())
                    out.append(same * 100 >= percent * (len(both) - same))
                last = (names[-1], y)
                yield pa.RecordBatch.from_arrays([some.column("a"), some.column("b"), pa.array(out, pa.bool_())], names=["a", "b", "linked"])

    both = named.join(texts.withColumnRenamed("packed", "x"), named["a_name"] == texts["_name"]).select("a", "b", "b_name", "x")
    both = both.join(texts.withColumnRenamed("packed", "y"), both["b_name"] == texts["_name"]).select("a", "b", "x", "y")
    return both.mapInArrow(compare, "a binary, b binary, linked boolean").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root of the nodes in edges (a, b): alternating large and small stars until nothing changes.

    Each step is written to the shared folder; nothing but two numbers reaches the driver.
    """
    e = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "stars")
    said = lambda e: tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
    state = said(e)
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        e = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = e.groupBy("a").agg(F.min("b").alias("m"))
        turned = e.join(low, "a")
        e = stage(turned.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "stars")
        now = said(e)
        if now == state:
            break
        state = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def similar_sets(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(documents, links).

    documents: key, n_shingles, component_id, text_hash, first_hash for every row; first_hash is the text's of the component's
    first row, by id (null ids last) and then by hash.  links: verified pairs of distinct sets that connect each
    component; pairs that others have connected already are not among them.
    """
    d = docs.select(F.col(key).alias("_id"), text_of(text).alias("_text")).withColumn("_tag", F.xxhash64("_text"))
    d = d.withColumn("_name", named_by(F.col("_id"), F.col("_tag")))
    bits = sketch_bits(docs.count())
    said = stage(described(d.select("_id", "_tag", "_text"), bits), "join-sizes")
    sketches = stage(said.where("chunk is not null"), "join-sketches")
    sketch = gathered(sketches, bits)
    pre = stage(prefixes(d.select("_id", "_tag", "_text"), sketch, percent), "join-prefixes")
    nodes = pre.groupBy("print").agg(F.min(F.struct(F.col("_id").isNull().alias("no"), "_id", "_tag")).alias("x"), F.min("grp").alias("grp"))
    nodes = stage(nodes.select("print", "x._id", "x._tag", named_by(F.col("x._id"), F.col("x._tag")).alias("_name"), "grp"), "join-nodes")
    groups = nodes.groupBy("grp").agg(F.min("print").alias("pivot"))
    lists = stage(postings(pre), "join-lists")
    unstage(pre)

    # round one: every group with its lists' hubs, and the members of each group with its pivot
    common = lists.groupBy("grp").agg(F.count("*").alias("c"))
    own = lists.join(common, "grp").withColumn("_u", F.expr(f"n - ({percent} * n + 99) div 100 + 1 - c"))
    each = own.groupBy("token", "list", F.pmod(F.shiftrightunsigned(F.col("grp"), 40), F.lit(HUBS)).alias("_h")).agg(F.min(F.struct("_u", "n", "grp", "at")).alias("x"))
    hubs = each.where("list > 0").groupBy("token", "_h").agg(F.min("x").alias("x"))
    hubs = lists.where("list > 0").select("token", "list").distinct().join(hubs, "token").drop("_h")  # a common shingle's lists meet its hubs apart
    hubs = hubs.unionByName(each.where("list = 0").drop("_h"))
    hubs = hubs.select("token", "list", F.col("x.grp").alias("hub"), F.col("x.n").alias("h_n"), F.col("x.at").alias("h_at"))
    near = lists.join(hubs, ["token", "list"]).where("grp <> hub").where(possible(percent, F.col("n"), F.col("at"), F.col("h_n"), F.col("h_at"))).select("grp", "hub").distinct()
    near = near.join(groups.select("grp", F.col("pivot").alias("p")), "grp").join(groups.select(F.col("grp").alias("hub"), F.col("pivot").alias("q")), "hub").select("p", "q")
    inner = nodes.join(groups, "grp").where("print <> pivot").select(F.col("print").alias("p"), F.col("pivot").alias("q"))
    pairs = near.unionByName(inner).select(F.greatest("p", "q").alias("a"), F.least("p", "q").alias("b")).distinct()
    first = stage(verified(d, nodes, stage(pairs, "join-pairs"), percent), "join-verified")
    unstage(sketches)

    # round two: only what may still join different components
    roots = components(first.where("linked"))
    nodes = stage(nodes.join(roots, nodes["print"] == roots["node"], "left").select("print", "_id", "_tag", "_name", "grp", F.coalesce("root", "print").alias("root")), "join-roots")
    groups = nodes.groupBy("grp").agg(F.min("root").alias("r"), F.max("root").alias("s"))
    more = open_pairs(lists.join(groups, "grp"), percent)
    mixed = groups.where("r <> s").select("grp", F.col("grp").alias("o_grp"))
    more = more.unionByName(mixed)
    left, right = nodes.select("grp", F.col("print").alias("p"), F.col("root").alias("r")), nodes.select(F.col("grp").alias("o_grp"), F.col("print").alias("q"), F.col("root").alias("s"))
    more = more.join(left, "grp").join(right, "o_grp").where("r <> s").select(F.greatest("p", "q").alias("a"), F.least("p", "q").alias("b")).distinct()
    more = stage(more.join(first.select("a", "b"), ["a", "b"], "left_anti"), "join-more")
    second = stage(verified(d, nodes, more, percent), "join-verified")

    links = first.where("linked").unionByName(second.where("linked")).select("a", "b")
    linked = nodes.select("root", "print").join(second.where("linked").select(F.col("a").alias("print"), F.col("b")), "print").select(F.col("root").alias("a"), "b")
    linked = linked.join(nodes.select(F.col("print").alias("b"), F.col("root").alias("o")), "b").select("a", F.col("o").alias("b"))
    over = components(linked)  # of components
    nodes = nodes.join(over, nodes["root"] == over["node"], "left").select("print", "_id", "_tag", F.coalesce(over["root"], nodes["root"]).alias("root"))
    names = nodes.groupBy("root").agg(F.min(F.struct(F.col("_id").isNull().alias("no"), "_id", "_tag")).alias("x"))
    names = names.select("root", F.col("x._id").alias("component_id"), F.col("x._tag").alias("first_hash"))
    nodes = nodes.join(names, "root").select("print", "component_id", "first_hash")
    rows = said.where("chunk is null").select(F.col("_id").alias(key), F.col("n").alias("n_shingles"), "print", F.col("_tag").alias("text_hash"))
    alone = rows.where("n_shingles = 0").select(key, "n_shingles", F.col(key).alias("component_id"), "text_hash", F.col("text_hash").alias("first_hash"))
    found = rows.where("n_shingles > 0").join(nodes, "print").select(key, "n_shingles", "component_id", "text_hash", "first_hash")
    return found.unionByName(alone), links
