"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

Texts are lower-cased and split into words; of scripts that don't set blanks between words (Chinese, Japanese, Thai, Lao, Khmer,
Burmese) each character is one.  Fixed masks over a few neighbouring words, each ignoring
some positions, are hashed at every place of every benchmark item and every document.  Equal hashes are
hits; each names an item and a diagonal (document position less item position).  On a hit's
diagonal the words of both sides are compared: a document holds an item's passage if some ``window`` words of the item
(all of them, if it has fewer) agree with the document in at least ``share`` percent of places.  So a passage with
substituted words is still found, wherever enough words between the substitutions agree.

Items of fewer words than the longest mask have masks of their own length, one for every set of places that may differ;
documents are hashed with these only if the benchmark has such items.

The seeds of the benchmark are broadcast only if a count shows that they are few; else Spark
joins by shuffle and splits skewed hashes.  The documents are read twice, the second time only those with hits.

Defined cases: null and empty texts hold nothing; items of fewer than ``shortest`` words are never found;
items or documents that repeat are reported once for each id; null ids are kept as null; extra columns pass through ``clean``.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.llm.common import if_small, stage, text_of

#: Word offsets that each mask looks at, the short one last.  Whatever fifth of 7 to 13 words differs, one of them hits.
MASKS = ((0, 1, 3, 4, 6), (0, 1, 2, 5, 6), (0, 1, 2, 4, 6), (0, 1, 2, 3, 4))
SPAN = 1 + max(max(m) for m in MASKS)
WINDOW, SHARE = 13, 80
#: Words that an item must have unless a caller says otherwise: one or two common words are in any document.
SHORTEST = 3
#: Rows up to which seeds, items and ids of hit documents are broadcast (some tens of MB at most).
BROADCAST_ROWS = 400_000
BREAKS = r"[^\p{L}\p{N}]+"
#: All characters of scripts without blanks, and more: one range is looked for faster.
HIGH = r"[\u0E00-\x{10FFFF}]"
UNSPACED = r"([\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u3005-\u3007\u3040-\u30FF\u31F0-\u31FF\u3400-\u4DBF\u4E00-\u9FFF\uF900-\uFAFF\uFF66-\uFF9F\x{1B000}-\x{1B16F}\x{20000}-\x{3FFFF}])"


def words(text: Column) -> Column:
    spaced = F.when(text.rlike(HIGH), F.regexp_replace(text, UNSPACED, " $1 ")).otherwise(text)
    return F.filter(F.split(F.lower(spaced), BREAKS), lambda w: w != "")


def hashed(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.xxhash64(w))


def masked(number: int, mask: tuple[int, ...]):
    return lambda i: F.xxhash64(F.lit(number), *[F.get("_h", i + o) for o in mask])


def seeds(df: DataFrame, *ids: str) -> DataFrame:
    """ids, seed, at: every mask's hash at every place of the array column _h, up to the mask's own end."""
    places = lambda span: F.when(F.size("_h") >= SPAN, F.sequence(F.lit(0), F.size("_h") - span)).otherwise(F.expr("cast(array() as array<int>)"))
    df = df.select(*ids, "_h", places(SPAN).alias("_p"), places(1 + MASKS[-1][-1]).alias("_last"))
    each = [F.transform("_p" if mask is not MASKS[-1] else "_last", masked(m, mask)) for m, mask in enumerate(MASKS)]
    flat = df.select(*ids, F.size("_p").alias("_n"), F.posexplode(F.concat(*each)).alias("_i", "seed"))
    before = F.col("_n") * (len(MASKS) - 1)
    return flat.select(*ids, "seed", F.when(F.col("_i") < before, F.col("_i") % F.col("_n")).otherwise(F.col("_i") - before).cast("int").alias("at"))


def short_masks(n: int, share: int) -> list[tuple[int, ...]]:
    """The places of n words that may have to agree: every choice of as many as share percent of them."""
    return list(combinations(range(n), max((n * share + 99) // 100, 1)))


def short_seeds(df: DataFrame, n: int, share: int, *ids: str) -> DataFrame:
    """ids, seed, at: the hashes of every place of _h by the masks of items of n words."""
    found = short_masks(n, share)
    places = F.sequence(F.lit(0), F.size("_h") - n)
    each = [F.transform("_p", masked(1000 * n + m, mask)) for m, mask in enumerate(found)]
    df = df.where(F.size("_h") >= n).select(*ids, "_h", places.alias("_p"))
    flat = df.select(*ids, F.size("_p").alias("_n"), F.posexplode(F.concat(*each)).alias("_i", "seed"))
    return flat.select(*ids, "seed", (F.col("_i") % F.col("_n")).cast("int").alias("at"))


def hits(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", share: int = SHARE, shortest: int = SHORTEST) -> DataFrame:
    """_key, _text_hash, _item, _diagonal of all places where a mask's words agree."""
    d = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("\\N")).alias("_key"), F.xxhash64(text_of(text)).alias("_text_hash"), hashed(text_of(text)).alias("_h"))
    b = benchmark.select(F.col(item).alias("_item"), hashed(text_of(item_text)).alias("_h"))
    lengths = sorted(r[0] for r in b.select(F.size("_h")).distinct().where(F.size("_h").between(max(shortest, 1), SPAN - 1)).collect())  # six numbers at most
    bench, made = seeds(b, "_item"), seeds(d, "_key", "_text_hash")
    for n in lengths:
        bench = bench.unionByName(short_seeds(b.where(F.size("_h") == n), n, share, "_item"))
        made = made.unionByName(short_seeds(d, n, share, "_key", "_text_hash"))
    bench = stage(bench.distinct().withColumnRenamed("at", "_item_at"), "bench-seeds")
    found = made.join(if_small(bench, bench.count(), BROADCAST_ROWS), "seed")
    return found.groupBy("_key", "_text_hash", "_item", (F.col("at") - F.col("_item_at")).alias("_diagonal")).agg(F.count("*").alias("_seeds"))


def overlaps(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, share: int = SHARE, shortest: int = SHORTEST) -> DataFrame:
    """key, item, n_words, n_equal, doc_at: the items that documents hold, with the best diagonal's figures.

    Beside them _key and _text_hash, which name the document row.
    """
    found = stage(hits(docs, benchmark, key, text, item, item_text, share, shortest), "bench-hits")
    rows = found.select("_key", "_text_hash").distinct()
    n = rows.count()
    named = docs.select(F.col(key), F.coalesce(F.col(key).cast("string"), F.lit("\\N")).alias("_key"), F.xxhash64(text_of(text)).alias("_text_hash"), text_of(text).alias("_text"))
    own = named.join(if_small(rows, n, BROADCAST_ROWS), ["_key", "_text_hash"], "left_semi").distinct()
    own = own.select(key, "_key", "_text_hash", hashed(F.col("_text")).alias("_d"))
    items = benchmark.select(F.col(item).alias("_item"), hashed(text_of(item_text)).alias("_b")).where(F.size("_b") >= max(shortest, 1)).distinct()
    pairs = own.join(if_small(found, found.count(), BROADCAST_ROWS), ["_key", "_text_hash"]).join(if_small(items, items.count(), BROADCAST_ROWS // 100), "_item")
    first, last = F.greatest(F.lit(0), -F.col("_diagonal")), F.least(F.size("_b"), F.size("_d") - F.col("_diagonal")) - 1
    equal = F.transform(F.sequence(first, last), lambda i: F.when(F.get("_b", i) == F.get("_d", i + F.col("_diagonal")), 1).otherwise(0))
    pairs = pairs.where(last >= first).withColumn("_equal", equal).withColumn("_w", F.least(F.lit(window), F.size("_b")))
    sums = F.transform(F.sequence(F.lit(1), F.size("_equal") - F.col("_w") + 1), lambda i: F.aggregate(F.slice("_equal", i, F.col("_w")), F.lit(0), lambda a, x: a + x))
    pairs = pairs.where(F.size("_equal") >= F.col("_w")).withColumn("_best", F.array_max(sums)).where(F.col("_best") * 100 >= F.col("_w") * share)
    figures = F.struct(F.aggregate("_equal", F.lit(0), lambda a, x: a + x).alias("n_equal"), F.size("_equal").alias("n_words"), (first + F.col("_diagonal")).alias("doc_at"))
    best = pairs.select(key, "_key", "_text_hash", F.col("_item").alias(item), figures.alias("f")).groupBy(key, "_key", "_text_hash", item).agg(F.max("f").alias("f"))
    return best.select(key, "_key", "_text_hash", item, "f.n_words", "f.n_equal", "f.doc_at")


def clean(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """docs without the rows that hold an item's passage."""
    bad = stage(overlaps(docs, benchmark, key, text, **settings).select(F.col("_key").alias("_el_key"), F.col("_text_hash").alias("_el_hash")).distinct(), "bench-docs")
    named = docs.withColumns({"_el_key": F.coalesce(F.col(key).cast("string"), F.lit("\\N")), "_el_hash": F.xxhash64(text_of(text))})
    return named.join(if_small(bad, bad.count(), BROADCAST_ROWS), ["_el_key", "_el_hash"], "left_anti").drop("_el_key", "_el_hash").select(*docs.columns)
