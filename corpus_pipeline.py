"""A corpus preparation pipeline: quality, near copies, contamination, mixture, shards.

Every stage takes (spark, docs, sf_dir), works on all that the stage before it kept and returns a
DataFrame; all but the last return the columns of documents.  ``run`` writes each stage's rows to the
shared folder and reads them for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.llm import decontam, jaccard, langid, mixing, quality, sharding
from emberlog.llm.common import if_small, stage, table, text_of
from emberlog.llm.queries import mixture


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier scores below one half; labels of one third of the ids aren't learned from.  Null ids and texts and repeated rows are scored like others; extra columns stay, names beginning with ``_el_`` are reserved."""
    learn = ~langid.held_out("doc_id", 3, 1)
    model = quality.fit(docs.where(learn), table(spark, sf_dir, "labels").where(learn))
    return quality.score(docs, model).where("_el_score >= 0.5").select(*docs.columns)


#: Rows of ids and hashes up to which a decision is broadcast (some 30 MB).
DECISIONS_BROADCAST = 1_000_000


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each component of near copies: the one with the smallest id, null ids last, then the smallest hash of its text; of rows that repeat both, one.

    Texts without words are near copies of nothing and stay.  Extra columns stay; names beginning with ``_el_`` are reserved.
    """
    found = stage(jaccard.similar_sets(docs)[0].where("n_shingles > 0"), "components")
    named = docs.withColumn("_el_text", F.xxhash64(text_of()))
    row = F.col("doc_id").alias("_el_id"), F.col("text_hash").alias("_el_hash")
    same = F.col("doc_id").eqNullSafe(F.col("_el_id")) & (F.col("_el_text") == F.col("_el_hash"))
    first = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("text_hash") == F.col("first_hash"))
    drop = stage(found.where(~first).select(*row).distinct(), "copies")
    kept = named.join(if_small(drop, drop.count(), DECISIONS_BROADCAST), same, "left_anti")
    again = stage(found.where(first).groupBy(*row).agg(F.count("*").alias("n")).where("n > 1").drop("n"), "repeated-rows")
    if (n := again.count()) == 0:
        return kept.select(*docs.columns)
    again = if_small(again, n, DECISIONS_BROADCAST)
    once = kept.join(again, same, "left_anti")
    return once.unionByName(kept.join(again, same, "left_semi").dropDuplicates(["doc_id", "_el_text"])).select(*docs.columns)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows whose text holds a benchmark item's passage, whatever their id.  Null, empty and clean texts, repeats and extra columns stay; an empty benchmark drops nothing."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"), shortest=1)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each row as often as the mixture says: rows taken twice appear twice.

    Null languages and sources are leaves of their own; texts without words cost nothing and come with their leaf's whole epochs and prefix; ties and repeats
    go by their order in the seeded epoch, each row by itself.  An empty table gives none.  Names beginning with ``_el_`` are reserved.
    """
    out = mixing.mix(docs, **mixture()).where("_el_copies > 0")
    return out.withColumn("_el_copies", F.explode(F.sequence(F.lit(1).cast("long"), "_el_copies"))).select(*docs.columns)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and slot of every row, by its id: null ids share a key, repeated rows get slots of their own, null texts have no bytes.  Extra columns are left out."""
    return sharding.shard_plan(docs)


STAGES = [
    ("quality", good_quality),
    ("near_copies", one_of_each),
    ("decontamination", uncontaminated),
    ("mixture", mixed),
    ("shards", sharded),
]

#: The classifier's scores can't be had in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
