r"""Mixing sources to target weights by hierarchical budgeting.

A tree domain > language > source has an integer weight at every node.  A token budget
flows down from the root in proportion to the weights.  A child that can't use its share
(its leaves' tokens times ``max_epochs`` are fewer) keeps what it can; the rest goes to
its siblings first, and only what a whole family can't use goes to the ancestors' siblings.
Each leaf then takes whole epochs and, from the next epoch, the prefix of its documents in
a seeded order that fits the rest.

Defined cases: null text has no tokens and is never in a partial epoch's way; null language, source
or id count as the text ``\\N``; documents with equal draws are ordered by id; rows
that repeat are separate documents.  A family whose weights are all zero shares by weight one each.  Sums are
integers and shares are rounded down, so a leaf can miss up to one token per tree level of its share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlog.llm.common import if_small, stage

#: Rows of the leaf table up to which it is broadcast; more leaves are joined by shuffle.
LEAVES_BROADCAST = 20_000
#: Documents of a leaf that one task orders when an epoch is cut, about.
CUT_BLOCK_ROWS = 4_000
WORDS = r"[^ \t-\r]+"
LEVELS = ("domain", "lang", "source")


def words(col: str = "text") -> Column:
    """Runs of characters other than \\x20 and \\x09-\\x0D; null has none."""
    return F.coalesce(F.regexp_count(F.col(col), F.lit(WORDS)), F.lit(0)).cast("long")


def seeded(seed: int, epoch: Column, key: Column) -> Column:
    """A draw below 2**60 that orders an epoch."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), epoch.cast("string"), F.lit(":"), key).cast("binary")), 1, 15), 16, 10).cast("long")


def fill(nodes: DataFrame, parent: list[str], budget: str, weight: str, cap: str, out: str) -> DataFrame:
    """Shares each parent's budget among its rows: min(cap, level * weight), the level set so that nothing is left while anyone has room.

    Children are taken by cap/weight; those before the level's place are full.  Done by
    running sums over the children of one parent, which are rows of a tree, not of the corpus.
    """
    by = Window.partitionBy(*parent)
    order = by.orderBy(F.col(cap) / F.col(weight), F.col("_name"))
    before = F.coalesce(F.sum(cap).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum(weight).over(order.rowsBetween(0, Window.unboundedFollowing))
    d = nodes.withColumn("_before", before).withColumn("_rest", rest)
    left, wide = F.greatest(F.col(budget) - F.col("_before"), F.lit(0)), "decimal(38,0)"
    d = d.withColumn("_open", left.cast(wide) * F.col(weight).cast("decimal(18,0)") <= F.col(cap).cast(wide) * F.col("_rest").cast("decimal(18,0)"))
    first = F.min(F.when(F.col("_open"), F.struct((F.col(cap) / F.col(weight)).alias("r"), F.col("_name").alias("n"), F.col("_before").alias("b"), F.col("_rest").alias("w")))).over(by)
    d = d.withColumn("_first", first)
    share = F.expr(f"cast((cast(greatest({budget} - _first.b, 0) as decimal(20,0)) * cast({weight} as decimal(18,0))) div _first.w as bigint)")
    return d.withColumn(out, F.when(F.col("_first").isNull(), F.col(cap)).otherwise(F.least(F.col(cap), share))).drop("_before", "_rest", "_open", "_first")


def budgets(leaves: DataFrame, total: int | None, percent: int, max_epochs: int) -> DataFrame:
    """leaves: domain, lang, source, tokens, docs, weights w_domain, w_lang, w_source.  Adds cap and take, the leaf's tokens."""
    leaves = leaves.withColumn("cap", F.col("tokens") * max_epochs).withColumn("_root", F.lit(1))
    for name in LEVELS:
        leaves = leaves.withColumn(f"w_{name}", F.greatest(F.col(f"w_{name}"), F.lit(0)).cast("long"))
    want = F.lit(total).cast("long") if total is not None else F.expr(f"tokens_all * {percent} div 100")
    sums = leaves.groupBy("_root").agg(F.sum("tokens").alias("tokens_all"), F.sum("cap").alias("cap_all"))
    above = sums.select("_root", F.least(want, F.col("cap_all")).alias("budget"))
    keys: list[str] = ["_root"]
    for name in LEVELS:
        nodes = leaves.groupBy(*keys, name).agg(F.sum("cap").alias("cap"), F.max(f"w_{name}").alias("_w"))
        heavy = F.max("_w").over(Window.partitionBy(*keys)) > 0
        nodes = nodes.withColumn("_w", F.when(heavy, F.col("_w")).otherwise(F.lit(1))).withColumn("cap", F.when(F.col("_w") > 0, F.col("cap")).otherwise(0)).withColumn("_w", F.greatest("_w", F.lit(1)))
        nodes = nodes.join(above, keys).withColumn("_name", F.col(name))
        above = fill(nodes, keys, "budget", "_w", "cap", "share").select(*keys, name, F.col("share").alias("budget"))
        keys.append(name)
    return leaves.join(above.withColumnRenamed("budget", "take"), keys).drop("_root")


def leaf_columns(docs: DataFrame, domain: Column, text: str) -> DataFrame:
    none = F.lit("\\N")
    found = {
        "_el_domain": F.coalesce(domain.cast("string"), none), "_el_lang": F.coalesce(F.col("lang").cast("string"), none),
        "_el_source": F.coalesce(F.col("source").cast("string"), none), "_el_tokens": words(text),
    }
    return docs.withColumns(found)


def mix(docs: DataFrame, domain: Column, w_domain: Column, w_lang: Column, w_source: Column, total: int | None = None, percent: int = 80, max_epochs: int = 2, seed: int = 17, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with columns ``_el_domain, _el_lang, _el_source, _el_tokens, _el_copies``: how often each row is taken, 0 included.

    The weights are columns over domain, lang and source.  Names beginning with ``_el_`` are
    reserved; any other extra column passes through.  Rows that share a key are taken together.

    docs is read twice: for narrow totals, and to decide every row in one pass.  The order
    within a leaf is a hash of the key, so a leaf's prefix is all rows up to its last
    (draw, key); that pair is found by block sums and by ordering only the block in which the cut falls.
    """
    named = F.coalesce(F.col(key).cast("string"), F.lit("\\N"))
    d = leaf_columns(docs, domain, text).select(named.alias("_key"), *(F.col(f"_el_{x}").alias(x) for x in LEVELS), F.col("_el_tokens").alias("n_tokens"))
    d = stage(d, "mix-docs")
    leaves = d.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs"))
    leaves = budgets(leaves.withColumns({"w_domain": w_domain, "w_lang": w_lang, "w_source": w_source}), total, percent, max_epochs)
    leaves = leaves.withColumns({"epochs": F.when(F.col("tokens") > 0, F.expr("take div tokens")).otherwise(F.lit(0)).cast("long"), "cut": F.when(F.col("tokens") > 0, F.expr("take % tokens")).otherwise(F.lit(0)).cast("long")})
    leaves = stage(leaves.withColumn("_blocks", F.ceil(F.col("docs") / CUT_BLOCK_ROWS).cast("long")), "mix-leaves")
    n = leaves.count()
    d = d.join(if_small(leaves.where("cut > 0").select(*LEVELS, "epochs", "cut", "_blocks"), n, LEAVES_BROADCAST), [*LEVELS])
    d = d.withColumn("_draw", seeded(seed, F.col("epochs"), F.col("_key")))
    d = d.withColumn("_block", F.expr("cast(cast(_draw as double) / 1152921504606846976.0D * _blocks as bigint)"))
    d = d.withColumn("_at", F.struct(F.col("_draw").alias("draw"), F.col("_key").alias("key")))
    blocks = d.groupBy(*LEVELS, "_block", "cut").agg(F.sum("n_tokens").alias("_sum"), F.max("_at").alias("_most"), F.count("*").alias("_n"))
    start = F.coalesce(F.sum("_sum").over(Window.partitionBy(*LEVELS).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = stage(blocks.withColumn("_start", start), "mix-blocks")
    inside = blocks.where("_start < cut and _start + _sum > cut").select(*LEVELS, "_block", "_start")
    run = F.sum("n_tokens").over(Window.partitionBy(*LEVELS, "_block").orderBy("_draw", "_key"))  # rows that tie come together
    part = d.join(if_small(inside, n, LEAVES_BROADCAST), [*LEVELS, "_block"]).withColumn("_run", run).where("_start + _run <= cut")
    last = part.select(*LEVELS, F.col("_at").alias("_most")).unionByName(blocks.where("_start + _sum <= cut").select(*LEVELS, "_most"))
    last = last.groupBy(*LEVELS).agg(F.max("_most").alias("_last"))
    plan = leaves.select(*LEVELS, "epochs").join(last, [*LEVELS], "left")
    plan = plan.select(*(F.col(x).alias(f"_el_{x}") for x in LEVELS), F.col("epochs").alias("_el_epochs"), F.col("_last").alias("_el_last"))
    out = leaf_columns(docs, domain, text).join(if_small(plan, n, LEAVES_BROADCAST), [f"_el_{x}" for x in LEVELS])
    at = F.struct(seeded(seed, F.col("_el_epochs"), named).alias("draw"), named.alias("key"))
    copies = F.col("_el_epochs") + F.when(at <= F.col("_el_last"), F.lit(1)).otherwise(F.lit(0))
    return out.withColumn("_el_copies", copies.cast("long")).drop("_el_epochs", "_el_last")
