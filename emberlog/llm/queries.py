"""The thin queries of this subpackage's operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.llm import ann, decontam, html_text, huffman, jaccard, langid, mixing, quality, secrets, sharding
from emberlog.llm.common import table

def mixture() -> dict:
    """The tree and the weights of the mixing query: columns need a session, so they are made when asked for."""
    number = F.coalesce(F.regexp_extract("source", "([0-9]+)$", 1).try_cast("long"), F.lit(0))
    return {
        "domain": F.concat(F.lit("d"), (number % 3).cast("string")),
        "w_domain": F.when(F.col("domain") == "d0", 5).when(F.col("domain") == "d1", 3).otherwise(2),
        "w_lang": F.when(F.col("lang") == "en", 4).otherwise(2),
        "w_source": 1 + number % 4,
        "percent": 80, "max_epochs": 2, "seed": 17,
    }


def op1_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document and benchmark item whose passage it holds."""
    found = decontam.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), shortest=1)
    return found.groupBy("doc_id", "item_id").agg(F.max("n_words").alias("n_words"), F.max("n_equal").alias("n_equal"))


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", langid.held_out("doc_id", 4, 2))
    model = langid.fit(docs.where("not held_out"))
    out = langid.identify(docs.select("doc_id", "held_out", "text"), model)
    return out.select("doc_id", "held_out", F.col("_el_lang").alias("lang_pred"), F.col("_el_score").alias("score"), F.col("_el_rejected").alias("rejected"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's source is its owner and its repository."""
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents"))[0])


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", langid.held_out("doc_id", 3, 1))
    labels = table(spark, sf_dir, "labels").where(~langid.held_out("doc_id", 3, 1))
    out = quality.score(docs, quality.fit(docs.where("not held_out"), labels))
    return out.select("doc_id", "held_out", F.col("_el_score").alias("score"), (F.col("_el_score") >= 0.5).cast("int").alias("predicted"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that the mixture takes, with the number of times it takes each."""
    out = mixing.mix(table(spark, sf_dir, "documents"), **mixture()).where("_el_copies > 0")
    return out.select("doc_id", F.col("_el_domain").alias("domain"), "lang", "source", F.col("_el_tokens").alias("n_tokens"), F.col("_el_copies").alias("copies"))


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_sets(table(spark, sf_dir, "documents"))[0].drop("text_hash", "first_hash")


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, centres = ann.build_index(table(spark, sf_dir, "embeddings"))
    return ann.search(index, centres, index.where("id % 100 = 0"), k=10)


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html_text.extract(table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op9_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = huffman.fresh_path(spark)
    huffman.write(table(spark, sf_dir, "documents"), path, huffman.library_encoder(public_tokenizers.path("byte_bpe_50k.json")), vocabulary=50_257)
    return huffman.digest(spark, path)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_plan(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontam": op1_decontam,
    "op2_langid": op2_langid,
    "op3_secrets": op3_secrets,
    "op4_quality": op4_quality,
    "op5_mixing": op5_mixing,
    "op6_jaccard": op6_jaccard,
    "op7_neighbours": op7_neighbours,
    "op8_html": op8_html,
    "op9_tokens": op9_tokens,
    "op10_sharding": op10_sharding,
}

def _filled(nodes: str, parent: str, name: str, above: str) -> str:
    """One level of the tree in SQL: nodes' shares of their parents' budgets."""
    by = f"PARTITION BY {parent}"
    return f"""{name}_0 AS (SELECT {parent}, {nodes} AS name, sum(cap) AS cap, max(w_{nodes}) AS w FROM leaves GROUP BY ALL),
{name}_1 AS (SELECT n.{parent.replace(", ", ", n.")}, n.name, CASE WHEN max(w) OVER ({by}) > 0 AND w = 0 THEN 0 ELSE n.cap END AS cap, CASE WHEN max(w) OVER ({by}) > 0 THEN greatest(w, 1) ELSE 1 END AS w, a.budget FROM {name}_0 n JOIN {above} a USING ({parent})),
{name}_2 AS (SELECT *, coalesce(sum(cap) OVER ({by} ORDER BY cap / w, name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(w) OVER ({by} ORDER BY cap / w, name ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM {name}_1),
{name}_3 AS (SELECT *, CASE WHEN greatest(budget - before, 0)::HUGEINT * w::HUGEINT <= cap::HUGEINT * rest::HUGEINT THEN row(cap / w, name, before, rest) END AS open FROM {name}_2),
{name} AS (SELECT {parent}, name AS {nodes}, CASE WHEN f IS NULL THEN cap ELSE least(cap, (greatest(budget - f[3], 0)::HUGEINT * w::HUGEINT) // f[4]::HUGEINT) END AS budget FROM (SELECT *, min(open) OVER ({by}) AS f FROM {name}_3))"""


ORACLE_SQL: dict[str, str] = {
    "op5_mixing": f"""WITH d AS (SELECT doc_id, lang, source, 'd' || (coalesce(try_cast(regexp_extract(source, '([0-9]+)$', 1) AS BIGINT), 0) % 3) AS domain, coalesce(lang, '\\N') AS l, coalesce(source, '\\N') AS s, len(regexp_extract_all(coalesce(text, ''), '[^ \\t-\\r]+')) AS n_tokens FROM documents),
leaves AS (SELECT 1 AS root, domain, l, s, sum(n_tokens)::BIGINT AS tokens, 2 * sum(n_tokens)::BIGINT AS cap, CASE domain WHEN 'd0' THEN 5 WHEN 'd1' THEN 3 ELSE 2 END AS w_domain, CASE l WHEN 'en' THEN 4 ELSE 2 END AS w_l, 1 + coalesce(try_cast(regexp_extract(s, '([0-9]+)$', 1) AS BIGINT), 0) % 4 AS w_s FROM d GROUP BY ALL),
top AS (SELECT root, least(sum(tokens)::BIGINT * 80 // 100, sum(cap)::BIGINT) AS budget FROM leaves GROUP BY root),
{_filled("domain", "root", "one", "top")},
{_filled("l", "root, domain", "two", "one")},
{_filled("s", "root, domain, l", "three", "two")},
plan AS (SELECT domain, l, s, CASE WHEN tokens > 0 THEN t.budget // tokens ELSE 0 END::BIGINT AS epochs, CASE WHEN tokens > 0 THEN t.budget % tokens ELSE 0 END::BIGINT AS cut FROM leaves JOIN three t USING (domain, l, s)),
run AS (SELECT d.*, epochs, cut, sum(n_tokens) OVER (PARTITION BY domain, l, s ORDER BY ('0x' || substr(md5('17:' || epochs || ':' || coalesce(doc_id::VARCHAR, '\\N')), 1, 15))::BIGINT, coalesce(doc_id::VARCHAR, '\\N')) AS run FROM d JOIN plan USING (domain, l, s))
SELECT doc_id, domain, lang, source, n_tokens::BIGINT AS n_tokens, (epochs + CASE WHEN run <= cut THEN 1 ELSE 0 END)::BIGINT AS copies FROM run WHERE epochs + CASE WHEN run <= cut THEN 1 ELSE 0 END > 0""",
}
