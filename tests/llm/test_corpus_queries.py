"""The corpus queries on the driver's smallest tables: against SQL where there is some, else against their contracts."""

import os
import zlib
from collections import Counter

import numpy as np
import pytest

from emberlog.llm import queries as own

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")


def rows(spark, name):
    return own.QUERIES[name](spark, DATA).toPandas()


def table(spark, name):
    return spark.read.parquet(f"{DATA}/{name}.parquet").toPandas()


@pytest.mark.parametrize("name", sorted(own.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{DATA}/documents.parquet'")
    df, want = own.QUERIES[name](spark, DATA), c.sql(own.ORACLE_SQL[name])
    columns = sorted(df.columns)
    at = [want.columns.index(x) for x in columns]
    assert Counter(tuple(r[x] for x in columns) for r in df.collect()) == Counter(tuple(r[i] for i in at) for r in want.fetchall())


def test_languages_of_held_out_documents(spark):
    got = rows(spark, "op2_langid").merge(table(spark, "documents"), on="doc_id")
    held = np.array([zlib.crc32(str(i).encode()) % 4 == 2 for i in got["doc_id"]])
    assert len(got) == 200 and (got["held_out"] == held).all()
    assert (got["lang_pred"] == got["lang"])[held].mean() > 0.95


def test_quality_of_held_out_documents(spark):
    got = rows(spark, "op4_quality")
    assert len(got) == 200 and (got["predicted"] == (got["score"] >= 0.5)).all() and got["score"].between(0, 1).all()
    held = got.merge(table(spark, "labels"), on="doc_id")
    held = held[held["held_out"]]
    assert (held["predicted"] == held["quality"]).mean() > 0.85


def test_token_query_starts_where_the_last_document_ended(spark):
    got = rows(spark, "op9_tokens").sort_values("doc_id")
    assert (got["start"].to_numpy() == np.append(0, np.cumsum(got["n_tokens"])[:-1])).all()


def test_pages_lose_their_frames(spark):
    got = rows(spark, "op8_html").merge(table(spark, "pages"), on="page_id")
    docs = {" ".join(t.split()) for t in table(spark, "documents")["text"]}
    bodies = [" ".join(t.split("\n", 1)[-1].split()) for t in got["text"]]
    assert np.mean([b in docs for b in bodies]) > 0.95
    assert (got["n_chars"] == got["text"].str.len()).all()


def test_decontamination_finds_whole_items(spark):
    found = set(map(tuple, rows(spark, "op1_decontam")[["doc_id", "item_id"]].to_numpy().tolist()))
    flat = lambda t: " ".join(t.lower().split())
    whole = {(d.doc_id, b.item_id) for b in table(spark, "benchmark").itertuples() for d in table(spark, "documents").itertuples() if flat(b.text) in flat(d.text)}
    assert whole and whole <= found


def test_neighbour_query_has_its_shape(spark):
    got = rows(spark, "op7_neighbours")
    assert set(got["query_id"]) == {i for i in table(spark, "embeddings")["vec_id"] if i % 100 == 0}
    assert all(sorted(g["rank"]) == list(range(1, 11)) and g.sort_values("rank")["score"].is_monotonic_increasing for _, g in got.groupby("query_id"))


def test_linked_documents_are_those_of_all_pairs(spark):
    from test_small import plain_components

    docs = table(spark, "documents")
    got = rows(spark, "op6_jaccard")
    assert Counter(map(tuple, got[["doc_id", "n_shingles", "component_id"]].to_numpy().tolist())) == plain_components(list(zip(docs["doc_id"].tolist(), docs["text"], strict=True)))


def test_neighbours_are_those_of_all_rows(spark):
    given = table(spark, "embeddings")
    ids, x = given["vec_id"].to_numpy(), np.array(given["embedding"].tolist(), np.float64)
    got, hits = rows(spark, "op7_neighbours"), 0
    for q, part in got.groupby("query_id"):
        d = np.sqrt(np.square(x - x[ids == q][0]).sum(axis=1))
        d[ids == q] = np.inf
        want = ids[np.lexsort((ids, d))[:10]]
        hits += len(set(want) & set(part["vec_id"]))
        assert all(abs(r.score - d[ids == r.vec_id][0]) < 1e-12 for r in part.itertuples())
    assert hits >= 0.9 * len(got)


def test_base_secrets_are_those_of_the_plain_patterns(spark):
    import hashlib
    import re

    plain = [
        ("assign", re.compile("((?i:password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII), 2, 8),
        ("access", re.compile("AKIA[A-Z0-9]+"), 0, 16),
        ("hex", re.compile("[0-9a-f]+"), 0, 32),
    ]
    got = rows(spark, "op3_secrets").set_index("doc_id")
    for d in table(spark, "documents").itertuples():
        found = [(m.start(), n, m.end(), kind) for n, (kind, p, group, least) in enumerate(plain) for m in p.finditer(d.text or "") if len(m[group]) >= least]
        r = got.loc[d.doc_id]
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(f[1] == n for f in found) for n in range(3)]
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(found)).encode()).hexdigest()


def test_shards_hold_every_document_once(spark):
    docs, got = table(spark, "documents"), rows(spark, "op10_sharding")
    want = Counter((int(i), len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in zip(docs["doc_id"], docs["text"], strict=True))
    assert Counter(map(tuple, got[["doc_id", "size", "text_crc32"]].to_numpy().tolist())) == want
    assert set(got["law"]) == {"key"} and ((got["grown_shard"] == got["shard"]) | (got["grown_shard"] == 24)).all()
    assert all(sorted(part["slot"]) == list(range(len(part))) for _, part in got.groupby("shard"))
