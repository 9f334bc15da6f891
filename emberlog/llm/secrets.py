"""Secret scans with corpus-wide ownership frequency.

Base patterns find assignments, access keys and hex strings.  The method adds candidates that stand
without a keyword: long tokens of letters and digits.  The hashes of all found values are
counted over the corpus by distinct repositories and distinct owners.  A value that several owners
hold is a copied example; a value of one owner that looks random is taken as live.  Candidates that are
live become spans of kind ``owned``; base spans stay whatever their value's frequency.

Spans are ``kind:start:end`` in code points, end exclusive, ordered by start and then by kind as
listed in KINDS.  Spans of one kind do not overlap; a candidate that a base span overlaps is left out.

Defined cases: a null text counts as empty and has no spans; a null owner or repository is an owner or
repository of its own; rows that repeat are counted once per owner; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.llm.common import stage, text_of

KINDS = ("assign", "access", "hex", "owned")
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: Maximal runs: the same matches as with +, without those that are too short.
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}")
DIGIT, LETTER = re.compile(r"[0-9]"), re.compile(r"[A-Za-z]")
MIN_DIGITS, MIN_BITS = 3, 3.0
#: Distinct owners from which a value counts as a copied example.
EXAMPLE_OWNERS = 2


def bits_per_char(value: str) -> float:
    counts = np.unique(np.frombuffer(value.encode("utf-8", "replace"), np.uint8), return_counts=True)[1]
    share = counts / counts.sum()
    return float(-(share * np.log2(share)).sum())


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind's place in KINDS, end, value), in order."""
    found = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        found += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(found)


def candidates(text: str, taken: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """Tokens of 20 or more characters with letters and digits that no base span overlaps."""
    out, j, held = [], 0, sorted((a, b) for a, _, b, _ in taken)
    starts = [a for a, _ in held]
    for m in CANDIDATE.finditer(text):
        value = m[0]
        if len(DIGIT.findall(value)) < MIN_DIGITS or not LETTER.search(value) or bits_per_char(value) < MIN_BITS:
            continue
        while j < len(held) and held[j][1] <= m.start():
            j += 1
        if any(held[i][1] > m.start() for i in range(j, bisect_left(starts, m.end()))):
            continue
        out.append((m.start(), 3, m.end(), value))
    return out


def render(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


SPAN = "struct<start:int,kind:int,end:int,hash:binary,random:boolean>"


def _scan(batches):
    kind = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("hash", pa.binary()), ("random", pa.bool_())]))
    for batch in batches:
        rows = []
        for text in batch.column("_text").to_pylist():
            base = base_spans(text)
            rows.append([{"start": a, "kind": k, "end": b, "hash": hashlib.sha256(v.encode("utf-8", "replace")).digest()[:16], "random": bits_per_char(v) >= MIN_BITS} for a, k, b, v in base + candidates(text, base)])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column("_owner"), batch.column("_repo"), pa.array(rows, kind)], names=["_id", "_owner", "_repo", "_spans"])


def ownership(found: DataFrame) -> DataFrame:
    """found: hash, owner, repo.  One row per hash: n_seen, n_repos, n_owners.

    Counted in steps whose partial sums shrink before each shuffle, so a value that a third of all
    rows hold reaches a task as one row per owner and repository.
    """
    each = found.groupBy("hash", "owner", "repo").agg(F.count("*").alias("n"))
    owners = each.groupBy("hash", "owner").agg(F.sum("n").alias("n"), F.count("*").alias("pairs"))
    repos = each.groupBy("hash", "repo").agg(F.lit(1).alias("one")).groupBy("hash").agg(F.count("*").alias("n_repos"))
    totals = owners.groupBy("hash").agg(F.sum("n").alias("n_seen"), F.count("*").alias("n_owners"))
    return totals.join(repos, "hash")


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", owner: str = "source", repo: str = "source", example_owners: int = EXAMPLE_OWNERS) -> tuple[DataFrame, DataFrame]:
    """(spans, values).  spans: one row per document row: key, _row, spans [(start, kind, end, hash, verdict)].

    verdict: ``example`` (held by example_owners owners or more), ``live`` (fewer, and random
    looking) or ``plain``.  values: the ownership table.
    """
    none = F.lit("\\N")
    d = docs.select(F.col(key).alias("_id"), F.coalesce(F.col(owner).cast("string"), none).alias("_owner"), F.coalesce(F.col(repo).cast("string"), none).alias("_repo"), text_of(text).alias("_text"))
    kind = d.schema["_id"].dataType.simpleString()
    found = d.mapInArrow(_scan, f"_id {kind}, _owner string, _repo string, _spans array<{SPAN}>")
    found = stage(found.withColumn("_row", F.monotonically_increasing_id()), "secrets")
    each = found.where(F.size("_spans") > 0).select("_row", "_owner", "_repo", F.explode("_spans").alias("s"))
    values = stage(ownership(each.select(F.col("s.hash").alias("hash"), F.col("_owner").alias("owner"), F.col("_repo").alias("repo"))), "secret-values")
    # a value's rows join one row, so Spark can split a hot value's rows among tasks
    judged = each.join(values.select("hash", "n_owners"), each["s.hash"] == values["hash"]).select(
        "_row",
        F.struct(
            F.col("s.start").alias("start"), F.col("s.kind").alias("kind"), F.col("s.end").alias("end"), F.col("s.hash").alias("hash"),
            F.when(F.col("n_owners") >= example_owners, "example").when(F.col("s.random"), "live").otherwise("plain").alias("verdict"),
        ).alias("s"),
    )
    spans = judged.groupBy("_row").agg(F.array_sort(F.collect_list("s")).alias("spans"))
    empty = F.expr("cast(array() as array<struct<start:int,kind:int,end:int,hash:binary,verdict:string>>)")
    out = found.select("_row", F.col("_id").alias(key)).join(spans, "_row", "left").withColumn("spans", F.coalesce("spans", empty))
    return out, values


def joined(spans) -> F.Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    one = lambda s: F.concat(F.element_at(kinds, s["kind"] + 1), F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def digest(spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per document row: counts, base_sha256 and all spans that count (base, and live candidates)."""
    base = F.filter("spans", lambda s: s["kind"] < 3)
    shown = F.filter("spans", lambda s: (s["kind"] < 3) | (s["verdict"] == "live"))
    count = lambda test: F.size(F.filter("spans", test)).cast("long")
    of_kind = lambda k: lambda s: s["kind"] == k
    return spans.select(
        key,
        *(count(of_kind(k)).alias(f"n_{KINDS[k]}") for k in range(3)),
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
        joined(shown).alias("spans"),
        count(lambda s: s["verdict"] == "live").alias("n_live"),
        count(lambda s: s["verdict"] == "example").alias("n_example"),
    )
