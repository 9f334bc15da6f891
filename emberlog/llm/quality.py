"""Quality classification by supervised subword embeddings.

Every blank-separated word, every pair of neighbouring words (one row for all pairs of equal
words) and every character 3- and 4-gram of a word with its ends is hashed to a row of an embedding table; a document is the average of its rows, a softmax
layer over it gives the class.  Table and layer are learned by stochastic gradient descent
in numpy on the driver, from at most about ``sample`` labelled documents (chosen by a hash of the id).
As averaging and the layer are linear, scoring needs one number for each row of the table.

Defined cases: null texts count as empty; an empty text gets the layer's bias alone; without
labels of both classes every score is the share of label 1 (0.5 without labels).  Labels that repeat for a document count once
(the highest).  Long texts are scored whole, in pieces that carry open words, pairs and n-grams over their cuts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.llm.common import appended, bound_batches, codepoints, filled, mix, odd_multipliers, pieces, text_of, utf8

BITS = 18
DIM = 8
SAMPLE = 3000
_M = odd_multipliers(4, 68)
_AGAIN = np.uint64(0x5851F42D4C957F2D)
_BLANKS = np.array([32, 9, 10, 11, 12, 13], np.uint32)


@dataclass
class Cut:
    """What the next part of a text needs of the parts before it."""

    ends: np.ndarray  # the last symbols, three at most
    total: np.ndarray  # of the word that the cut lies in: the sum of its hash so far, and its length
    size: int
    last: np.ndarray  # hash of the last whole word, if there is one


BEGIN = Cut(np.zeros(1, np.uint64), np.zeros(1, np.uint64), 0, np.zeros(0, np.uint64))


def buckets(raw: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(rows of the table, index of the text) of all features of the texts."""
    return _buckets(raw, offsets, BEGIN, False, bits)[:2]


def bucket_pieces(raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """buckets() of bounded pieces with the texts' own indexes; a text's parts give what the whole text would."""
    done, last, cut = int(offsets[0]), -1, BEGIN
    for part, at, which in pieces(raw, offsets):
        done += len(part)
        rows, own, cut = _buckets(part, at, cut if which[0] == last else BEGIN, done < offsets[which[-1] + 1], BITS)
        last = which[-1]
        yield rows, which[own]


def _buckets(raw: np.ndarray, offsets: np.ndarray, before: Cut, more: bool, bits: int) -> tuple[np.ndarray, np.ndarray, Cut]:
    """before: of an earlier part of the first text; more: the last text goes on after these bytes."""
    points, at = codepoints(raw, offsets)
    n, lead = len(at) - 1, len(before.ends) - 1
    place = lead + np.arange(len(points)) + np.repeat(np.arange(n), np.diff(at)) + 1  # a blank before each text, and one at the end
    s = np.zeros(lead + len(points) + n + 1, np.uint64)
    s[: lead + 1] = before.ends
    s[place] = np.where(np.isin(points, _BLANKS), 0, points + np.uint32(1))
    text = np.zeros(len(s), np.int64)
    text[place] = np.repeat(np.arange(n), np.diff(at))
    if more:
        s, text = s[:-1], text[:-1]
    full = s != 0
    down = np.uint64(64 - bits)
    found, own = [], []
    for wide in (3, 4):  # those whose last symbol is new; their inner symbols are one word's
        lo, hi = max(lead + 2 - wide, 0), len(s) - wide + 1
        if lo < hi:
            ok = full[lo + 1 : hi + 1].copy()
            if wide == 4:
                ok &= full[lo + 2 : hi + 2]
            ok = lo + np.flatnonzero(ok)
            h = s[ok] * _M[64] + s[ok + 1] * _M[65] + s[ok + 2] * _M[66]
            if wide == 4:
                h = h * np.uint64(3) + s[ok + 3] * _M[67] + np.uint64(1)
            found.append(mix(h) >> down)
            own.append(text[ok + 1])
    new = s[lead + 1 :]
    edge = np.diff(np.concatenate([[False], new != 0, [False]]).astype(np.int8))
    start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    size, total, of = stop - start, np.zeros(0, np.uint64), text[lead + 1 :][start]
    goes_on = before.size > 0 and len(start) > 0 and start[0] == 0
    if len(start):
        at_word = np.flatnonzero(new)
        within = at_word - np.repeat(start, size)
        if goes_on:
            within[: size[0]] += before.size
        total = np.add.reduceat(new[at_word] * _M[within & 63], np.concatenate([[0], np.cumsum(size)[:-1]]))
    if goes_on:
        total[:1] += before.total
        size[0] += before.size
    elif before.size:
        total, size, of = np.concatenate([before.total, total]), np.concatenate([[before.size], size]), np.concatenate([[0], of])
    rest, held = BEGIN.total, 0
    if more and len(stop) and stop[-1] == len(new):
        rest, held = total[-1:], int(size[-1])
        total, size, of = total[:-1], size[:-1], of[:-1]
    word = mix(total + size.astype(np.uint64))
    found.append(word >> down)
    own.append(of)
    word, of = np.concatenate([before.last, word]), np.concatenate([np.zeros(len(before.last), np.int64), of])
    pair = np.flatnonzero(of[1:] == of[:-1])
    both = mix(word[:-1] * np.uint64(7) + word[1:])
    found.append(np.where(word[:-1] == word[1:], _AGAIN, both)[pair] >> down)
    own.append(of[1:][pair])
    return np.concatenate(found).astype(np.int64), np.concatenate(own).astype(np.int64), Cut(s[-3:], rest, held, word[-1:])


@dataclass
class Classifier:
    weight: np.ndarray  # of each row of the table: what it adds to the log odds of class 1
    bias: float

    def scores(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        total, count = np.zeros(n), np.zeros(n)
        for rows, own in bucket_pieces(raw, offsets):
            if len(own):
                lo, m = own.min(), own.max() - own.min() + 1
                total[lo : lo + m] += np.bincount(own - lo, self.weight[rows], m)
                count[lo : lo + m] += np.bincount(own - lo, minlength=m)
        z = np.clip(total / np.maximum(count, 1) + self.bias, -30, 30)
        return 1 / (1 + np.exp(-z))


def train(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, bits: int = BITS, dim: int = DIM, epochs: int = 12, rate: float = 2.0, seed: int = 3) -> Classifier:
    """bags: rows of the table and their shares (summing to 1) of each document."""
    if not len(labels) or labels.min() == labels.max():
        share = float(np.clip(labels.mean() if len(labels) else 0.5, 1e-6, 1 - 1e-6))
        return Classifier(np.zeros(1 << bits, np.float32), float(np.log(share / (1 - share))))
    rng = np.random.default_rng(seed)
    table = rng.uniform(-1 / dim, 1 / dim, (1 << bits, dim)).astype(np.float32)
    layer = rng.uniform(-0.1, 0.1, (2, dim)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    steps, done = epochs * len(labels), 0
    for _ in range(epochs):
        for i in rng.permutation(len(labels)):
            step = rate * (1 - done / steps)
            done += 1
            rows, share = bags[i]
            hidden = share @ table[rows] if len(rows) else np.zeros(dim, np.float32)
            z = layer @ hidden + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1
            back = layer.T @ p
            layer -= step * 0.1 * np.outer(p, hidden)
            bias -= step * 0.02 * p
            if len(rows):
                # shares are small numbers; their size relative to the mean share keeps the step's length
                table[rows] -= (step * back) * np.minimum(share * len(rows) * 0.05, 1.0)[:, None]
    return Classifier((table @ (layer[1] - layer[0])).astype(np.float32), float(bias[1] - bias[0]))


def _summed(rows: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Each row once, and the sum of its counts."""
    u, back = np.unique(np.concatenate([np.zeros(0, np.int64), *rows]), return_inverse=True)
    return u, np.bincount(back, np.concatenate([np.zeros(0, np.int64), *counts]), len(u)) if len(u) else np.zeros(0)


def _bags(batches):
    """A text's pieces are added up before they hold more than twice the table's rows, so a long text takes no more memory than its bag."""
    for batch in batches:
        raw, offsets = utf8(batch.column("text"))
        all_rows, all_share = [[] for _ in range(len(batch))], [[] for _ in range(len(batch))]
        for rows, own in bucket_pieces(raw, offsets):
            order = np.argsort(own, kind="stable")
            rows, own = rows[order], own[order]
            which, cuts = np.unique(own, return_index=True)
            for i, one in zip(which, np.split(rows, cuts[1:]), strict=False):
                k, c = np.unique(one, return_counts=True)
                all_rows[i].append(k)
                all_share[i].append(c)
                if sum(map(len, all_rows[i])) > 2 << BITS:
                    all_rows[i], all_share[i] = ([x] for x in _summed(all_rows[i], all_share[i]))
        out_rows, out_share = [], []
        for k, c in zip(all_rows, all_share, strict=True):
            u, c = _summed(k, c)
            out_rows.append(u.astype(np.int32).tobytes())
            out_share.append((c / max(c.sum(), 1)).astype(np.float32).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(out_rows, pa.binary()), pa.array(out_share, pa.binary()), batch.column("label"), batch.column("u")], names=["rows", "shares", "label", "u"])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", sample: int = SAMPLE) -> Classifier:
    """A classifier from docs' text and labels' 0/1 column, joined by key; callers leave out the rows not to learn from."""
    bound_batches(docs.sparkSession)
    marked = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(key).agg(F.max(label).cast("int").alias("label"))
    n = marked.count()
    drawn = F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit("quality")), F.lit(1 << 20)) / float(1 << 20)
    marked = marked.withColumn("u", drawn).where(F.col("u") < min(1.0, sample / max(n, 1)))
    texts = docs.select(key, text_of().alias("text")).join(F.broadcast(marked), key)  # at most about sample rows
    got = texts.select("text", "label", "u").mapInArrow(_bags, "rows binary, shares binary, label int, u double").toPandas()
    got = got.sort_values(["u", "rows"], kind="stable")
    bags = [(np.frombuffer(r, np.int32), np.frombuffer(s, np.float32)) for r, s in zip(got["rows"], got["shares"], strict=True)]
    return train(bags, got["label"].to_numpy(np.int64))


def score(docs: DataFrame, model: Classifier, text: str = "text") -> DataFrame:
    """docs with ``_el_score``; names beginning with ``_el_`` are reserved."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make(batch):
        return {"_el_score": pa.array(shared.value.scores(*utf8(filled(batch, text))))}

    return appended(docs, {"_el_score": "double"}, make)
