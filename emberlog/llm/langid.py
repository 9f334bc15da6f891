"""Language identification by interpolated Kneser-Ney character models.

Texts become streams of lower-case letters, each run of other characters one gap.  Every
language has a Kneser-Ney model of order 4 (absolute discounts, continuation counts below
the highest order, uniform base).  The n-grams of all languages lie in one array of 64-bit
hashes per order, sorted, with a log probability for each language; contexts lie in arrays
of their own with back-off weights.  The language with the lowest cross-entropy per letter wins;
texts that fit no model as its own language's texts do are marked rejected.

Learning takes at most about ``docs_per_lang`` texts of a language (by a hash of the id, at the rate
that makes the expected number that bound), so models are of bounded size.

Defined cases: null and empty texts and texts without a letter give ``und`` and score 0; with nothing to
learn from every text gives ``und``; ties go to the language first in order.  Long texts are scored whole,
in pieces that know the symbols before them; letters outside the basic plane are folded to 16 bits.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.llm.common import appended, codepoints, filled, id_crc, mix, pieces, stage, utf8

ORDER = 4
DOCS_PER_LANG = 1500
_SALT = [np.uint64(x * 0x9E3779B97F4A7C15 % (1 << 64)) for x in range(2 * ORDER + 2)]
_BASIC: list[np.ndarray] = []


def _symbol(point: int) -> int:
    c = chr(point)
    if unicodedata.category(c)[0] != "L":
        return 0
    low = ord(c.lower()[0])
    return low if low < 0x10000 else ((low * 40503) % 0xFFFF) + 1


def symbols(points: np.ndarray) -> np.ndarray:
    """16 bits for every letter, in lower case; 0 for the rest."""
    if not _BASIC:
        _BASIC.append(np.array([0 if 0xD800 <= p < 0xE000 else _symbol(p) for p in range(0x10000)], np.uint64))
    out = _BASIC[0][np.minimum(points, 0xFFFF)]
    far = np.flatnonzero(points >= 0x10000)
    for i in far:
        out[i] = _symbol(int(points[i]))
    return out


def grams(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ORDER-gram that ends at each letter, or gap after a letter, 16 bits a symbol; and its text's index."""
    return _grams(raw, offsets, np.zeros(ORDER - 1, np.uint64))[:2]


def gram_pieces(raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """grams() of bounded pieces with the texts' own indexes; a text's parts give what the whole text would."""
    last, ends = -1, np.zeros(ORDER - 1, np.uint64)
    for part, at, which in pieces(raw, offsets):
        keys, text, ends = _grams(part, at, ends if which[0] == last else np.zeros(ORDER - 1, np.uint64))
        last = which[-1]
        yield keys, which[text]


def _grams(raw: np.ndarray, offsets: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Also the last symbols kept; before are those of an earlier part of the first text (zeros at its begin)."""
    points, at = codepoints(raw, offsets)
    sym = symbols(points)
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    first = np.zeros(len(sym), bool)
    first[at[:-1][np.diff(at) > 0]] = True
    keep = sym != 0
    keep[1:] |= (sym[:-1] != 0) & ~first[1:]
    if len(sym) and before[-1]:
        keep[0] = True
    sym, text = sym[keep], text[keep]
    if not len(sym):
        return sym, text, before
    # a text begins after a gap: zeros stand before it
    starts = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
    shift = np.zeros(len(sym), np.int64)
    shift[starts] = ORDER - 1
    place = np.arange(len(sym)) + np.cumsum(shift)
    wide = np.zeros(place[-1] + 1, np.uint64)
    wide[place] = sym
    if text[0] == 0:
        wide[: ORDER - 1] = before
    key = wide.copy()
    for j in range(1, ORDER):
        key[j:] |= wide[:-j] << np.uint64(16 * j)
    return key[place], text, wide[1 - ORDER :]


def _hash(keys: np.ndarray, kind: int) -> np.ndarray:
    return mix(keys ^ _SALT[kind])


@dataclass
class Model:
    langs: list[str]
    found: list[np.ndarray] = field(default_factory=list)  # sorted hashes, by order from 1
    logp: list[np.ndarray] = field(default_factory=list)
    contexts: list[np.ndarray] = field(default_factory=list)
    backoff: list[np.ndarray] = field(default_factory=list)
    base: float = 0.0
    limit: np.ndarray | None = None  # the highest accepted cross-entropy of each language
    heat: float = 0.05

    def log_probs(self, keys: np.ndarray) -> np.ndarray:
        """log P(last symbol | those before it) of each ORDER-gram under each language."""
        out = np.zeros((len(keys), len(self.langs)), np.float32)
        todo = np.arange(len(keys))
        for n in range(ORDER, 0, -1):
            if not len(todo):
                return out
            k = keys[todo] & np.uint64((1 << 16 * n) - 1)
            hit, row = _find(self.found[n - 1], _hash(k, n))
            out[todo[hit]] += self.logp[n - 1][row]
            todo, k = todo[~hit], k[~hit]
            seen, row = _find(self.contexts[n - 1], _hash(k >> np.uint64(16), ORDER + n))
            out[todo[seen]] += self.backoff[n - 1][row]
        out[todo] += np.float32(self.base)
        return out

    def entropies(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(nats a symbol under each language, number of symbols) of each text."""
        n = len(offsets) - 1
        total, count = np.zeros((n, len(self.langs))), np.zeros(n)
        for keys, text in gram_pieces(raw, offsets):
            if len(keys):
                starts = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
                own = text[starts]
                total[own] -= np.add.reduceat(self.log_probs(keys), starts, axis=0, dtype=np.float64)
                count[own] += np.diff(np.append(starts, len(text)))
        return total / np.maximum(count, 1)[:, None], count


def _find(table: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of wanted are in the sorted table, and the rows of those."""
    if not len(table):
        return np.zeros(len(wanted), bool), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(table, wanted), len(table) - 1)
    hit = table[at] == wanted
    return hit, at[hit]


def kneser_ney(counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> Model:
    """A model from each language's distinct ORDER-grams and their counts."""
    langs = sorted(counts)
    model = Model(langs)
    levels: list[list[tuple[np.ndarray, np.ndarray]]] = []
    for n in range(ORDER, 0, -1):  # below the highest order, the count of distinct symbols before the n-gram
        if n == ORDER:
            levels.append([(np.sort(k), c[np.argsort(k)]) for k, c in (counts[x] for x in langs)])
        else:
            mask = np.uint64((1 << 16 * n) - 1)
            levels.append([np.unique(k & mask, return_counts=True) for k, _ in levels[-1]])
    levels.reverse()
    alphabet = np.unique(np.concatenate([k for k, _ in levels[0]])) if langs else np.zeros(0, np.uint64)
    model.base = float(-np.log(len(alphabet) + 1))
    below_keys, below = np.zeros(0, np.uint64), np.zeros((0, len(langs)))
    for n in range(1, ORDER + 1):
        union = np.unique(np.concatenate([k for k, _ in levels[n - 1]]))
        contexts = np.unique(union >> np.uint64(16))
        prob, back = np.zeros((len(union), len(langs))), np.zeros((len(contexts), len(langs)))
        if n == 1:
            lower = np.full((len(union), len(langs)), np.exp(model.base))
        else:
            lower = below[np.searchsorted(below_keys, union & np.uint64((1 << 16 * (n - 1)) - 1))]
        of = np.searchsorted(contexts, union >> np.uint64(16))
        for j, (keys, cnt) in enumerate(levels[n - 1]):
            ones, twos = int((cnt == 1).sum()), int((cnt == 2).sum())
            discount = min(max(ones / (ones + 2 * twos) if ones + twos else 0.5, 0.1), 0.95)
            mine = np.zeros(len(union))
            mine[np.searchsorted(union, keys)] = cnt
            total = np.bincount(of, mine, len(contexts))
            kinds = np.bincount(of, mine > 0, len(contexts))
            back[:, j] = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)
            prob[:, j] = np.maximum(mine - discount, 0) / np.maximum(total, 1)[of] + back[of, j] * lower[:, j]
        below_keys, below = union, prob
        for keys, values, kind, to, rows in ((union, prob, n, model.found, model.logp), (contexts, back, ORDER + n, model.contexts, model.backoff)):
            h = _hash(keys, kind)
            order = np.argsort(h)
            to.append(h[order])
            rows.append(np.log(values[order]).astype(np.float32))
    return model


def _count(batches):
    for batch in batches:
        raw, offsets = utf8(batch.column("text"))
        langs = np.array(batch.column("lang").to_pylist(), object)
        for keys, text in gram_pieces(raw, offsets):
            own = langs[text] if len(keys) else np.zeros(0, object)
            for lang in set(own):
                k, c = np.unique(keys[own == lang], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k), pa.string()), pa.array(k.view(np.int64)), pa.array(c.astype(np.int64))], names=["lang", "gram", "n"])


def fit(rows: DataFrame, key: str = "doc_id", docs_per_lang: int = DOCS_PER_LANG) -> Model | None:
    """A model from rows' text and lang.  Four fifths of the sample make the counts, the rest sets temperature and limits."""
    rows = rows.where("lang is not null and text is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    rate = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, docs_per_lang / n))])
    drawn = F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit("langid")), F.lit(1 << 20)) / float(1 << 20)
    sample = rows.select("text", "lang", (drawn / F.element_at(rate, F.col("lang"))).alias("u")).where("u < 1")
    sample = stage(sample, "langid-sample")  # the texts are read twice; all rows only once
    counted = sample.where("u < 0.8").select("text", "lang").mapInArrow(_count, "lang string, gram long, n long")
    got = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    if not len(got):
        return None
    lang, gram, n = got["lang"].to_numpy(), got["gram"].to_numpy().view(np.uint64), got["n"].to_numpy()
    model = kneser_ney({x: (gram[lang == x], n[lang == x]) for x in set(lang)})
    names, shared = model.langs, rows.sparkSession.sparkContext.broadcast(model)

    def score(batch):
        raw, offsets = utf8(batch.column("text"))
        h, count = shared.value.entropies(raw, offsets)
        return {"h": pa.array(list(h), pa.list_(pa.float64())), "n": pa.array(count)}

    held = appended(sample.where("u >= 0.8").select("text", "lang"), {"h": "array<double>", "n": "double"}, score).where("n > 0").select("lang", "h").toPandas()
    held = held[held["lang"].isin(names)]
    model.limit = np.full(len(names), np.inf)
    if len(held):
        h, own = np.stack(held["h"].to_numpy()), np.array([names.index(x) for x in held["lang"]])
        losses = []
        for heat in (t := np.geomspace(0.005, 1.0, 24)):
            z = -h / heat
            z -= z.max(axis=1, keepdims=True)
            losses.append(np.mean(np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(own)), own]))
        model.heat = float(t[int(np.argmin(losses))])
        for j in range(len(names)):
            if (own == j).sum() >= 20:
                mine = h[own == j, j]
                model.limit[j] = float(np.quantile(mine, 0.995) + 2 * mine.std())
    return model


def identify(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """docs with ``_el_lang`` (or ``und``), ``_el_score`` and ``_el_rejected``; names beginning with ``_el_`` are reserved."""
    if model is None:
        return docs.withColumns({"_el_lang": F.lit("und"), "_el_score": F.lit(0.0), "_el_rejected": F.lit(True)})
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batch):
        m = shared.value
        raw, offsets = utf8(filled(batch, text))
        h, count = m.entropies(raw, offsets)
        best = h.argmin(axis=1)
        z = np.exp(-(h - h.min(axis=1, keepdims=True)) / m.heat)
        score = np.where(count > 0, 1 / z.sum(axis=1), 0.0)
        none = count == 0
        lang = np.where(none, "und", np.array(m.langs, object)[best])
        return {"_el_lang": pa.array(lang, pa.string()), "_el_score": pa.array(score), "_el_rejected": pa.array(none | (h[np.arange(len(h)), best] > m.limit[best]))}

    return appended(docs, {"_el_lang": "string", "_el_score": "double", "_el_rejected": "boolean"}, predict)


def held_out(key: str, modulus: int, remainder: int) -> Column:
    return F.pmod(id_crc(key), F.lit(modulus)) == remainder
