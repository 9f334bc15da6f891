"""Token ids in binary files: canonical length-limited Huffman codes from global counts.

Documents are dealt into ranges of ascending id and tokenised there; each gets an end
id.  The counts of all ids give one canonical code whose lengths are limited, so that one table look-up
decodes an id.  Ids are written in blocks of whole documents that are decoded
independently; a block's header has the bit offset of every ``STRIDE``-th id, at which
decoding can start, and all of these are decoded side by side.

A dataset is a folder with ``codebook`` (one row: the code length of every id) and ``blocks`` (Parquet
written through Spark's commit protocol, so that lost tasks leave no half files): part, block, start
(ids before the block in all files), keys, lengths and ``payload``, the bytes described at ``pack``.

Defined cases: a null text is an empty text: the end id alone; rows of one id follow each other by text hash;
null ids come first; an empty table gives an empty dataset; extra columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.llm.common import mix, odd_multipliers, single_threaded, stage, staged_path, text_of

MAX_LENGTH = 16
STRIDE = 256
BLOCK_IDS = 1 << 18
MAGIC = b"EHF1"
#: Words whose ids a worker keeps.
CACHE_WORDS = 1_000_000
SLOT_BITS = 21
SLOTS = 1 << SLOT_BITS
#: A text longer than this is split where a word must begin.
PIECE_CHARS = 1 << 18


def code_lengths(counts: np.ndarray, limit: int = MAX_LENGTH) -> np.ndarray:
    """Optimal code lengths of at most limit bits for the ids that occur (package-merge); 0 for the rest."""
    out = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    if len(used) <= 1:
        out[used] = 1
        return out
    limit = max(limit, int(np.ceil(np.log2(len(used)))))
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.float64)
    merged, flags = leaves, [np.ones(len(leaves), bool)]
    for _ in range(limit - 1):
        pairs = merged[0 : len(merged) // 2 * 2 : 2] + merged[1::2][: len(merged) // 2]
        both = np.concatenate([leaves, pairs])
        at = np.argsort(both, kind="stable")
        merged = both[at]
        flags.append(at < len(leaves))
    take = 2 * len(leaves) - 2
    length = np.zeros(len(leaves), np.int64)
    for flag in reversed(flags):
        singles = int(flag[:take].sum())
        length[:singles] += 1
        take = 2 * (take - singles)
    out[order] = length
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """The code of each id: in order of length, then id."""
    codes = np.zeros(len(lengths), np.uint64)
    code = 0
    for bits in range(1, int(lengths.max(initial=0)) + 1):
        ids = np.flatnonzero(lengths == bits)
        codes[ids] = np.arange(code, code + len(ids), dtype=np.uint64)
        code = (code + len(ids)) << 1
    return codes


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(id, code length) for every value of the next ``bits`` bits, and bits."""
    bits = max(int(lengths.max(initial=1)), 1)
    ids = np.flatnonzero(lengths)
    ids = ids[np.lexsort((ids, lengths[ids]))]
    span = np.left_shift(1, bits - lengths[ids].astype(np.int64))
    table_id, table_len = np.repeat(ids, span).astype(np.int32), np.repeat(lengths[ids], span).astype(np.int64)
    rest = (1 << bits) - len(table_id)  # of a code of one id
    return np.append(table_id, np.zeros(rest, np.int32)), np.append(table_len, np.ones(rest, np.int64)), bits


def pack(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray, stride: int = STRIDE) -> bytes:
    """MAGIC, u32 stride, u64 count of ids, u64 count of bits, u64 bit offset of every stride-th id, then the bits, high bit first."""
    n = lengths[ids].astype(np.int64)
    end = np.cumsum(n)
    at = end - n
    total = int(end[-1]) if len(end) else 0
    words = np.zeros(total // 64 + 2, np.uint64)
    if len(ids):
        left = codes[ids] << (64 - n).astype(np.uint64)
        shift, word = (at & 63).astype(np.uint64), at >> 6
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        words[word[first]] = np.bitwise_or.reduceat(left >> shift, first)
        over = np.flatnonzero((at & 63) + n > 64)
        words[word[over] + 1] |= left[over] << (np.uint64(64) - shift[over])
    return b"".join([MAGIC, struct.pack("<IQQ", stride, len(ids), total), at[::stride].astype("<u8").tobytes(), words.astype(">u8").tobytes()[: (total + 7) // 8]])


def unpack(payload: bytes, table: tuple[np.ndarray, np.ndarray, int]) -> np.ndarray:
    """The ids of a block; every checkpoint's run is decoded beside the others."""
    if payload[:4] != MAGIC:
        raise ValueError("not a block of this format")
    stride, n, total = struct.unpack_from("<IQQ", payload, 4)
    if not n:
        return np.zeros(0, np.int32)
    lanes = -(-n // stride)
    at = np.frombuffer(payload, "<u8", lanes, 24).astype(np.int64)
    ids, lens, bits = table
    data = np.frombuffer(payload, np.uint8, (total + 7) // 8, 24 + 8 * lanes)
    data = np.concatenate([data, np.zeros(16, np.uint8)])
    wide = data[:-3].astype(np.uint32) << 24 | data[1:-2].astype(np.uint32) << 16 | data[2:-1].astype(np.uint32) << 8 | data[3:]
    if bits > 24:
        raise ValueError("codes of more than 24 bits")
    down, mask, last = 32 - bits, (1 << bits) - 1, len(wide) - 1
    out = np.empty((stride, lanes), np.int32)
    for i in range(min(stride, n)):
        value = (wide[np.minimum(at >> 3, last)] >> (down - (at & 7)).astype(np.uint32)) & mask
        out[i] = ids[value]
        at += lens[value]
    return out.T.reshape(-1)[:n]


#: The word pattern of the vocabulary's pre-tokenizer is
#: 's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+
#: Characters below this are split in numpy; texts with others go through the library whole.
LATIN = 0x250
LETTER, NUMBER, OTHER, SPACE, FOREIGN = range(5)
BASE = int(odd_multipliers(9, 1)[0])


def _classes() -> np.ndarray:
    import unicodedata

    out = np.full(LATIN + 1, OTHER, np.uint8)
    for p in range(LATIN):
        kind = unicodedata.category(chr(p))[0]
        out[p] = LETTER if kind == "L" else NUMBER if kind == "N" else OTHER
    out[[9, 10, 11, 12, 13, 32]] = SPACE
    out[[0x1C, 0x1D, 0x1E, 0x1F, 0x85, 0xA0, LATIN]] = FOREIGN  # white space to some, and all that is above
    return out


class Tokens:
    """Ids of texts as the tokenizers library gives them for words of a byte-level vocabulary.

    The library splits a text into words and tokenises each.  Words recur, so texts are split and
    hashed (64 bits) in numpy, and only words not seen before go through the library; their ids are
    kept.  Texts with characters beyond Latin ones, special strings or apostrophe endings go through the library whole.
    """

    def __init__(self, path: str):
        single_threaded()
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.classes = _classes()
        names = self.library.get_vocab()
        self.begins = np.zeros(max(names.values()) + 1, bool)
        self.begins[[i for name, i in names.items() if name.startswith("\u0120")]] = True
        self.line = self.library.encode("\n", add_special_tokens=False).ids
        self.forget()

    def forget(self) -> None:
        self.slots, self.words = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.int32)
        self.known = 0
        self.start, self.size = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self.flat, self.used = np.zeros(1 << 14, np.uint32), 0

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The word number of each key, -1 for new ones: a hash table with linear probing, all keys at once."""
        at = (keys >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        held = self.slots[at]
        out = np.where(held == keys, self.words[at], -1)
        todo = np.flatnonzero((held != keys) & (held != 0))
        while len(todo):
            at[todo] = (at[todo] + 1) & (SLOTS - 1)
            held = self.slots[at[todo]]
            hit = held == keys[todo]
            out[todo[hit]] = self.words[at[todo[hit]]]
            todo = todo[~hit & (held != 0)]
        return out

    def keep(self, keys: np.ndarray) -> None:
        """Numbers new, distinct keys from ``known`` on."""
        number = np.arange(self.known, self.known + len(keys), dtype=np.int32)
        at = (keys >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        todo = np.arange(len(keys))
        while len(todo):
            free = todo[self.slots[at[todo]] == 0]
            _, first = np.unique(at[free], return_index=True)
            own = free[first]
            self.slots[at[own]], self.words[at[own]] = keys[own], number[own]
            todo = np.setdiff1d(todo, own, assume_unique=True)
            at[todo] = (at[todo] + 1) & (SLOTS - 1)
        self.known += len(keys)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        out: list[np.ndarray] = []
        lo, held = 0, 0
        for i, t in enumerate(texts):
            if len(t) > PIECE_CHARS:
                out += self.latin(texts[lo:i])
                out.append(np.concatenate([x for piece in self.cut(t) for x in self.latin([piece])]))
                lo, held = i + 1, 0
            elif (held := held + len(t)) > PIECE_CHARS:
                out += self.latin(texts[lo : i + 1])
                lo, held = i + 1, 0
        return out + self.latin(texts[lo:])

    def cut(self, text: str) -> list[str]:
        """Pieces that begin with a blank and a letter after a character that isn't blank: a word begins there.

        A text with a special string or foreign characters isn't cut.
        """
        import re

        if any(x in text for x in self.special) or not text.isascii() and max(text) >= chr(LATIN):
            return [text]
        parts, at = [], 0
        for m in re.compile(r"(?<=\S)(?= [A-Za-z])").finditer(text):
            if m.start() - at >= PIECE_CHARS:
                parts.append(text[at : m.start()])
                at = m.start()
        return [*parts, text[at:]]

    def latin(self, texts: list[str]) -> list[np.ndarray]:
        if not texts:
            return []
        whole = "".join(texts)
        points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), "<u4")
        ends = np.cumsum([len(t) for t in texts])
        begins = ends - [len(t) for t in texts]
        kind = self.classes[np.minimum(points, LATIN)]
        odd = kind == FOREIGN
        quote = np.flatnonzero(points[:-1] == 39)
        odd[quote[np.isin(points[quote + 1], np.frombuffer(b"strvmld", np.uint8))]] = True
        odd = {int(x) for x in np.searchsorted(ends, np.flatnonzero(odd), "right")}
        for x in self.special:
            if x in whole:
                odd |= {i for i, t in enumerate(texts) if x in t}
        n = len(points)
        start = np.empty(n, bool)
        if n:
            start[0] = True
            start[1:] = kind[1:] != kind[:-1]
            inner = begins[begins < n]
            start[inner] = True
            after = np.flatnonzero((kind[1:] != SPACE) & (kind[:-1] == SPACE)) + 1
            first = np.zeros(n, bool)
            first[inner] = True
            after = after[~first[after]]
            start[after - 1] = True  # the last blank before a word belongs to it, or is a word
            start[after[points[after - 1] == 32]] = False
        at = np.flatnonzero(start)
        # a word's hash is the sum of its characters times powers of its places: a difference of running sums, moved to place 0
        powers, inverse = _powers(n)
        sums = np.empty(n + 1, np.uint64)
        sums[0] = 0
        np.cumsum((points + np.uint32(1)) * powers[:n], out=sums[1:])
        stop = np.append(at[1:], n)
        h = np.maximum(mix((sums[stop] - sums[at]) * inverse[at] + (stop - at).astype(np.uint64)), np.uint64(1))
        number = self.find(h)
        if (number < 0).any():
            new = np.flatnonzero(number < 0)
            keys, first = np.unique(h[new], return_index=True)
            if self.known + len(keys) > CACHE_WORDS:
                self.forget()
                new = np.arange(len(h))
                keys, first = np.unique(h, return_index=True)
            a, b = at[new[first]].tolist(), stop[new[first]].tolist()
            self.learn(keys, [whole[x:y] for x, y in zip(a, b, strict=True)])
            number[new] = self.find(h[new])
        size = self.size[number]
        end = np.cumsum(size)
        total = int(end[-1]) if len(end) else 0
        flat = self.flat[np.repeat(self.start[number] - (end - size), size) + np.arange(total)]
        edge = np.append(end - size, total)[np.searchsorted(at, np.append(begins, n))]
        out = [flat[a:b] for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
        for i in odd:
            out[i] = np.array(self.library.encode(texts[i], add_special_tokens=False).ids, np.uint32)
        return out

    def learn(self, keys: np.ndarray, words: list[str]) -> None:
        """Tokenises new words.

        Words of letters are tokenised many at once, those with a blank before them one after the other, the rest
        a line each; which ids begin with a blank, or are the line feed, shows where each word's ids begin.
        """
        led = [i for i, w in enumerate(words) if w[0] == " " and w[1:].isalpha()]
        bare = [i for i, w in enumerate(words) if w.isalpha()]
        order, flats, sizes = [], [], []
        if led:
            got = np.array(self.library.encode_batch_fast(["".join(words[i] for i in led)], add_special_tokens=False)[0].ids, np.uint32)
            cuts = np.flatnonzero(self.begins[got])
            if len(cuts) == len(led):
                order += led
                flats.append(got)
                sizes.append(np.diff(np.append(cuts, len(got))))
        if bare and len(self.line) == 1:
            got = np.array(self.library.encode_batch_fast(["\n".join(words[i] for i in bare)], add_special_tokens=False)[0].ids, np.uint32)
            end = got == self.line[0]
            cuts = np.flatnonzero(end)
            if len(cuts) == len(bare) - 1:
                order += bare
                flats.append(got[~end])
                sizes.append(np.diff(np.append(cuts, len(got)), prepend=-1) - 1)
                sizes[-1][-1] = len(got) - (cuts[-1] + 1 if len(cuts) else 0)
        done = set(order)
        rest = [i for i in range(len(words)) if i not in done]
        if rest:
            ids = [x.ids for x in self.library.encode_batch_fast([words[i] for i in rest], add_special_tokens=False)]
            order += rest
            flats.append(np.array([x for y in ids for x in y], np.uint32))
            sizes.append(np.array([len(x) for x in ids], np.int64))
        flat, sizes = np.concatenate(flats), np.concatenate(sizes).astype(np.int64)
        base, n = self.known, len(order)
        while base + n > len(self.start):
            self.start, self.size = np.append(self.start, np.zeros_like(self.start)), np.append(self.size, np.zeros_like(self.size))
        while self.used + len(flat) > len(self.flat):
            self.flat = np.append(self.flat, np.zeros_like(self.flat))
        self.start[base : base + n] = self.used + np.cumsum(sizes) - sizes
        self.size[base : base + n] = sizes
        self.flat[self.used : self.used + len(flat)] = flat
        self.used += len(flat)
        self.keep(keys[order])


_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2**64, for n places at least."""
    if len(_POWERS[0]) < n:
        size = max(2 * PIECE_CHARS, n)
        for k, base in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS[0], _POWERS[1]


_TOKENS: dict[str, Tokens] = {}


def tokenised(docs: DataFrame, encoder: Callable[[], Callable[[list[str]], list[np.ndarray]]], key: str, text: str, end_id: int) -> DataFrame:
    """Blocks of ids in ascending order of key: part, block, start (in the part), n, keys, lengths, ids; and a row of counts for each part."""
    tie = F.xxhash64(text_of(text))
    d = docs.select(F.col(key).alias("_key"), text_of(text).alias("_text"), tie.alias("_tie"), F.monotonically_increasing_id().alias("_no"))
    d = d.repartitionByRange("_key", "_tie", "_no").sortWithinPartitions("_key", "_tie", "_no").select("_key", "_text")
    kind = d.schema["_key"].dataType.simpleString()
    schema = f"part int, block int, start long, n long, keys array<{kind}>, lengths array<long>, ids binary, count_ids array<int>, count_ns array<long>"

    def over(batches):
        encode, part = encoder(), TaskContext.get().partitionId()
        arrow = None
        counts, block, start = np.zeros(0, np.int64), 0, 0
        keys, held, size = [], [], 0

        def row(block, start, n, keys, lengths, ids, a, b):
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([start], pa.int64()), pa.array([n], pa.int64()), pa.array([keys], pa.list_(arrow)), pa.array([lengths], pa.list_(pa.int64())), pa.array([ids], pa.binary()), pa.array([a], pa.list_(pa.int32())), pa.array([b], pa.list_(pa.int64()))],
                names=["part", "block", "start", "n", "keys", "lengths", "ids", "count_ids", "count_ns"],
            )

        def close():
            ids = np.concatenate(held)
            found = np.bincount(ids)
            nonlocal counts
            if len(found) > len(counts):
                counts = np.append(counts, np.zeros(len(found) - len(counts), np.int64))
            counts[: len(found)] += found
            wide = ids.astype("<u2" if ids.max() < 65536 else "<u4")
            return row(block, start, len(ids), keys, [len(x) for x in held], bytes([wide.itemsize]) + wide.tobytes(), None, None)

        for batch in batches:
            arrow = batch.column("_key").type
            for lo in range(0, len(batch), 256):
                some = batch.slice(lo, 256)
                for k, ids in zip(some.column("_key").to_pylist(), encode(some.column("_text").to_pylist()), strict=True):
                    keys.append(k)
                    held.append(np.append(ids, np.uint32(end_id)).astype(np.uint32))
                    size += len(held[-1])
                    if size >= BLOCK_IDS:
                        yield close()
                        block, start = block + 1, start + size
                        keys, held, size = [], [], 0
        if held:
            yield close()
        if len(counts):
            some = np.flatnonzero(counts)
            yield row(-1, 0, 0, None, None, None, some.tolist(), counts[some].tolist())

    return d.mapInArrow(over, schema)


def write(docs: DataFrame, path: str, encoder, vocabulary: int, key: str = "doc_id", text: str = "text", end_id: int = 0, limit: int = MAX_LENGTH) -> None:
    spark = docs.sparkSession
    tokens = stage(tokenised(docs, encoder, key, text, end_id), "tokens")
    counted = tokens.where("block = -1").select(F.explode(F.arrays_zip("count_ids", "count_ns")).alias("c")).groupBy("c.count_ids").agg(F.sum("c.count_ns").alias("n"))
    counts = np.zeros(vocabulary, np.int64)
    for r in counted.collect():  # a row for each id of the vocabulary at most
        counts[r[0]] = r[1]
    lengths = code_lengths(counts, limit)
    spark.createDataFrame([(bytearray(zlib.compress(lengths.tobytes())), int(end_id))], "lengths binary, end_id int").coalesce(1).write.parquet(f"{path}/codebook")
    before, total = {}, 0
    for r in tokens.where("block >= 0").groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect():  # a row for each part
        before[r["part"]] = total
        total += r["n"]
    shared = spark.sparkContext.broadcast((lengths, canonical(lengths), before))

    def over(batches):
        lens, codes, offset = shared.value
        for batch in batches:
            for i in range(len(batch)):
                raw = batch.column("ids")[i].as_buffer()
                raw = memoryview(raw)
                ids = np.frombuffer(raw[1:], "<u2" if raw[0] == 2 else "<u4")
                one = batch.slice(i, 1)
                part, at = one.column("part")[0].as_py(), one.column("start")[0].as_py()
                yield pa.RecordBatch.from_arrays([one.column("part"), one.column("block"), pa.array([offset[part] + at], pa.int64()), one.column("keys"), one.column("lengths"), pa.array([pack(ids, lens, codes)], pa.binary())], names=["part", "block", "start", "keys", "lengths", "payload"])

    kind = dict(tokens.dtypes)["keys"]
    blocks = tokens.where("block >= 0").select("part", "block", "start", "keys", "lengths", "ids")
    blocks.mapInArrow(over, f"part int, block int, start long, keys {kind}, lengths array<long>, payload binary").write.option("compression", "none").parquet(f"{path}/blocks")


def read(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """One row per document: key, start, n_tokens, ids_crc32 and ids; ``digest`` leaves out the ids."""
    return _decoded(spark, path, key, True)


def digest(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    return _decoded(spark, path, key, False)


def _decoded(spark: SparkSession, path: str, key: str, with_ids: bool) -> DataFrame:
    blocks = spark.read.parquet(f"{path}/blocks")
    book = spark.read.parquet(f"{path}/codebook").first()
    shared = spark.sparkContext.broadcast(np.frombuffer(zlib.decompress(bytes(book["lengths"])), np.uint8))
    kind = dict(blocks.dtypes)["keys"].removeprefix("array<")[:-1]

    def over(batches):
        tables = decode_table(shared.value)
        for batch in batches:
            for i in range(len(batch)):
                ids = unpack(batch.column("payload")[i].as_py(), tables)
                size = np.asarray(batch.column("lengths")[i].values, np.int64)
                end = np.cumsum(size)
                raw = ids.astype("<u4").tobytes()
                crc = [zlib.crc32(raw[4 * (b - n) : 4 * b]) for b, n in zip(end.tolist(), size.tolist(), strict=True)]
                columns = [batch.column("keys")[i].values, pa.array(batch.column("start")[i].as_py() + end - size), pa.array(size), pa.array(crc, pa.int64())]
                names = [key, "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(0, end).astype(np.int32)), pa.array(ids)))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    columns = ["start", "keys", "lengths", "payload"]
    return blocks.select(*columns).mapInArrow(over, f"`{key}` {kind}, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)


def encode_texts(path: str, texts: list[str]) -> list[np.ndarray]:
    """By the tokenizers file at path.  A module's function, so that a worker keeps its words from task to task."""
    if path not in _TOKENS:
        _TOKENS[path] = Tokens(path)
    return _TOKENS[path].encode(texts)


def library_encoder(path: str):
    return lambda: lambda texts: encode_texts(path, texts)


def fresh_path(spark: SparkSession) -> str:
    return staged_path(spark, "token-files")
