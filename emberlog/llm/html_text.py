"""Main text of web pages, with a suffix array over each host's pages.

A page is split into blocks of text, each with a zone:

* ``main``: inside an article or main element.  Kept whole, also where pages share passages.
* ``noise``: in an element that never holds the article (nav, header, footer, aside, scripts, ...), or
  one that is hidden or whose role says so.  Dropped.
* ``soft`` and ``form``: in an element of which a whole class or id is made of noise words, or in a form.  Dropped, but neither rules over an article or main inside it.
  On a page without a main zone a form is a candidate if it holds most of the text, and soft blocks are if there is nothing else.
* ``suspect`` and ``hint``: inside or outside a main zone, in an element of which a class or id holds a noise word beside others.  Suspect blocks
  stay unless runs cover them wholly; hints are candidates on pages without a main zone.
* ``open``: anywhere else.  The candidates, on pages with a main zone too: the host decides.

The streams of words outside main zones of all pages are concatenated host by host, and a suffix array (by
prefix doubling, as deep as the run length ``RUN``) finds the runs of RUN or more words that recur on at least
``PAGES`` distinct pages of the host and on one in ``ONE_IN`` of them.  A candidate block that such runs cover wholly is boilerplate, and so are
``LONG`` words or more in a row that they cover inside one; all else stays.  Beside a main zone, a candidate stays only if RUN words or more are left of it and the
host has PAGES distinct pages or more: of shorter blocks and smaller hosts the runs say nothing, and the page's own mark holds.

Pages with equal texts are one page to the host, whatever their urls.  Hosts of many pages are dealt into segments of bounded size; every segment's
runs are counted by hash and the counts of a host's segments are added, so that segments change no result.

Character references are decoded, white space inside a block becomes one blank, blocks are trimmed and
joined by line feeds.  ``br`` is white space.  Unclosed elements end with their parents or with the page.

Defined cases: null or empty html gives an empty text; pages that repeat are separate rows; a null or odd url has the host ``''``; an element that ends the page in the middle of a tag is dropped from there.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.llm.common import if_small, mix, odd_multipliers, stage, text_of

RUN = 8
PAGES = 3
ONE_IN = 20
#: Covered words in a row that are cut out of a block of which other words stay.
LONG = 12
#: Words of one segment of a host, about.
SEGMENT_WORDS = 2_000_000
#: Hosts up to which their names and sizes are broadcast (some 10 MB).
HOSTS_BROADCAST = 200_000
#: Boilerplate runs up to which they are broadcast (some 20 MB).
RUNS_BROADCAST = 200_000
#: Their content is not text.
RAW = frozenset("script style noscript template svg iframe textarea select canvas title audio video".split())
NOISE = frozenset("nav header footer aside button menu dialog head".split())
NOISE_WORDS = frozenset(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies dialog disclaimer disqus footer header login masthead menu modal nav navbar navigation "
    "newsletter notice notices notification pagination popup promo promoted promotion related respond search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget widgets".split()
)
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search alert dialog form menu menubar".split())
MAIN = frozenset(("article", "main"))
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that another of the named ones closes.
CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
BOUND = frozenset("ul ol dl table article main section div nav aside footer header form body".split())
PIECE = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(>|\Z)", re.DOTALL)
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.IGNORECASE)
NAMES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
SPACE = re.compile(r"\s+")
NOISE_ZONE, OPEN_ZONE, MAIN_ZONE, SUSPECT_ZONE, HINT_ZONE, SOFT_ZONE, FORM_ZONE = range(7)


def says_noise(tag: str, attributes: str, inside: bool) -> tuple[bool, bool, bool]:
    """Do role or style mark the element; is a class or id made of noise words; does one hold such a word?  A header inside the article holds its title."""
    whole = part = False
    if not attributes or tag in ("html", "body"):
        return False, whole, part
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "role":
            if value.strip().lower() in NOISE_ROLES:
                return True, whole, part
        elif name == "hidden" or name == "aria-hidden":
            if name == "hidden" or value.lower() == "true":
                return True, whole, part
        elif name == "style":
            if re.search(r"display\s*:\s*none", value, re.IGNORECASE):
                return True, whole, part
        else:
            for token in value.split():
                said = [(w := x.lower()) in NOISE_WORDS and not (inside and w == "header") for x in NAMES.findall(token) if not x.isdigit()]
                whole |= bool(said) and all(said)
                part |= any(said)
    return False, whole, part


def blocks(page: str) -> list[tuple[int, str]]:
    """(zone, text) of the page's blocks in order, without empty ones."""
    out: list[tuple[int, str]] = []
    parts: list[str] = []
    stack: list[tuple[str, tuple]] = []  # tag, what held outside it
    noise = soft = form = hint = main = False
    at = 0

    def zone() -> int:
        if noise:
            return NOISE_ZONE
        if soft or form:
            return SOFT_ZONE if soft else FORM_ZONE
        if hint:
            return SUSPECT_ZONE if main else HINT_ZONE
        return MAIN_ZONE if main else OPEN_ZONE

    def close() -> None:
        if parts:
            text = SPACE.sub(" ", html.unescape("".join(parts))).strip()
            parts.clear()
            if text:
                out.append((zone(), text))

    def pop() -> None:
        nonlocal noise, soft, form, hint, main
        _, (noise, soft, form, hint, main) = stack.pop()

    while True:
        m = PIECE.search(page, at)
        if m is None:
            parts.append(page[at:])
            break
        parts.append(page[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            if tag in BLOCK:
                close()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    if tag not in BLOCK and any(t in BLOCK for t, _ in stack[i + 1 :]):
                        break  # an inline end tag doesn't close blocks
                    while len(stack) > i:
                        pop()
                    break
            continue
        if tag in RAW:
            close() if tag == "title" else None
            if not m[3].rstrip().endswith("/"):
                end = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.IGNORECASE).search(page, at)
                at = end.end() if end else len(page)
            parts.append(" ")
            continue
        if tag in BLOCK:
            close()
            if tag in CLOSES or tag in BOUND:
                same = CLOSES.get(tag, ("p",))
                while stack and (stack[-1][0] in same or stack[-1][0] not in BLOCK and any(t in same for t, _ in stack)):
                    if stack[-1][0] in BOUND:
                        break
                    pop()
        elif tag == "br":
            parts.append(" ")
        if tag in VOID or m[3].rstrip().endswith("/"):
            continue
        says, whole, part = says_noise(tag, m[3], main)
        stack.append((tag, (noise, soft, form, hint, main)))
        noise = noise or says or tag in NOISE and not (tag == "header" and main)
        if tag in MAIN or "role" in m[3] and re.search(r"""role\s*=\s*["']?main\b""", m[3]):
            soft, form, hint, main = False, False, False, True
        else:
            soft, form, hint = soft or whole, form or tag == "form", hint or part
    close()
    return out


_M = odd_multipliers(8, RUN)


def _words(found: list[str]) -> np.ndarray:
    """Hashes of the words of all found texts, one text after the other."""
    return np.array([xxhash.xxh3_64_intdigest(w) for t in found for w in t.split()], np.uint64)


def run_hashes(words: np.ndarray) -> np.ndarray:
    """The hash of RUN words from each place on; none for the last RUN - 1 places."""
    n = len(words) - RUN + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for j in range(RUN):
        h += mix(words[j : j + n]) * _M[j]
    return mix(h)


def suffix_ranks(words: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, rank of each suffix's first RUN words), by prefix doubling; suffixes do not reach past their page's end."""
    n = len(words)
    left = ends - np.arange(n)  # words to the page's end
    rank = np.unique(words, return_inverse=True)[1].astype(np.int64)
    order, k = np.argsort(rank, kind="stable"), 1
    while k < RUN:
        step = min(k, RUN - k)  # RUN is reached exactly: a window of k words and one that ends at RUN
        then = np.where(left > step, rank[np.minimum(np.arange(n) + step, n - 1)], -1)
        order = np.lexsort((then, rank))
        new = np.concatenate([[True], (rank[order][1:] != rank[order][:-1]) | (then[order][1:] != then[order][:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new) - 1
        k += step
    return order, rank


def repeated_runs(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, number of distinct pages) of each distinct run of RUN words of the pages' streams."""
    pages = [p for p in pages if len(p) >= RUN]
    if not pages:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    words = np.concatenate(pages)
    size = np.array([len(p) for p in pages])
    ends = np.repeat(np.cumsum(size), size)
    page = np.repeat(np.arange(len(pages)), size)
    order, rank = suffix_ranks(words, ends)
    order = order[ends[order] - order >= RUN]
    # neighbours in the suffix array with one rank share at least RUN words
    classes, own = rank[order], page[order]
    at = np.lexsort((own, classes))
    classes, own, order = classes[at], own[at], order[at]
    first = np.concatenate([[True], classes[1:] != classes[:-1]])
    distinct = first | np.concatenate([[True], own[1:] != own[:-1]])
    starts = np.flatnonzero(first)
    hashes = np.concatenate([run_hashes(p) for p in pages])
    offset = np.concatenate([[0], np.cumsum(size - RUN + 1)])
    place = order[starts] - (np.cumsum(size) - size)[page[order[starts]]] + offset[page[order[starts]]]
    return hashes[place], np.add.reduceat(distinct.astype(np.int64), starts)


def candidates(found: list[tuple[int, str]]) -> set[int]:
    """The zones of the page that its host decides."""
    words = [0] * 7
    for z, t in found:
        words[z] += len(t.split())
    if words[MAIN_ZONE] or words[SUSPECT_ZONE]:
        return {OPEN_ZONE, SUSPECT_ZONE}
    if words[FORM_ZONE] > words[OPEN_ZONE] + words[HINT_ZONE]:
        return {OPEN_ZONE, HINT_ZONE, FORM_ZONE}
    return {OPEN_ZONE, HINT_ZONE} if words[OPEN_ZONE] + words[HINT_ZONE] else {SOFT_ZONE}


def _split(batches):
    kind = pa.list_(pa.struct([("zone", pa.int32()), ("text", pa.string())]))
    for batch in batches:
        found = [blocks(x) for x in batch.column("_html").to_pylist()]
        asks = [not c.isdisjoint(z for z, _ in b) for b, c in zip(found, map(candidates, found), strict=True)]
        text = ["" if a else "\n".join(t for z, t in b if z == MAIN_ZONE) for a, b in zip(asks, found, strict=True)]
        rest = [[{"zone": z, "text": t} for z, t in b] if a else [] for a, b in zip(asks, found, strict=True)]
        streams = [_words([t for z, t in b if z != MAIN_ZONE]) for b in found]
        page = np.array([xxhash.xxh3_64_intdigest("\n".join(f"{z} {t}" for z, t in b)) for b in found], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [batch.column("_id"), batch.column("_url"), batch.column("_host"), pa.array(page), pa.array(text, pa.string()), pa.array(rest, kind), pa.array([s.tobytes() for s in streams], pa.binary()), pa.array([len(s) for s in streams], pa.int64())],
            names=["_id", "_url", "_host", "_page", "_text", "_blocks", "_stream", "_words"],
        )


def cut(gone: np.ndarray) -> np.ndarray:
    """Which of a block's words go, of those that runs cover: all if all are, else LONG or more in a row."""
    if gone.all():
        return gone
    edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
    out = np.zeros(len(gone), bool)
    for a, b in edges.reshape(-1, 2):
        out[a:b] = b - a >= LONG
    return out


def uncovered(found: list[dict], boiler: set[int], judged: bool) -> str:
    """The text of main blocks, and of candidate blocks without boilerplate; judged: has the host enough pages for runs?"""
    main = any(b["zone"] in (MAIN_ZONE, SUSPECT_ZONE) for b in found)
    open_ = candidates([(b["zone"], b["text"]) for b in found])
    stream = [b["text"] for b in found if b["zone"] != MAIN_ZONE]
    words = _words(stream)
    covered = np.zeros(len(words) + 1, np.int64)
    if boiler:
        for i in np.flatnonzero(np.isin(run_hashes(words), np.fromiter(boiler, np.uint64, len(boiler)))):
            covered[i] += 1
            covered[min(i + RUN, len(words))] -= 1
    gone = np.cumsum(covered)[:-1] > 0
    out, at = [], 0
    for b in found:
        if b["zone"] == MAIN_ZONE:
            out.append(b["text"])
            continue
        own = b["text"].split()
        keep = [w for w, g in zip(own, cut(gone[at : at + len(own)]), strict=True) if not g]
        at += len(own)
        if keep and b["zone"] == SUSPECT_ZONE:
            out.append(b["text"])
        elif keep and b["zone"] in open_ and (not main or judged and len(keep) >= RUN):
            out.append(" ".join(keep))
    return "\n".join(out)


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html", min_pages: int = PAGES) -> DataFrame:
    """key, url, text: one row for each page."""
    host = F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1)), F.lit(""))
    d = pages.select(F.col(key).alias("_id"), F.col(url).alias("_url"), host.alias("_host"), text_of(page).alias("_html"))
    kind, ukind = d.schema["_id"].dataType.simpleString(), d.schema["_url"].dataType.simpleString()
    d = d.mapInArrow(_split, f"_id {kind}, _url {ukind}, _host string, _page long, _text string, _blocks array<struct<zone:int,text:string>>, _stream binary, _words long")
    d = stage(d.withColumn("_row", F.monotonically_increasing_id()), "pages")
    undecided = d.where(F.size("_blocks") > 0)
    size = d.select("_host", "_page", "_words").distinct().groupBy("_host").agg((F.sum("_words") / SEGMENT_WORDS).cast("int").alias("_more"), F.count("*").alias("_pages"))
    size = size.withColumn("_least", F.greatest(F.lit(min_pages), F.ceil(F.col("_pages") / ONE_IN)))
    size = stage(size, "page-hosts")
    n = size.count()
    size = if_small(size, n, HOSTS_BROADCAST)
    streams = d.where(F.col("_words") >= RUN).select("_host", "_page", "_stream").join(size, "_host").withColumn("_segment", F.pmod("_page", F.col("_more") + 1))
    streams = streams.repartition("_host", "_segment")  # else a host's segments would share the join's task

    def runs(pdf):
        import pandas as pd

        own = pdf.drop_duplicates("_page")
        least = pdf["_least"].iloc[0]
        h, n = repeated_runs([np.frombuffer(s, np.uint64) for s in own["_stream"]])
        if pdf["_more"].iloc[0] == 0:
            h, n = h[n >= least], n[n >= least]
        return pd.DataFrame({"_host": own["_host"].iloc[0], "_run": h.view(np.int64), "_n": n, "_least": least})

    counted = streams.groupBy("_host", "_segment").applyInPandas(runs, "_host string, _run long, _n long, _least long")
    boiler = stage(counted.groupBy("_host", "_run").agg(F.sum("_n").alias("_n"), F.max("_least").alias("_least")).where("_n >= _least").select("_host", "_run"), "page-runs")
    boiler = if_small(boiler, boiler.count(), RUNS_BROADCAST)

    def own_runs(batches):
        for batch in batches:
            rows, found = [], []
            for r, blocks_ in zip(batch.column("_row").to_pylist(), batch.column("_blocks").to_pylist(), strict=True):
                h = np.unique(run_hashes(_words([b["text"] for b in blocks_ if b["zone"] != MAIN_ZONE])))
                rows.append(np.full(len(h), r, np.int64))
                found.append(h.view(np.int64))
            hosts_ = np.repeat(np.array(batch.column("_host").to_pylist(), object), [len(x) for x in rows])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(rows)), pa.array(hosts_, pa.string()), pa.array(np.concatenate(found))], names=["_row", "_host", "_run"])

    held = undecided.select("_row", "_host", "_blocks").mapInArrow(own_runs, "_row long, _host string, _run long").join(boiler, ["_host", "_run"]).groupBy("_row").agg(F.collect_list("_run").alias("_runs"))

    def finish(batches):
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("_blocks", "_runs", "_pages"))
            text = [uncovered(b, {x & (1 << 64) - 1 for x in r or ()}, p >= min_pages) for b, r, p in zip(*columns, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_url"), pa.array(text, pa.string())], names=["_id", "_url", "_text"])

    decided = undecided.join(size.select("_host", "_pages"), "_host").join(held, "_row", "left").select("_id", "_url", "_blocks", "_runs", "_pages").mapInArrow(finish, f"_id {kind}, _url {ukind}, _text string")
    out = d.where(F.size("_blocks") == 0).select("_id", "_url", "_text").unionByName(decided)
    return out.select(F.col("_id").alias(key), F.col("_url").alias(url), F.col("_text").alias("text"))
