"""Main text of web pages: runs of words that recur on a host's pages, with the markup as a hint.

A page's markup gives blocks of text in three zones: chrome (menus, headers,
footers, forms, adverts, comments ...), content (inside an article or main
element) and the rest. Chrome never counts. Over the pages of a host that have
distinct text, the runs of ``RUN`` tokens and whole blocks are counted by
their hashes, chunk by chunk, and the counts summed over the host. What such
runs cover is taken out of a block: in the rest, where a page has no content
element, every run that recurs; in content only runs that surely stand on most
pages, since articles may well share passages. The unique runs stay.
``host_texts`` does the same for pages in memory by suffix arrays.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Tokens of a recurring run, at least.
RUN = 8
#: Characters of html of a chunk, about.
CHUNK = 1_000_000
#: A run inside content is boilerplate all the same if it surely stands on more than this share of the pages.
WIDE = 0.6
#: Normal quantile of how sure that is (95 %).
SURE = 1.645
_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<raw>script|style|template|noscript|textarea|svg|iframe|object|math|canvas|title)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)",
    re.S | re.I,
)
_MARK = re.compile(r"""(?:class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_CHROME = frozenset("nav header footer aside form button select dialog menu head frameset datalist audio video fieldset".split())
_CONTENT = frozenset(("article", "main"))
#: Words of class, id or role that mark chrome.
_HINTS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner promo promotion sponsor sponsored cookie cookies consent gdpr notice notices alert sidebar aside menu nav navbar navigation navigationbar breadcrumb breadcrumbs "
    "share sharing social related recommended newsletter subscribe subscription signup popup modal overlay footer header masthead comment comments respond disqus widget toolbar pagination pager search complementary contentinfo".split()
)
_CONTENT_HINTS = frozenset("article main".split())
#: Words that say nothing of what a part of the page is for; in a compound name they stand beside a word of the list above.
_FILL = frozenset(
    "all area article bar bars big block body bottom box btn button buttons center col collapse column container content desktop div empty entry fixed full global group grid holder horizontal icon icons inline inner item items js large layout left "
    "link links list lower main medium message mini mobile module more new outer page panel part placeholder post posts primary print region right row secondary section side site slot small sticky sub tablet text tile title toggle top ui unit "
    "upper user vertical view wide wrap wrapper zone".split()
)
#: Elements whose end tag may be left out: those that a start tag ends, and the elements that it doesn't reach out of.
_ROOM = frozenset("article main section nav aside header footer form body html blockquote fieldset details dialog figure button".split())
_LISTS, _TABLES = frozenset("ul ol menu dir".split()), frozenset(("table",))
_ENDS: dict[str, tuple[frozenset[str], frozenset[str]]] = {
    "li": (frozenset(("li",)), _ROOM | _LISTS | _TABLES | {"td", "th"}),
    **dict.fromkeys(("dt", "dd"), (frozenset(("dt", "dd")), _ROOM | _LISTS | _TABLES | {"dl", "td", "th", "li"})),
    **dict.fromkeys(("td", "th"), (frozenset(("td", "th")), _TABLES | {"tr"})),
    "tr": (frozenset(("tr",)), _TABLES),
    **dict.fromkeys(("thead", "tbody", "tfoot"), (frozenset(("thead", "tbody", "tfoot")), _TABLES)),
    "option": (frozenset(("option",)), frozenset(("select", "datalist", "optgroup"))),
    "optgroup": (frozenset(("optgroup",)), frozenset(("select",))),
}
CHROME, OPEN, CONTENT = 0, 1, 2


def _is_chrome(name: str) -> bool:
    """Whether a class, id or role names chrome: all its words are of the two lists, and one of the first.

    'cookie-notice' and 'ad-slot' do, 'social-history' doesn't.
    """
    words = re.findall(r"[a-z]+", name)
    return any(w in _HINTS for w in words) and all(w in _HINTS or w in _FILL for w in words)


class _Open:
    """The open elements with the zone outside each, and where those of each name stand."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, int]] = []
        self.places: dict[str, list[int]] = {}

    def push(self, name: str, zone: int) -> None:
        self.places.setdefault(name, []).append(len(self.stack))
        self.stack.append((name, zone))

    def last(self, names: frozenset[str] | tuple[str, ...]) -> int:
        """The place of the innermost element of these names, or -1."""
        return max((p[-1] for n in names if (p := self.places.get(n))), default=-1)

    def cut(self, k: int) -> int:
        """Pop up to the element at ``k``; the zone outside it."""
        zone = self.stack[k][1]
        while len(self.stack) > k:
            self.places[self.stack.pop()[0]].pop()
        return zone

    def close(self, name: str) -> int | None:
        """Pop up to the element that ends here; the zone outside it, or None for a stray end."""
        k = self.last((name,))
        if k < 0 or (name in _INLINE and self.last(("article", "body")) > k):
            return None
        return self.cut(k)

    def imply(self, name: str) -> int | None:
        """End what a start tag ends without an end tag; the zone outside it, or None."""
        if name not in _ENDS:
            return None
        k = self.last(_ENDS[name][0])
        return self.cut(k) if k >= 0 and self.last(_ENDS[name][1]) < k else None


def blocks(page: str | None) -> tuple[list[str], list[int]]:
    """Texts of a page's blocks in page order, white space collapsed, and their zones.

    Character references are decoded once tags are gone. A line break is white
    space within its block. Unclosed and stray tags are tolerated; a page cut
    off within a tag loses that tag alone.
    """
    page = page or ""
    texts: list[str] = []
    zones: list[int] = []
    opened = _Open()
    zone, piece, at = OPEN, [], 0

    def flush() -> None:
        if piece:
            said = " ".join(html.unescape("".join(piece)).split())
            piece.clear()
            if said:
                texts.append(said)
                zones.append(zone)

    for m in _TAG.finditer(page):
        if m.start() > at:
            piece.append(page[at : m.start()])
        at = m.end()
        name = m["name"]
        if not name:
            if m["raw"]:
                piece.append(" ")
            continue
        name = name.lower()
        if name in _INLINE and "=" not in m["rest"]:
            if not m["close"] and name != "wbr" and name != "img":
                opened.push(name, zone)
            elif m["close"]:
                opened.close(name)
            continue
        if m["close"]:
            if name in _VOID:
                piece.append(" ")
                continue
            if name not in _INLINE:
                flush()
            back = opened.close(name)
            if back is not None and back != zone:
                flush()
                zone = back
            continue
        if name == "br":
            piece.append(" ")
            continue
        if name not in _INLINE:
            flush()
        if name in _VOID:
            continue
        if (outer := opened.imply(name)) is not None:
            zone = outer
        new = zone
        if zone != CHROME:
            if name in _CHROME:
                new = CHROME
            else:
                marks = set()
                if m["rest"]:
                    for k in _MARK.finditer(m["rest"]):
                        value = k[1] or k[2] or k[3] or ""
                        word = k[0][:6].lower()
                        if word.startswith("hidden") or (word.startswith("aria-h") and value == "true") or (word.startswith("style") and re.search(r"display\s*:\s*none", value)):
                            new = CHROME
                        elif not word.startswith("style"):
                            marks.update(re.sub(r"(?<=[a-z])(?=[A-Z])", "-", value).lower().split())
                if name not in _CONTENT and name not in ("html", "body") and any(map(_is_chrome, marks)):
                    new = CHROME
                elif new != CHROME and (name in _CONTENT or any(w in _CONTENT_HINTS for x in marks for w in re.findall(r"[a-z]+", x))):
                    new = CONTENT
        if new != zone:
            flush()
        if name == "p":  # a paragraph ends the one before
            while opened.stack and opened.stack[-1][0] in _INLINE:
                opened.cut(len(opened.stack) - 1)
            if opened.stack and opened.stack[-1][0] == "p":
                opened.cut(len(opened.stack) - 1)
        opened.push(name, zone)
        zone = new
    piece.append(page[at:])
    flush()
    return texts, zones


def recurring(streams: list[list[int]], run: int = RUN) -> tuple[np.ndarray, np.ndarray]:
    """For each token of the concatenated streams: inside a run that recurs on another stream, and on how many streams its commonest run stands.

    Suffixes are ranked by their first 1, 2, 4 ... tokens (prefix doubling)
    up to ``run``; those of equal rank start with the same run. Runs don't
    reach over the end of a stream.
    """
    sizes = np.array([len(s) for s in streams], np.int64)
    n = int(sizes.sum())
    if not n:
        return np.zeros(0, bool), np.zeros(0, np.int64)
    page = np.repeat(np.arange(len(streams)), sizes)
    rank = np.unique(np.concatenate([np.asarray(s, np.int64) for s in streams]), return_inverse=True)[1]
    ends = np.repeat(np.cumsum(sizes), sizes)
    width = 1
    while width < run:
        step = min(width, run - width)
        ahead = np.arange(n) + step
        inside = np.arange(n) + width + step <= ends
        pair = np.where(inside, rank * np.int64(n + 1) + rank[np.minimum(ahead, n - 1)] + 1, -1 - np.arange(n))
        rank = np.unique(pair, return_inverse=True)[1]
        width += step
    order = np.lexsort((page, rank))
    r, p = rank[order], page[order]
    new_class = np.concatenate(([True], r[1:] != r[:-1]))
    new_page = new_class | np.concatenate(([True], p[1:] != p[:-1]))
    cls = np.cumsum(new_class) - 1
    pages = np.empty(n, np.int64)
    pages[order] = np.bincount(cls, weights=new_page).astype(np.int64)[cls]
    whole = np.arange(n) + run <= ends
    pages[~whole] = 0
    most = np.zeros(n, np.int64)
    for k in range(min(run, n)):
        np.maximum(most[k:], pages[: n - k] * (whole[: n - k]), out=most[k:])
    return most > 1, most


def _surely_wide(n, streams):
    """Wilson's lower bound of the share ``n / streams`` is above ``WIDE``: one rule for hosts of any size; columns or arrays."""
    z2, p = SURE**2, n / streams
    return p + z2 / (2 * streams) - SURE * (p * (1 - p) / streams + z2 / (4 * streams * streams)) ** 0.5 > WIDE * (1 + z2 / streams)


def host_texts(pages: list[tuple[list[str], list[int]]], run: int = RUN, common: list[dict[int, bool]] | None = None) -> list[str]:
    """The main texts of pages of one host.

    ``common`` has for each page the hashes of its blocks that recur on the
    host, as far as more pages than these tell, and whether most pages have them.
    """
    known: dict[str, int] = {}
    # pages of equal streams count as one, so that copies of a page don't make its own text recur
    streams: dict[tuple[int, ...], int] = {}
    heard = [[k for k, z in enumerate(zones) if z != CHROME] for _, zones in pages]
    words = [[texts[k].split() for k in at] for (texts, _), at in zip(pages, heard, strict=True)]
    which = [streams.setdefault(tuple(known.setdefault(w, len(known)) for b in said for w in b), len(streams)) for said in words]
    begins = np.concatenate(([0], np.cumsum([len(s) for s in streams]))).astype(np.int64)
    again, most = recurring([list(s) for s in streams], run)
    wide = _surely_wide(most, max(len(streams), 1))
    out = []
    for i, ((texts, zones), at, said) in enumerate(zip(pages, heard, words, strict=True)):
        place = int(begins[which[i]])
        has_content = CONTENT in zones
        of_host = common[i] if common else {}
        stay = []
        for k, tokens in zip(at, said, strict=True):
            n = len(tokens)
            content = zones[k] == CONTENT
            covered = (wide if content else again)[place : place + n]
            place += n
            if has_content and not content:
                continue
            known_block = of_host.get(block_hash(texts[k])) if of_host else None
            gone = n if known_block or (known_block is False and not content) else int(covered.sum())
            if not gone:
                stay.append(texts[k])
            elif gone < n:
                gone_here = _stretches(covered, most[place - n : place], run)
                stay.append(" ".join(w for w, c in zip(tokens, gone_here.tolist(), strict=True) if not c) if gone_here.any() else texts[k])
        out.append("\n\n".join(stay))
    return out


def _stretches(covered: np.ndarray, most: np.ndarray, run: int) -> np.ndarray:
    """Covered tokens in stretches of ``run`` or more whose runs stand on half as many pages as the block's commonest, at least.

    A word before or after a run that happens to be the same on two pages
    isn't part of what stands on many, nor is one that a run of the next block reaches.
    """
    kept = covered & (2 * most >= (most * covered).max())
    edge = np.diff(np.concatenate(([False], kept, [False])).astype(np.int8))
    for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True):
        if b - a < run:
            kept[a:b] = False
    return kept


def block_hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def window_hashes(tokens: list[str], run: int = RUN) -> np.ndarray:
    """A 64-bit hash of every run of ``run`` tokens, in order."""
    n = len(tokens) - run + 1
    if n < 1:
        return np.zeros(0, np.int64)
    known = {w: xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in set(tokens)}
    h = np.array([known[w] for w in tokens], np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(run):
        out = (out ^ (out >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n]
    return out.view(np.int64)


def _covering(windows: np.ndarray, hashes: np.ndarray, counts: np.ndarray, n: int, run: int) -> np.ndarray:
    """For each of ``n`` tokens the largest count of the windows over it; windows that aren't among ``hashes`` count as 0."""
    most = np.zeros(n, np.int64)
    if len(hashes) and len(windows):
        order = np.argsort(hashes)
        at = np.minimum(np.searchsorted(hashes[order], windows), len(hashes) - 1)
        found = np.where(hashes[order][at] == windows, counts[order][at], 0)
        for k in range(run):
            np.maximum(most[k : k + len(found)], found, out=most[k : k + len(found)])
    return most


def page_text(texts: list[str], zones: list[int], hashes: np.ndarray, counts: np.ndarray, gone_blocks: set[int], run: int = RUN) -> str:
    """The main text of one page: ``hashes`` are the runs to be taken out, with the streams that have them, ``gone_blocks`` the whole blocks."""
    at = [k for k, z in enumerate(zones) if z != CHROME]
    said = [texts[k].split() for k in at]
    tokens = [w for b in said for w in b]
    most = _covering(window_hashes(tokens, run), hashes, counts, len(tokens), run)
    has_content, stay, place = CONTENT in zones, [], 0
    for k, words in zip(at, said, strict=True):
        n = len(words)
        here = most[place : place + n]
        place += n
        if (has_content and zones[k] != CONTENT) or (gone_blocks and block_hash(texts[k]) in gone_blocks) or (here > 0).all():
            continue
        gone = _stretches(here > 0, here, run)
        stay.append(" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g) if gone.any() else texts[k])
    return "\n\n".join(stay)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", run: int = RUN, chunk: int = CHUNK) -> DataFrame:
    """``id, url, text, n_chars`` for every page; text is empty if there is none.

    A host's pages are dealt by their text's hash into chunks of some ``chunk``
    characters, so that copies meet; results don't depend on it. A chunk gives
    the counts of its blocks, and of the runs on ``WIDE`` of its streams: a run
    on more than that share of a host's streams is one of these in some chunk.
    Those that other chunks left out and that could be wide are counted again
    over the host. Pages without content, of which every run that recurs is
    taken, look their runs up among all of the host. Pages without a host (null
    or odd urls) form one of their own. Null html is an empty page. Repeated
    rows are all returned; columns beside the three named are not read. What
    recurs is taken out of a block, and its unique words stay, however few.
    """
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), host.alias("host"), F.col(html_col).cast("string").alias("html"))
    chunks = stored(rows.groupBy("host").agg(F.ceil(F.sum(F.coalesce(F.length("html"), F.lit(0)) + 1) / chunk).cast("int").alias("chunks")))
    empty = np.zeros(0, np.int64)

    def said_of(texts: list[str], zones: list[int]) -> str:
        return "\n".join(t for t, z in zip(texts, zones, strict=True) if z != CHROME)

    def stream_of(said: str) -> int:
        return block_hash(said.replace("\n", " "))

    def long_blocks(said: str) -> set[int]:
        return {block_hash(t) for t in said.split("\n") if t.count(" ") + 1 >= run}

    def windows_of(said: str) -> np.ndarray:
        return window_hashes(said.split(), run)

    def heard(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [blocks(h) for h in b["html"]]
            said = [said_of(*g) for g in got]
            yield pd.DataFrame({"host": b["host"], "stream": [stream_of(t) for t in said], "said": said, "open": [CONTENT not in g[1] for g in got]}).drop_duplicates()

    def count(group: pd.DataFrame) -> pd.DataFrame:
        said = group["said"].unique().tolist()
        held = [b for t in said if (b := long_blocks(t))]
        streams = {t.replace("\n", " "): t for t in said}
        seen = [np.unique(windows_of(t)) for t in streams.values()]
        windows, n = np.unique(np.concatenate([empty, *seen]), return_counts=True)
        # a host of one chunk is told here; of several, what is wide over all is so in a chunk
        much = _surely_wide(n, len(streams)) if group["chunks"].iloc[0] == 1 else n >= WIDE * len(streams)
        of_blocks, m = np.unique(np.array([k for b in held for k in b], np.int64), return_counts=True)
        few = [(0, 0, len(streams)), (1, 0, len(held)), (2, 0, int(group["open"].sum()))]
        out = [pd.DataFrame(few, columns=["kind", "hash", "n"]), pd.DataFrame({"kind": 3, "hash": of_blocks, "n": m}), pd.DataFrame({"kind": 4, "hash": windows[much], "n": n[much]})]
        return pd.concat(out, ignore_index=True).assign(host=group["host"].iloc[0], of=len(streams))[["host", "kind", "hash", "n", "of"]].astype({"kind": "int32", "hash": "int64", "n": "int64", "of": "int64"})

    deal = F.pmod("stream", "chunks").cast("int").alias("chunk")
    said = rows.select("host", "html").mapInPandas(heard, "host string, stream long, said string, open boolean").join(chunks, "host").select("host", deal, "chunks", "said", "open")
    told = stored(said.groupBy("host", "chunk").applyInPandas(count, "host string, kind int, hash long, n long, of long"))
    total = lambda kind, name: F.sum(F.when(F.col("kind") == kind, F.col("n")).otherwise(0)).alias(name)
    hosts = stored(told.where("kind < 3").groupBy("host").agg(total(0, "streams"), total(1, "long"), total(2, "open")))
    summed = told.where("kind >= 3").groupBy("host", "kind", "hash").agg(F.sum("n").alias("n"), F.sum("of").alias("of")).join(hosts, "host")
    common = summed.where("kind = 3 and n > 1").select("host", F.col("hash").alias("block"), _surely_wide(F.col("n"), F.col("long")).alias("wide"), "open")
    wide_blocks = common.where("wide").groupBy("host").agg(F.collect_set("block").alias("blocks"))
    could = stored(summed.where("kind = 4").where(_surely_wide(F.col("n") + WIDE * (F.col("streams") - F.col("of")), F.col("streams"))).select("host", "hash", "n", "streams", (F.col("of") < F.col("streams")).alias("unsure")))
    listed = lambda df: df.groupBy("host").agg(F.collect_list("hash").alias("hashes"), F.collect_list("n").alias("counts"))
    sure = could.where("not unsure").select("host", "hash", "n", "streams")
    unsure = could.where("unsure")
    if not unsure.isEmpty():

        def again(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                out: list[tuple[str, int, int]] = []
                for at, h, wanted in zip(b["host"], b["html"], b["hashes"], strict=True):
                    text = said_of(*blocks(h))
                    out += [(at, int(k), stream_of(text)) for k in np.intersect1d(windows_of(text), wanted)]
                yield pd.DataFrame(out, columns=["host", "hash", "stream"]).drop_duplicates()

        where = rows.select("host", "html").join(listed(unsure).drop("counts"), "host").mapInPandas(again, "host string, hash long, stream long")
        sure = sure.unionByName(where.groupBy("host", "hash").agg(F.count_distinct("stream").alias("n")).join(hosts.select("host", "streams"), "host"))
    wide = listed(sure.where(_surely_wide(F.col("n"), F.col("streams"))))
    kind, url_kind = (pages.schema[c].dataType.simpleString() for c in (id_col, url_col))
    shape = f"id {kind}, url {url_kind}, text string, n_chars long"

    def given(b: pd.DataFrame) -> list[tuple[np.ndarray, np.ndarray, set[int]]]:
        some = lambda v: empty if v is None else np.asarray(v, np.int64)
        return [(some(h), some(n), set(some(k).tolist())) for h, n, k in zip(b["hashes"], b["counts"], b["blocks"], strict=True)]

    def result(b: pd.DataFrame, texts: list[str], at: list[int]) -> pd.DataFrame:
        b = b.iloc[at]
        return pd.DataFrame({"id": b["id"], "url": b["url"], "text": pd.Series(texts, index=b.index, dtype=object), "n_chars": [len(t) for t in texts]})

    def of_content(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [blocks(h) for h in b["html"]]
            at = [i for i, g in enumerate(got) if CONTENT in g[1]]
            facts = given(b)
            yield result(b, [page_text(*got[i], *facts[i], run) for i in at], at)

    # stored, so that Spark knows how small it is and leaves the pages where they lie
    facts = stored(wide.join(wide_blocks, "host", "full"))
    out = rows.join(facts, "host", "left").mapInPandas(of_content, shape)
    loose = stored(hosts.where("open > 0").select("host"))
    if loose.isEmpty():
        return out

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            pieces = []
            for at, h in zip(b["host"], b["html"], strict=True):
                texts, zones = blocks(h)
                text, is_open = said_of(texts, zones), CONTENT not in zones
                hashes = [np.unique(windows_of(text)), np.array(sorted(long_blocks(text)) if is_open else [], np.int64)]
                pieces += [pd.DataFrame({"host": at, "stream": stream_of(text), "block": k == 1, "hash": v, "open": is_open}) for k, v in enumerate(hashes)]
            yield pd.concat(pieces, ignore_index=True) if pieces else pd.DataFrame({"host": [], "stream": [], "block": [], "hash": [], "open": []})

    whole = rows.join(loose, "host", "left_semi")
    held = stored(whole.select("host", "html").mapInPandas(parts, "host string, stream long, block boolean, hash long, open boolean"))
    again_n = held.where("not block").groupBy("host", "hash").agg(F.count_distinct("stream").alias("n"), F.max("open").alias("open")).where("open and n > 1").select("host", "hash", "n")
    mine = held.where("open").select("host", "stream", "block", "hash").distinct()
    runs = mine.where("not block").join(again_n, ["host", "hash"]).groupBy("host", "stream").agg(F.collect_list(F.struct("hash", "n")).alias("runs")).select("host", "stream", F.col("runs.hash").alias("hashes"), F.col("runs.n").alias("counts"))
    gone = mine.where("block").join(common.select("host", F.col("block").alias("hash")), ["host", "hash"]).groupBy("host", "stream").agg(F.collect_set("hash").alias("blocks"))

    def opened(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [blocks(h) for h in b["html"]]
            at = [i for i, g in enumerate(got) if CONTENT not in g[1]]
            said = [[(t, z) for t, z in zip(*got[i], strict=True) if z != CHROME] for i in at]
            of = [stream_of("\n".join(t for t, _ in s)) for s in said]
            yield b.iloc[at].drop(columns="html").assign(stream=of, texts=pd.Series([[t for t, _ in s] for s in said], index=b.index[at], dtype=object))

    def of_open(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [page_text(list(t), [OPEN] * len(t), *f, run) for t, f in zip(b["texts"], given(b), strict=True)]
            yield result(b, texts, list(range(len(b))))

    bare = whole.mapInPandas(opened, f"id {kind}, url {url_kind}, host string, stream long, texts array<string>")
    return out.unionByName(bare.join(runs, ["host", "stream"], "left").join(gone, ["host", "stream"], "left").mapInPandas(of_open, shape))
