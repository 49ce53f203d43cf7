"""Main text of web pages: markup first, then a suffix array over the token streams of each host.

A page is read into blocks. Blocks of menus, page headers, footers, sidebars, notices, adverts, forms and reader comments
are known by their tags and class names and go. Blocks inside an article or main element are its text and stay, also
where other pages repeat them. For every other block repetition decides: the token streams of a host's pages are joined,
substrings of 8 tokens or more that different pages share are found in suffix arrays, what they cover is boilerplate
and goes, and unique runs stay. Streams contain all blocks outside articles, so menus back up what they repeat.

One host may have a third of all pages. Token streams of a host are therefore cut into runs around shared anchors (the
4-token string with the smallest hash of each 8-token one), and runs are dealt by host and anchor; equal runs of a lot of
pages are sent once, with the smallest and largest stream that has them. Pages that are copies of each other have one
stream and don't make each other boilerplate.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formloom.llm.common import table
from formloom.llm.suffixes import named_order

#: Tokens of a repeated string, tokens of its anchor, tokens in one suffix array, pages in a lot.
SIZE, GRAM, ARRAY, LOT = 8, 4, 1 << 18, 4000

# Elements without text of the page, elements that aren't the article, elements that break a line.
SILENT = frozenset("script style noscript template svg math iframe object canvas head title select textarea button".split())
CHROME = frozenset("nav footer aside form menu dialog".split())
BREAKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot "
    "th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Words of class names, ids and roles of what isn't the article.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments complementary consent contentinfo "
    "cookie cookies disqus footer gdpr menu modal nav navbar navigation newsletter notice notices popup promo promotion related "
    "respond search share sharing sidebar social sponsor sponsored subscribe widget".split()
)
# Elements of a page's head; elements that end an open paragraph; table parts and options with what each
# ends; ends that don't reach an element outside; block elements that can't be in a list of options or in a button.
HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
END_P = BREAKS - frozenset("body caption html legend optgroup option tbody td tfoot th thead tr".split())
CELLS, GROUPS = frozenset(("td", "th")), frozenset("caption tbody tfoot thead".split())
ENDS = {
    "li": frozenset(("li",)), "dd": frozenset(("dd", "dt")), "dt": frozenset(("dd", "dt")), "option": frozenset(("option",)),
    "optgroup": frozenset(("option", "optgroup")), "td": CELLS, "th": CELLS, "tr": CELLS | {"tr"} | {"caption"},
    **{g: CELLS | {"tr"} | GROUPS for g in GROUPS},
}
SCOPE = frozenset("caption html object table td template th".split())
OUTSIDE = {"select": BREAKS - {"hr", "optgroup", "option"} | {"button", "input", "select", "textarea"}, "button": frozenset("article body button form main section".split())}
TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(script|style|noscript|template|textarea|title)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>|<[!?/][^>]*>",
    re.S | re.I,
)
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
PIECES = re.compile(r"[A-Za-z]+")
BLANK = re.compile(r"[\s ]+")


def _is_chrome(tag: str, attributes: str, in_article: bool) -> bool:
    if tag in CHROME or tag == "header" and not in_article:
        return True
    if tag in ("html", "body", "article", "main") or not attributes:
        return False
    return any(p.lower() in MARKS for m in NAMES.finditer(attributes) for p in PIECES.findall(m[1] or m[2] or m[3] or ""))


def _still_open(stack: list[str], tag: str, closes: bool) -> int:
    """How many of the open elements stay open at a tag, by the rules for end tags that may be omitted."""
    n = len(stack)
    if closes:
        table_part = tag in CELLS or tag in GROUPS or tag in ("tr", "table")
        for i in range(n - 1, -1, -1):
            s = stack[i]
            if s == tag:
                return i
            if s == "table" if table_part else s in SCOPE or (s in BREAKS if tag not in BREAKS else tag == "li" and s in ("ul", "ol")):
                break
        return n
    if ends := ENDS.get(tag):
        in_table = tag not in ("li", "dd", "dt", "option", "optgroup")
        for i in range(n - 1, -1, -1):
            if stack[i] in ends:
                n = i
                if not in_table and tag != "optgroup":
                    break
            elif stack[i] == "table" if in_table else stack[i] in BREAKS and stack[i] not in ("address", "div", "p"):
                break
    if tag in END_P:
        for i in range(n - 1, -1, -1):
            if stack[i] == "p":
                return i
            if stack[i] in SCOPE or stack[i] == "button":
                break
    return n


def blocks_of(source: str) -> list[tuple[str, str]]:
    """(kind, text) of each block in page order; kind is text (of an article), chrome, or open (to be judged).

    An element that is left out ends with its own end tag, where HTML ends it without one, or where an article begins;
    a head without end tag ends at the first text or element that can't be in it. Line breaks inside a block are
    white space. Character references are decoded once, after the markup is gone.
    """
    out: list[tuple[str, str]] = []
    parts: list[str] = []
    at, left_out, left_at, article, silent = 0, "", 0, 0, ""
    stack: list[str] = []
    inner: list[str] = []

    def end_block() -> None:
        if parts:
            text = BLANK.sub(" ", html.unescape("".join(parts))).strip(" ")
            if text:
                out.append(("chrome" if left_out else "text" if article else "open", text))
            parts.clear()

    def silent_after(tag: str, closes: bool, alone: bool) -> str:
        """The silent element after a tag inside it: the same, none, or none with the tag still to be read ("-")."""
        if silent == "head":
            if closes:
                return "" if tag in ("head", "html", "body") else silent
            return silent if tag in HEAD else "-"
        if closes:
            if tag == silent:
                return ""
            if tag in inner:
                del inner[len(inner) - 1 - inner[::-1].index(tag) :]
                return silent
            return "-" if tag in BREAKS and _still_open(stack, tag, True) < len(stack) else silent
        if not inner and tag in OUTSIDE.get(silent, ()) or silent == "select" and tag in OUTSIDE["select"]:
            return "-"
        if not alone:
            inner.append(tag)
        return silent

    for m in TAG.finditer(source):
        if silent == "head" and source[at : m.start()].strip():
            silent = ""
        if m.start() > at and not silent:
            parts.append(source[at : m.start()])
        at = m.end()
        tag = (m[3] or "").lower()
        if not tag:
            continue
        closes = bool(m[2])
        alone = tag in VOID or m[4].endswith("/")
        if silent:
            silent = silent_after(tag, closes, alone)
            if silent != "-":
                continue
            silent = ""
        if tag in SILENT:
            silent = "" if closes or m[4].endswith("/") else tag
            inner.clear()
            if tag == "head" or tag == "body":
                end_block()
            continue
        if tag == "br":
            parts.append(" ")
        if tag in BREAKS:
            end_block()
        own = left_out == tag and closes and tag not in stack[left_at + 1 :]
        n = left_at if own else _still_open(stack, tag, closes)
        if left_out and n <= left_at:
            end_block()
            left_out = "" if tag not in ("article", "main") or own else left_out
        within = bool(left_out) or own and tag in ("article", "main")
        del stack[n:]
        if not closes and not alone:
            stack.append(tag)
        if tag in ("article", "main") and not (within and (left_out == tag or own)):
            if not closes and article and not left_out and _is_chrome("div", m[4], True):
                left_out, left_at = tag, len(stack) - 1  # a comment or advert that is an article of its own
                continue
            if not closes:
                left_out = "" if not article or left_at >= n else left_out
            article = max(0, article + (-1 if closes else 1))
            if closes and (not article or left_at >= n):
                left_out = ""
        elif not left_out and not own and not closes and not alone and _is_chrome(tag, m[4], article > 0):
            end_block()
            left_out, left_at = tag, len(stack) - 1
    if silent == "head" and source[at:].strip():
        silent = ""
    if at < len(source) and not silent:
        parts.append(source[at:])
    end_block()
    return out


def host_of(url: str | None) -> str:
    rest = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*://", "", url or "").split("/")[0].split("?")[0].split("#")[0]
    return re.sub(r":[0-9]+$", "", rest.rpartition("@")[2].lower())


def stream_of(blocks: list[tuple[str, str]]) -> list[str]:
    """Tokens of all blocks outside articles, in page order."""
    return [w for kind, text in blocks if kind != "text" for w in text.split(" ")]


def runs_of(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, first and last start of each stretch of 8-token strings with one anchor place."""
    n = len(tokens) - SIZE + 1
    if n < 1:
        return (np.zeros(0, np.int64),) * 3
    h = np.zeros(len(tokens) - GRAM + 1, np.uint64)
    for j in range(GRAM):
        h = (h ^ tokens[j : j + len(h)]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    place = np.argmin(np.lib.stride_tricks.sliding_window_view(h, SIZE - GRAM + 1), axis=1) + np.arange(n)
    first = np.concatenate([[0], np.flatnonzero(place[1:] != place[:-1]) + 1])
    return h[place[first]].view(np.int64), first, np.concatenate([first[1:], [n]]) - 1


def _hashed(words: list[str], known: dict[str, int]) -> np.ndarray:
    if len(known) > 500_000:
        known.clear()
    for w in words:
        if w not in known:
            known[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"))
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def _runs(send: bool):
    """Runs of all pages: with their tokens, equal ones of a lot once, or as places in their pages."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, int] = {}
        for df in batches:
            seen: dict[tuple, list] = {}
            places = []
            for page, page_hash, url, source in df.itertuples(index=False):
                tokens = _hashed(stream_of(blocks_of(source)), known)
                host, stream = host_of(url), xxhash.xxh64_intdigest(tokens.tobytes()) - (1 << 63)
                for anchor, first, last in zip(*(c.tolist() for c in runs_of(tokens)), strict=True):
                    body = tokens[first : last + SIZE].tobytes()
                    key = (host, anchor, xxhash.xxh64_intdigest(body) - (1 << 63))
                    if not send:
                        places.append((page, page_hash, *key, first))
                    elif key in seen:
                        seen[key][1:] = min(seen[key][1], stream), max(seen[key][2], stream)
                    else:
                        seen[key] = [body, stream, stream]
            if send:
                yield pd.DataFrame([(*k, *r) for k, r in seen.items()], columns=["host", "anchor", "run", "body", "least", "most"])
            else:
                yield pd.DataFrame(places, columns=["page", "page_hash", "host", "anchor", "run", "first"])

    return run


def repeated(bodies: list[bytes], least: np.ndarray, most: np.ndarray) -> list[np.ndarray]:
    """For each run, which of its 8-token strings different streams have."""
    runs = [np.frombuffer(b, np.uint64) for b in bodies]
    sizes = np.array([len(r) for r in runs])
    flat = np.concatenate(runs)
    _, names = np.unique(flat, return_inverse=True)
    array = named_order(names.astype(np.int64), SIZE)
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(runs)), sizes)
    inside = np.arange(len(flat)) + SIZE <= ends[owner]
    before = np.concatenate([[-1], array[:-1]])
    same = inside[array] & (before >= 0)
    same &= inside[before]
    for k in range(SIZE):
        live = np.flatnonzero(same)
        same[live] = names[array[live] + k] == names[before[live] + k]
    group = np.cumsum(~same) - 1
    low, high = np.full(group[-1] + 1, np.iinfo(np.int64).max), np.full(group[-1] + 1, np.iinfo(np.int64).min)
    whole = inside[array]
    np.minimum.at(low, group[whole], least[owner[array[whole]]])
    np.maximum.at(high, group[whole], most[owner[array[whole]]])
    out = np.zeros(len(flat), bool)
    out[array] = low[group] < high[group]
    return [out[e - s : e - SIZE + 1] for e, s in zip(ends, sizes, strict=True)]


def _judged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Whole (host, anchor) groups, sorted, are gathered up to a bound; one suffix array judges their runs."""
    held: dict[tuple, list] = {}
    size, group = 0, None

    def told() -> pd.DataFrame:
        rows = list(held.values())
        found = repeated([r[0] for r in rows], *(np.array([r[i] for r in rows], np.int64) for i in (1, 2)))
        on = [(*k, f.tobytes()) for k, f in zip(held, found, strict=True) if f.any()]
        return pd.DataFrame(on, columns=["host", "anchor", "run", "on"])

    for df in batches:
        for host, anchor, run, body, least, most in df.itertuples(index=False):
            if size > ARRAY and (host, anchor) != group:
                yield told()
                held, size = {}, 0
            group, key = (host, anchor), (host, anchor, run)
            if key in held:
                held[key][1:] = min(held[key][1], least), max(held[key][2], most)
            else:
                held[key] = [body, least, most]
                size += len(body) // 8
    if held:
        yield told()


def main_text(blocks: list[tuple[str, str]], hits) -> tuple[str, int]:
    """Text of a page, and how many tokens outside articles are covered by repeats."""
    words = stream_of(blocks)
    covered = np.zeros(len(words) + 1, np.int32)
    for hit in hits if hits is not None else ():
        first = hit["first"] + np.flatnonzero(np.frombuffer(hit["on"], bool))
        first = first[first + SIZE <= len(words)]
        np.add.at(covered, first, 1)
        np.add.at(covered, first + SIZE, -1)
    off = np.cumsum(covered[:-1]) > 0
    lines, at = [], 0
    for kind, text in blocks:
        if kind == "text":
            lines.append(text)
            continue
        size = text.count(" ") + 1
        if kind == "open":
            rest = [w for w, o in zip(words[at : at + size], off[at : at + size], strict=True) if not o]
            if rest:
                lines.append(" ".join(rest))
        at += size
    return "\n".join(lines), int(off.sum())


def _texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for df in batches:
        told = [main_text(blocks_of(source), hits) for source, hits in zip(df["source"], df["hits"], strict=True)]
        yield pd.DataFrame({"page": df["page"], "url": df["url"], "text": [t for t, _ in told], "n_chars": [len(t) for t, _ in told], "n_covered": [n for _, n in told]})


def extracted(pages: DataFrame, partitions: int | None = None) -> DataFrame:
    """page_id, url, text, n_chars, n_covered for each row of ``pages`` (page_id, url, html).

    Null html is empty, and its text is the empty string. A null or broken url has the host "" like others of its kind.
    Equal rows get equal texts; null ids are kept apart by their html. An empty table gives an empty result; further
    columns are left out. Nothing is capped: texts of any length are kept whole.
    """
    spark = pages.sparkSession
    parts = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), pages.rdd.getNumPartitions())
    kind = pages.schema["page_id"].dataType
    source = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.coalesce(F.col("page_id").cast("string"), F.lit("null")).alias("page"), F.xxhash64(source).alias("page_hash"), "url", source.alias("source"))
    sent = rows.mapInPandas(_runs(True), "host string, anchor bigint, run bigint, body binary, least bigint, most bigint")
    sent = sent.repartition(parts, "host", "anchor").sortWithinPartitions("host", "anchor")
    judged = sent.mapInPandas(_judged, "host string, anchor bigint, run bigint, on binary")
    places = rows.mapInPandas(_runs(False), "page string, page_hash bigint, host string, anchor bigint, run bigint, first int")
    hits = places.join(judged, ["host", "anchor", "run"]).select("page", "page_hash", "first", "on").distinct()
    hits = hits.groupBy("page", "page_hash").agg(F.collect_list(F.struct("first", "on")).alias("hits"))
    met = rows.join(hits, ["page", "page_hash"], "left").select("page", "url", "source", "hits")
    out = met.mapInPandas(_texts, "page string, url string, text string, n_chars bigint, n_covered bigint")
    return out.select(F.when(F.col("page") != "null", F.col("page")).cast(kind).alias("page_id"), "url", "text", "n_chars", "n_covered")


def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages"))
