"""Personal data: base patterns, and identifiers that bootstrapped contexts add.

1. One pass over the whole texts finds the base entities (email, ip, card, phone) and every other token that has a
   digit or an @. Each of them becomes a mention: its value, and the two words before it as its lexical pattern.
   Where the text begins, an empty word stands for a missing one; long words go by their hash.
2. Mentions are reduced to a graph of (pattern, value) edges. Base values are the seeds. In each round Spark scores
   a pattern by the share of its distinct values that are known for a kind, and a value by the patterns that it occurs
   with; only patterns with enough different known values and a high share count. Values found in one round are known
   in the next, so they make further patterns count; rounds end when scores stand still.
3. Values that reach the threshold become spans of that kind, wherever they occur in a pattern that counts for it.
   Base spans always stay.

Hot patterns and values (a word pair that a third of all texts has) are reduced to edges before any shuffle joins
them; a join whose side of patterns is hot only copies that side, never the rows of a group.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import takewhile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from formloom.llm.common import fresh, table, text_of
from formloom.session import kept

KINDS = ("email", "ip", "card", "phone")
#: A pattern needs so many different known values of a kind and such a share of all its values; a value such a score.
MIN_SEEDS = 5
MIN_SHARE = 0.6
MIN_SCORE = 0.9
#: Rounds end when no score has risen by more.
STILL = 1e-4
#: A word of a pattern that has so many characters goes by its hash, which has one more.
LONG_WORD = 40

# The base patterns of the four kinds.
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits: str) -> bool:
    doubled = [int(d) * 2 for d in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(d - 9 * (d > 9) for d in doubled)) % 10 == 0


def _passes(kind: str, found: str) -> bool:
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0")[:3] or 0) <= 255 for p in found.split("."))
    digits = re.sub("[^0-9]", "", found)
    if kind == "card":
        return 16 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 8 <= len(digits) <= 15


def _finder():
    """A function from a text to its base spans and its mentions; patterns are compiled once per batch stream."""
    base = {kind: re.compile(p) for kind, p in BASE.items()}
    digit, token, run = re.compile("[0-9@]"), re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"\S+")
    edges = " \t\n\v\f\r"

    def emails(text: str) -> Iterator[tuple[int, int]]:
        """As finditer over the whole text, but tried only at the run of name characters before each @."""
        done, at = 0, text.find("@")
        while at >= 0:
            start = at
            while start > done and (c := text[start - 1]).isascii() and (c.isalnum() or c in "._%+-"):
                start -= 1
            m = base["email"].match(text, start) if start < at else None
            if m:
                yield m.span()
                done = m.end()
            at = text.find("@", max(at + 1, done))

    def contexts(text: str, places: list[int]) -> dict[int, str]:
        """The two words before each place. A word that places cut again and again is read and hashed only once."""
        words = [m.span() for m in run.finditer(text)]
        starts, out = [a for a, _ in words], {}
        at, done, partly = -1, 0, None

        def told(a: int, b: int) -> str:
            nonlocal at, done, partly
            if b - a < LONG_WORD:
                return text[a:b].lower()
            if at != a or done > b:
                at, done, partly = a, a, hashlib.sha1(usedforsecurity=False)
            partly.update(text[done:b].casefold().encode("utf-8", "surrogatepass"))
            done = b
            return f"#{partly.copy().hexdigest()}"

        for place in places:
            i = bisect_left(starts, place)
            last = [(a, min(b, place)) for a, b in words[max(0, i - 2) : i]]
            out[place] = " ".join([*[""] * (2 - len(last)), *[told(a, b) for a, b in last]])
        return out

    def find(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str | None, int, int, str, str]]]:
        if not digit.search(text):
            return [], []
        spans = [("email", a, b) for a, b in emails(text)]
        for kind in KINDS[1:]:
            if kind != "phone" or "+" in text:
                spans += [(kind, *m.span()) for m in base[kind].finditer(text) if _passes(kind, m.group())]
        covered = sorted((a, b) for _, a, b in spans)
        places, reach = [(kind, a, b) for kind, a, b in spans], -1
        ahead = 0
        for m in digit.finditer(text):
            if m.start() < reach:
                continue
            a = m.start()
            while a > 0 and text[a - 1] not in edges:
                a -= 1
            b = token.match(text, a).end()
            reach = b
            while ahead < len(covered) and covered[ahead][1] <= a:
                ahead += 1
            if not any(a < e for _, e in takewhile(lambda s: s[0] < b, covered[ahead:])):
                inner = text[a:b].strip("\"'()[]{}<>,;:.!?")
                a += text[a:b].index(inner)
                places.append((None, a, a + len(inner)))
        patterns = contexts(text, sorted({a for _, a, _ in places}))
        return spans, [(kind, a, b, text[a:b].lower(), patterns[a]) for kind, a, b in places]

    return find


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    find = _finder()
    for batch in batches:
        rows = []
        for doc_id, digest, text in zip(batch["doc_id"], batch["digest"], batch["text"], strict=True):
            spans, mentions = find(text)
            if spans:
                rows.append((doc_id, digest, [{"kind": k, "start": a, "end": b} for k, a, b in spans], []))
            if mentions:
                told = [dict(zip(("kind", "start", "end", "value", "pattern"), m, strict=True)) for m in mentions]
                rows.append((doc_id, digest, [], told))
        yield pd.DataFrame(rows, columns=["doc_id", "digest", "spans", "mentions"])


SPAN = "struct<kind:string,start:int,end:int>"
MENTION = "struct<kind:string,start:int,end:int,value:string,pattern:string>"


def scan(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, digest, spans, mentions) for the different (doc_id, text) that have any, written once.

    ``digest`` tells texts of one id apart. doc_id is kept as text, so that a null id survives pandas.
    """
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), text_of().alias("text"))
    rows = rows.filter(F.col("text").rlike("[0-9@]")).withColumn("digest", F.sha2(F.col("text"), 256))
    return kept(rows.mapInPandas(_scan, f"doc_id string, digest string, spans array<{SPAN}>, mentions array<{MENTION}>"))


def learned(mentions: DataFrame, min_seeds: int = MIN_SEEDS, min_share: float = MIN_SHARE, min_score: float = MIN_SCORE) -> DataFrame:
    """(pattern, value, kind) edges of identifiers that aren't base entities but are scored as such.

    The score of a pattern for a kind is known / distinct values with known the sum of its values' scores (seeds have
    1); the score of a value is 1 - product(1 - share) over its patterns that qualify. A pattern qualifies by
    ``min_seeds`` seeds or values that had ``min_score`` in the last round, and by its share. Scores never fall from
    round to round, so the rounds come to an end.
    """
    edges = kept(mentions.groupBy("pattern", "value").agg(F.max("kind").alias("seed")))
    seeded = edges.groupBy("pattern").agg(F.count("*").alias("values"), *[F.count_if(F.col("seed") == k).alias(k) for k in KINDS])
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("seeds")) for k in KINDS]))
    sizes = seeded.select("pattern", "values")
    seeds = kept(seeded.filter(F.greatest(*KINDS) > 0).select("pattern", each.alias("k")).select("pattern", "k.kind", "k.seeds").filter("seeds > 0"))
    open_edges = edges.filter(F.col("seed").isNull()).select("pattern", "value")
    lacking = F.sum(F.log(F.lit(1.0) - F.least("share", F.lit(0.999999))))
    sums, scores, shares = seeds.select("pattern", "kind", F.col("seeds").alias("known"), F.col("seeds").cast("double").alias("gain")), None, None
    while True:
        enough = sums.groupBy("pattern", "kind").agg(F.sum("known").alias("known"), F.sum("gain").alias("gain")).filter(F.col("known") >= min_seeds)
        shares = enough.join(sizes, "pattern").withColumn("share", F.col("gain") / F.col("values")).filter(F.col("share") >= min_share)
        shares = kept(shares.select("pattern", "kind", "share"))
        now = kept(open_edges.join(shares, "pattern").groupBy("value", "kind").agg((F.lit(1.0) - F.exp(lacking)).alias("score")))
        if scores is None:
            moved = now
        else:
            before = scores.withColumnRenamed("score", "before")
            moved = now.join(before, ["value", "kind"], "left").filter(F.col("score") - F.coalesce("before", F.lit(0.0)) > STILL)
        scores = now
        if moved.isEmpty():
            break
        gained = open_edges.join(scores, "value").groupBy("pattern", "kind")
        gained = gained.agg(F.count_if(F.col("score") >= min_score).alias("known"), F.sum("score").alias("gain"))
        sums = seeds.select("pattern", "kind", F.col("seeds").alias("known"), F.col("seeds").cast("double").alias("gain")).unionByName(gained)
    best = scores.filter(F.col("score") >= min_score).groupBy("value").agg(F.max_by("kind", F.struct("score", "kind")).alias("found"))
    sure = shares.select("pattern", F.col("kind").alias("found"))
    return open_edges.join(best, "value").join(sure, ["pattern", "found"], "left_semi").select("pattern", "value", "found")


def rank_of(kind: Column) -> Column:
    return F.array_position(F.array(*[F.lit(k) for k in KINDS]), kind).cast("int")


def joined(spans: Column) -> Column:
    """kind:start:end by kind as listed, then start, comma-joined; an absent list is the empty string."""
    order = F.array_sort(F.transform(spans, lambda s: F.struct(rank_of(s["kind"]).alias("r"), s["start"].alias("a"), s["end"].alias("b"), s["kind"].alias("k"))))
    return F.coalesce(F.array_join(F.transform(order, lambda s: F.concat_ws(":", s["k"], s["a"], s["b"])), ","), F.lit(""))


def with_spans(docs: DataFrame, **options) -> tuple[DataFrame, str, str]:
    """``docs`` with two span lists, base and all, and the names of these columns; no row is added or lost.

    A null text is empty and has none; equal rows get equal spans; null ids are kept apart by their text. An empty
    table gives an empty result. Added columns get underscores in front where ``docs`` has their names.
    """
    found = scan(docs)
    mentions = found.select("doc_id", "digest", F.explode("mentions").alias("m")).select("doc_id", "digest", "m.*")
    extra = mentions.filter(F.col("kind").isNull()).join(learned(mentions, **options), ["pattern", "value"])
    extra = extra.select("doc_id", "digest", F.struct(F.col("found").alias("kind"), "start", "end").alias("span"))
    base = found.select("doc_id", "digest", F.explode("spans").alias("span"))
    both = base.withColumn("base", F.lit(True)).unionByName(extra.withColumn("base", F.lit(False))).distinct()
    lists = both.groupBy("doc_id", "digest").agg(
        F.collect_list(F.when(F.col("base"), F.col("span"))).alias("base"), F.collect_list("span").alias("all")
    )
    base_name, all_name, id_name, digest_name, own_id, own_digest = fresh(docs, "base_spans", "all_spans", "id_", "digest_", "own_id_", "own_digest_")
    lists = lists.select(F.col("doc_id").alias(id_name), F.col("digest").alias(digest_name), F.col("base").alias(base_name), F.col("all").alias(all_name))
    keyed = docs.withColumn(own_id, F.col("doc_id").cast("string")).withColumn(own_digest, F.sha2(text_of(), 256))
    on = F.col(own_id).eqNullSafe(F.col(id_name)) & (F.col(own_digest) == F.col(digest_name))
    out = keyed.join(lists, on, "left").drop(own_id, own_digest, id_name, digest_name)
    none = F.array().cast(f"array<{SPAN}>")
    return out.withColumn(base_name, F.coalesce(base_name, none)).withColumn(all_name, F.coalesce(all_name, none)), base_name, all_name


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, base, found = with_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda k: F.size(F.filter(F.col(base), lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return docs.select(
        "doc_id", *[count(k) for k in KINDS], F.sha2(joined(F.col(base)), 256).alias("base_sha256"),
        joined(F.col(found)).alias("spans"), (F.size(found) - F.size(base)).cast("long").alias("n_learned"),
    )


@F.pandas_udf(StringType())
def _covered(texts: pd.Series, spans: pd.Series) -> pd.Series:
    """Texts with their spans (as from ``joined``) replaced, in one pass over each; of spans that meet, the first counts.

    Null texts, those without spans, come back as nulls.
    """
    out = []
    for text, own in zip(texts, spans, strict=True):
        if text is None:
            out.append(None)
            continue
        parts, at = [], 0
        for start, end, kind in sorted((int(a), int(b), k) for k, a, b in (s.split(":") for s in own.split(","))):
            if start >= at:
                parts += [text[at:start], f"[{kind}]"]
            at = max(at, end)
        out.append("".join([*parts, text[at:]]))
    return pd.Series(out, dtype=object)


def masked(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with every found span replaced by its kind in brackets; n_chars follows the text, nulls stay null."""
    found, base, every = with_spans(docs, **options)
    some = F.size(every) > 0
    covered = _covered(F.when(some, F.col("text")), joined(F.col(every)))  # other texts stay in the JVM
    out = found.withColumn("text", F.when(some, covered).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(some, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
