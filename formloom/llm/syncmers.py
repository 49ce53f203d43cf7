"""Document fingerprints from closed syncmers.

A k-mer of code points is taken if the smallest hash among its inner s-mers lies at its first or last place. Whether it
is taken depends on its own characters only, so an edit elsewhere never moves an anchor. The fingerprint has
all anchors, each with its place in the text, so it grows with the text (about two anchors in 13 characters). Two
fingerprints are alike by the share of different anchors that both have among those of either, counted along the
longest chain in which their first places grow in both texts.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from formloom.llm.common import table, text_of
from formloom.session import kept

K, S = 20, 8
#: Characters of texts whose rows are sent on together: their fingerprints are several times as long.
LOT = 2_000_000
_MUL = np.uint64(0x9E3779B97F4A7C15)


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _joined(h: np.ndarray, size: int, to: int) -> np.ndarray:
    """Hashes of runs of ``to`` code points from those of runs of ``size``: two that overlap cover the longer run."""
    while size < to:
        step = min(size, to - size)
        h = _mixed(h[:-step] * _MUL + h[step:])
        size += step
    return h


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each window of ``width`` values, by doubling."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x = np.minimum(x[:-step], x[step:])
        have += step
    return x


def anchors(codes: np.ndarray, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the closed syncmers; a text shorter than k is one anchor, an empty one has none."""
    if len(codes) < k:
        if not len(codes):
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        h = np.array([len(codes)], np.uint64)
        for c in codes.astype(np.uint64):
            h = _mixed(h * _MUL + c + np.uint64(1))
        return np.zeros(1, np.int64), h
    small = _joined(_mixed((codes.astype(np.uint64) + np.uint64(1)) * _MUL), 1, s)
    least = _least(small, k - s + 1)
    at = np.flatnonzero((small[: len(least)] == least) | (small[k - s :] == least))
    # two of its inner runs at the chosen places identify the k-mer: hash all runs of s that tile it
    tiles = [small[at + j] for j in [*range(0, k - s, s), k - s]]
    h = tiles[0]
    for t in tiles[1:]:
        h = _mixed(h * _MUL + t)
    return at, h


def smallest(at: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All anchors, the smallest hashes first, equal ones by place."""
    order = np.argsort(h, kind="stable")  # places come in ascending order
    return at[order], h[order]


def _first(fp: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The different anchors of a fingerprint, each at its first place."""
    first = np.ones(len(fp[1]), bool)
    first[1:] = fp[1][1:] != fp[1][:-1]
    return fp[0][first], fp[1][first]


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """0 to 1; two empty fingerprints are alike, an empty and another one aren't."""
    if not len(a[1]) or not len(b[1]):
        return float(len(a[1]) == len(b[1]))
    a, b = _first(a), _first(b)
    common, ia, ib = np.intersect1d(a[1], b[1], assume_unique=True, return_indices=True)
    places = b[0][ib][np.argsort(a[0][ia], kind="stable")]
    length = len(common)
    if (places[1:] <= places[:-1]).any():
        tops: list[int] = []
        for place in places.tolist():
            i = bisect_left(tops, place)
            tops[i : i + 1] = [place]
        length = len(tops)
    return length / (len(a[1]) + len(b[1]) - len(common))


def printed(fp: tuple[np.ndarray, np.ndarray]) -> str:
    """Anchors as hash@place in hexadecimal, ascending, joined by spaces."""
    return " ".join([f"{h:016x}@{a:x}" for a, h in zip(fp[0].tolist(), fp[1].tolist(), strict=True)])


def _row(doc_id, text: str, own, following: str, other) -> tuple:
    """One result row; ``own`` and ``other`` are codes and anchors of the text and of the next one.

    The edited text shares its first half with the text and its second with the start of the next one. Anchors hang
    on nothing outside their k characters, so only those across the joint are computed anew.
    """
    codes, at, h = own
    n = len(codes)
    cut = n - n // 2
    next_codes, next_at, next_h = other
    taken = next_codes[: n // 2]
    edited = text[:cut] + following[: n // 2]
    total = cut + len(taken)
    if total < K or n < K or len(next_codes) < K:
        edited_at, edited_h = anchors(np.concatenate([codes[:cut], taken]))
    else:
        low = max(0, cut - K + 1)
        joint_at, joint_h = anchors(np.concatenate([codes[low:cut], taken[: K - 1]])) if cut - low + min(len(taken), K - 1) >= K else (at[:0], h[:0])
        first, second = at <= cut - K, next_at <= len(taken) - K
        edited_at = np.concatenate([at[first], joint_at + low, next_at[second] + cut])
        edited_h = np.concatenate([h[first], joint_h, next_h[second]])
    fp, edited_fp, next_fp = smallest(at, h), smallest(edited_at, edited_h), smallest(next_at, next_h)
    digest = hashlib.sha256(edited.encode("utf-8", "replace")).hexdigest()
    return doc_id, n, digest, printed(fp), printed(edited_fp), likeness(fp, edited_fp), likeness(fp, next_fp)


OUT = "doc_id string, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
COLUMNS = [c.split()[0] for c in OUT.split(", ")]


def _told(text: str):
    codes = codes_of(text)
    return codes, *anchors(codes)


def _chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of sorted stretches, each with its follower; the last row of a stretch only follows."""
    before, rows, size = None, [], 0
    for batch in batches:
        for doc_id, text, stretch in zip(batch["doc_id"], batch["text"], batch["stretch"], strict=True):
            own = _told(text)
            if before is not None and before[0] == stretch:
                rows.append(_row(*before[1:], text, own))
                size += len(before[2]) + len(text)
            before = (stretch, doc_id, text, own)
            if size > LOT:
                yield pd.DataFrame(rows, columns=COLUMNS)
                rows, size = [], 0
    if rows:
        yield pd.DataFrame(rows, columns=COLUMNS)


def stretches(ids: DataFrame, n: int) -> list:
    """Bounds that cut the ids into ``n`` stretches of about equal counts: one number per task, not per row."""
    shares = [i / n for i in range(1, n)]
    found = ids.agg(F.percentile_approx("doc_id", shares, max(10_000, 20 * n)).alias("b")).first()["b"] if shares else None
    return sorted(set(found or []))


def fingerprints(docs: DataFrame, partitions: int | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for each row.

    The order is doc_id descending, nulls last, then text. It is cut into stretches by bounds on the id; texts move
    once, to their stretch. A copy of the first text of the next stretch with rows is added to each stretch (after the
    last one: of the very first), so a text always meets its follower. These copies are one row per task.

    Null texts are empty; equal ids follow each other by text; a single row follows itself; an empty table gives an
    empty result; further columns are left out. doc_id must be a number.
    """
    spark = docs.sparkSession
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())
    bounds = np.array(stretches(docs.select("doc_id"), n), np.float64 if docs.schema["doc_id"].dataType.typeName() in ("double", "float") else np.int64)

    @F.pandas_udf("int")
    def stretch_of(doc_id: pd.Series) -> pd.Series:
        known = doc_id.notna()
        at = len(bounds) - np.searchsorted(bounds, doc_id.where(known, 0).to_numpy().astype(bounds.dtype), side="left")
        return pd.Series(np.where(known, at, len(bounds) + 1).astype(np.int32))

    kind = docs.schema["doc_id"].dataType
    rows = docs.select("doc_id", text_of().alias("text"))
    numbers = docs.select("doc_id").withColumn("stretch", stretch_of("doc_id"))
    tops = numbers.groupBy("stretch").agg(F.max("doc_id").alias("top"))  # a row per stretch
    tops = kept(tops.withColumn("to", F.lag("stretch").over(Window.orderBy("stretch"))).withColumn("to", F.coalesce("to", F.max("stretch").over(Window.partitionBy()))))
    heads = rows.join(F.broadcast(tops), rows["doc_id"].eqNullSafe(tops["top"])).groupBy("to").agg(F.min("text").alias("text"))
    heads = heads.select(F.lit(None).cast(kind).alias("doc_id"), "text", F.col("to").alias("stretch"), F.lit(1).alias("last"))
    every = rows.withColumn("stretch", stretch_of("doc_id")).withColumn("last", F.lit(0)).unionByName(heads)
    order = ["stretch", "last", F.col("doc_id").desc_nulls_last(), "text"]
    dealt = every.repartitionByRange(n, "stretch").sortWithinPartitions(*order)
    out = dealt.select(F.col("doc_id").cast("string").alias("doc_id"), "text", "stretch").mapInPandas(_chain, OUT)
    return out.withColumn("doc_id", F.col("doc_id").cast(kind))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))
