"""Similarity join on word shingles with Bayesian candidate pruning.

1. Every text becomes its set of five-word shingles, a MinHash signature and band keys. Texts with one set are one node.
2. Nodes that share a band key are tied to the smallest node of that bucket: as many rows as members, never pairs.
   The tie is tested on the signatures: values are compared a few at a time, and the tie is dropped once the posterior
   probability that the similarity reaches the threshold falls below a tolerance. In a bucket where a tie was
   dropped, the other pairs of that node are tested too, so no pair is lost for the choice of the smallest node.
3. Ties make candidate clusters. Within a cluster all pairs are tested in the same way, and those that remain are
   verified by the exact size of the intersection. Large clusters are cut into blocks; a task gets two blocks. A task
   returns a row per node: its number of links and one node that it is linked to through others.
4. Those rows make the classes.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import cache
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formloom.llm.common import WORD, fresh, table, text_of
from formloom.llm.components import components
from formloom.session import kept

SHINGLE = 5
THRESHOLD = (4, 5)  # 0.8 as a fraction
BANDS, ROWS = 40, 6
HASHES = BANDS * ROWS
#: Hashes compared at a time, and the probability below which a pair is dropped.
STEP, TOLERANCE = 40, 1e-7
#: Nodes in a block of a cluster, and shingles of its nodes together; members up to which a bucket with a dropped tie is
#: looked through.
BLOCK, BLOCK_RUNS, BUCKET = 1024, 4_000_000, 20_000
#: Pairs of signatures held side by side.
PAIRS = 1 << 14
_rng = np.random.default_rng(20240607)
_MULTIPLY = (_rng.integers(0, 2**32, HASHES, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_XOR = _rng.integers(0, 2**32, HASHES, dtype=np.uint64).astype(np.uint32)
_BAND = _rng.integers(0, 2**63, ROWS, dtype=np.int64).astype(np.uint64) | np.uint64(1)
_POWERS = [pow(0x9E3779B97F4A7C15, j, 2**64) for j in range(SHINGLE)]


class Hashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def shingles(words: list[str], hashes: Hashes) -> np.ndarray:
    """Sorted hashes of the different runs of five words; fewer words are one run, none are no run."""
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    size = min(SHINGLE, len(h))
    out = np.zeros(len(h) - size + 1, np.uint64)
    for j in range(size):
        out += h[j : len(h) - size + 1 + j] * np.uint64(_POWERS[j])
    return np.unique(_mixed(out + np.uint64(size)))


def signature(runs: np.ndarray) -> np.ndarray:
    """MinHash values of a set that isn't empty."""
    low = (runs >> np.uint64(32)).astype(np.uint32)
    least = np.full(HASHES, 2**32 - 1, np.uint32)
    for a in range(0, len(low), 256):
        np.minimum(least, ((low[a : a + 256, None] ^ _XOR) * _MULTIPLY).min(axis=0), out=least)
    return least


def bands(values: np.ndarray) -> np.ndarray:
    wide = values.astype(np.uint64).reshape(BANDS, ROWS)
    return _mixed((wide * _BAND).sum(axis=1, dtype=np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)).view(np.int64)


@cache
def needed(compared: int) -> int:
    """Least number of agreeing values among ``compared`` with which a pair stays.

    With a uniform prior the posterior of the similarity is Beta(m + 1, n - m + 1), and the chance that it is at least
    t equals the chance that n + 1 draws of probability t have at most m hits.
    """
    t, total = THRESHOLD[0] / THRESHOLD[1], 0.0
    for m in range(compared + 1):
        total += comb(compared + 1, m) * t**m * (1 - t) ** (compared + 1 - m)
        if total >= TOLERANCE:
            return m
    return compared


def stay(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the aligned pairs of signatures aren't dropped; all values of a pair are seen only if it stays."""
    live, agreed = np.arange(len(a)), np.zeros(len(a), np.int32)
    for k in range(0, HASHES, STEP):
        agreed += (a[live, k : k + STEP] == b[live, k : k + STEP]).sum(axis=1, dtype=np.int32)
        on = agreed >= needed(k + STEP)
        live, agreed = live[on], agreed[on]
    out = np.zeros(len(a), bool)
    out[live] = True
    return out


def crossed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """As stay(), for all rows of ``a`` against all of ``b``: a matrix."""
    agreed = np.zeros((len(a), len(b)), np.uint8)
    for k in range(STEP):
        agreed += a[:, k, None] == b[None, :, k]
    i, j = np.nonzero(agreed >= needed(STEP))
    out = np.zeros(agreed.shape, bool)
    for s in range(0, len(i), PAIRS):
        on = stay(a[i[s : s + PAIRS]], b[j[s : s + PAIRS]])
        out[i[s : s + PAIRS][on], j[s : s + PAIRS][on]] = True
    return out


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes, word = Hashes(), re.compile(WORD)
    for batch in batches:
        sets, signs, keys, sizes = [], [], [], []
        for text in batch.column(2).to_pylist():
            runs = shingles(word.findall(text), hashes)
            sizes.append(len(runs))
            if len(runs):
                values = signature(runs)
                sets.append(xxhash.xxh128_digest(runs.tobytes()))
                signs.append(values.astype(np.uint16).tobytes())
                keys.append(bands(values))
            else:
                sets.append(None)
                signs.append(None)
                keys.append(None)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(sets, pa.binary()), pa.array(signs, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(sizes, pa.int64())],
            ["doc_id", "text_hash", "node", "sign", "bands", "n_runs"],
        )


def _tested(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for df in batches:
        a, b = (np.frombuffer(b"".join(df[c]), np.uint16).reshape(-1, HASHES) for c in ("sign_a", "sign_b"))
        yield pd.DataFrame({"node": df["node"], "head": df["head"], "stays": stay(a, b)})


def groups_of(batches: Iterator[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    """Whole groups of rows that come sorted by ``key``; one group is held at a time."""
    open_rows: list[pd.DataFrame] = []
    for df in batches:
        if not len(df):
            continue
        keys = df[key].to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        for a, b in zip(starts, [*starts[1:], len(df)], strict=True):
            if open_rows and open_rows[0][key].iloc[0] != keys[a]:
                yield pd.concat(open_rows) if len(open_rows) > 1 else open_rows[0]
                open_rows = []
            open_rows.append(df.iloc[a:b])
    if open_rows:
        yield pd.concat(open_rows) if len(open_rows) > 1 else open_rows[0]


def _untangled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A forest of the pairs that stay within each bucket: one tie for each node but the first of its component.

    Components grow node by node; a node is held against those only that no component has reached yet, so each pair is
    tested once at most, and in a bucket of copies nearly all are reached from the first.
    """
    for df in groups_of(batches, "key"):
        nodes, signs = list(df["node"]), np.frombuffer(b"".join(df["sign"]), np.uint16).reshape(-1, HASHES)
        left = np.array(sorted(range(len(nodes)), key=nodes.__getitem__))
        ties = []
        while len(left):
            grown, left = [int(left[0])], left[1:]
            while grown and len(left):
                at = grown.pop()
                on = stay(np.broadcast_to(signs[at], (len(left), HASHES)), signs[left])
                reached, left = left[on].tolist(), left[~on]
                ties += [(nodes[i], nodes[at]) for i in reached]
                grown += reached
        yield pd.DataFrame(ties, columns=["node", "head"])


def _roots(links: np.ndarray) -> np.ndarray:
    """Smallest index of the component of each row of a symmetric matrix, the diagonal being true."""
    root = links.argmax(axis=1)
    while True:
        least = np.array([root[row].min() for row in links])
        least = np.minimum(least, least[least])
        if (least == root).all():
            return root
        root = least


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs, by products of membership matrices over some shingles at a time."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(flat := np.concatenate(sets), kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.concatenate([[True], flat[1:] != flat[:-1]])
    column = np.cumsum(new) - 1
    shared = np.bincount(column)[column] > 1
    owner, column = owner[shared], column[shared]
    _, column = np.unique(column, return_inverse=True)
    out = np.zeros((len(sets), len(sets)), np.float32)
    width = max(64, 2_000_000 // len(sets))
    for a in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        lo, hi = np.searchsorted(column, [a, a + width])
        member = np.zeros((len(sets), width), np.float32)
        member[owner[lo:hi], column[lo:hi] - a] = 1
        out += member @ member.T
    return out


def _verified(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row per node of each pair of blocks: copies behind its links, and a node of the same class.

    Sums of float32 are whole numbers below 2**24, so they are exact for sets of up to 16 million shingles.
    """
    for df in groups_of(batches, "pair"):
        first = (df["block"] == df["low"]).to_numpy()
        sets = [np.frombuffer(b, np.uint64) for b in df["runs"]]
        signs = np.array([signature(s) for s in sets])
        two = not first.all()
        rows, columns = (np.flatnonzero(first), np.flatnonzero(~first)) if two else (np.arange(len(sets)),) * 2
        on = np.zeros((len(sets), len(sets)), bool)
        on[np.ix_(rows, columns)] = crossed(signs[rows], signs[columns])
        on |= on.T
        common = intersections(sets).astype(np.int64)
        size = np.array([len(s) for s in sets])
        up, down = THRESHOLD
        on &= common * down >= up * (size[:, None] + size[None, :] - common)
        np.fill_diagonal(on, False)
        links = on @ df["copies"].to_numpy(np.int64)
        np.fill_diagonal(on, True)
        nodes = df["node"].to_numpy()
        yield pd.DataFrame({"node": nodes, "links": links, "head": nodes[_roots(on)]})


def _with_runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Texts replaced by their shingles; a text whose set isn't that of its node only shares a hash with it and goes."""
    hashes, word = Hashes(), re.compile(WORD)
    for df in batches:
        runs = [shingles(word.findall(t), hashes).tobytes() for t in df["text"]]
        right = [xxhash.xxh128_digest(r) == n for r, n in zip(runs, df["node"], strict=True)]
        yield df.drop(columns="text").assign(runs=runs)[right]


def _sorted_map(df: DataFrame, key: str, run: Callable, schema: str) -> DataFrame:
    return df.repartition(key).sortWithinPartitions(key).mapInPandas(run, schema)


def ties(nodes: DataFrame) -> DataFrame:
    """(a, b): as many rows as needed to connect all nodes whose pairs aren't dropped; ``nodes`` has node, sign, bands."""
    members = nodes.select("node", F.explode("bands").alias("key"))
    buckets = members.groupBy("key").agg(F.min("node").alias("head"), F.count("*").alias("size")).filter("size > 1")
    tied = kept(members.join(buckets, "key"))
    pairs = tied.filter(F.col("node") != F.col("head")).select("node", "head").distinct()
    signed = pairs.join(nodes.select("node", F.col("sign").alias("sign_a")), "node")
    signed = signed.join(nodes.select(F.col("node").alias("head"), F.col("sign").alias("sign_b")), "head")
    tested = kept(signed.mapInPandas(_tested, "node binary, head binary, stays boolean"))
    dropped = tested.filter(~F.col("stays")).select("node", "head")
    mixed = tied.join(dropped, ["node", "head"], "left_semi").filter("size > 2").select("key", "size").distinct()
    again = tied.join(mixed.filter(F.col("size") <= BUCKET).select("key"), "key", "left_semi")
    found = _sorted_map(again.select("key", "node").join(nodes.select("node", "sign"), "node"), "key", _untangled, "node binary, head binary")
    # Larger buckets aren't looked through: their dropped ties stay candidates, which loses nothing.
    large = tied.join(mixed.filter(F.col("size") > BUCKET).select("key"), "key", "left_semi").select("node", "head")
    every = tested.filter("stays").select("node", "head").unionByName(found).unionByName(large)
    return every.select(F.col("node").alias("a"), F.col("head").alias("b"))


def joined(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (the smallest id of the class) and n_links for each row of ``docs``; also text_hash
    and class_node, a key of the class that is null for texts without words. Further columns are left out.

    Links of a row are the other rows whose similarity to it is 0.8 or more, copies included; classes are what links
    connect. Null texts and texts without words have no links and are classes of their own (their own id). Texts of
    one to four words are one shingle. Equal rows are copies of each other. Null ids count as rows; a class of null
    ids only has a null id. An empty table gives an empty result.
    """
    slim = docs.select("doc_id", F.xxhash64(text_of()).alias("text_hash"), text_of().alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    signed = kept(slim.mapInArrow(_signed, f"doc_id {kind}, text_hash bigint, node binary, sign binary, bands array<bigint>, n_runs bigint"))
    nodes = kept(signed.filter(F.col("node").isNotNull()).groupBy("node").agg(
        F.count("*").alias("copies"), F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "text_hash")).alias("held"),
        F.first("sign").alias("sign"), F.first("bands").alias("bands"), F.first("n_runs").alias("n_runs"),
    ))
    clusters = kept(components(ties(nodes)))
    members = clusters.join(nodes.select("node", "copies", "held", "n_runs"), "node")
    sizes = members.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n_runs") / BLOCK_RUNS)).alias("blocks"))
    inside = members.join(sizes, "root").select("node", "root", "blocks", "copies", F.col("held.doc_id").alias("held_id"), F.col("held.text_hash").alias("held_hash"))
    # One row of each text is read again; copies of it have other ids and stay where they are.
    same = (F.col("text_hash") == F.col("held_hash")) & F.col("doc_id").eqNullSafe(F.col("held_id"))
    texts = slim.join(inside, same).select("text_hash", "text", *inside.columns[:4]).dropDuplicates(["node", "text_hash"])
    texts = texts.mapInPandas(_with_runs, "text_hash bigint, node binary, root binary, blocks bigint, copies bigint, runs binary")
    blocks = F.col("blocks")
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    dealt = texts.withColumn("block", own).withColumn("other", F.explode(F.sequence(F.lit(0), (blocks - 1).cast("int"))))
    low, high = F.least("block", "other"), F.greatest("block", "other")
    dealt = dealt.withColumn("low", low).withColumn("pair", F.concat_ws("/", F.hex("root"), low, high))
    dealt = dealt.select("pair", "low", "block", "node", "copies", "runs")
    found = kept(_sorted_map(dealt, "pair", _verified, "node binary, links bigint, head binary"))
    classes = components(found.filter(F.col("node") != F.col("head")).select(F.col("node").alias("a"), F.col("head").alias("b")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    full = nodes.select("node", "copies", "least").join(classes, "node", "left").join(links, "node", "left")
    full = full.withColumn("root", F.coalesce("root", "node"))
    ids = full.groupBy("root").agg(F.min("least").alias("class_id"))
    told = full.join(ids, "root").select("node", "root", "class_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    return signed.select("doc_id", "text_hash", "node").join(told, "node", "left").select(
        "doc_id", "text_hash", F.col("root").alias("class_node"),
        F.coalesce("class_id", F.when(F.col("node").isNull(), F.col("doc_id"))).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "class_id", "n_links")


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each class, the one with the smallest id; texts without words all stay.

    Rows of one id and text are copies, so one of them stays. Null ids come after all others of their class.
    """
    hash_name, id_name, own_name = fresh(docs, "text_hash_", "id_", "own_")
    best = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col("text_hash").alias("text_hash"))
    chosen = joined(docs).filter(F.col("class_node").isNotNull()).groupBy("class_node").agg(F.min(best).alias("best"))
    chosen = chosen.select(F.col("best.doc_id").alias(id_name), F.col("best.text_hash").alias(hash_name))
    worded = text_of(docs["text"]).rlike(r"[^\x20\x09-\x0D]")
    keyed = docs.filter(worded).withColumn(own_name, F.xxhash64(text_of(docs["text"])))
    on = (F.col(own_name) == F.col(hash_name)) & F.col("doc_id").eqNullSafe(F.col(id_name))
    left = keyed.join(chosen, on, "left_semi").dropDuplicates(["doc_id", own_name])
    return left.select(*docs.columns).unionByName(docs.filter(~worded))
