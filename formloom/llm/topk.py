"""Exact top-k search by inner product, with a uniform threshold in three phases.

A vector is cut into slices of dimensions. For a query, each slice has a list of local scores, the inner products over
its dimensions; a score is the sum of its local ones. Queries go through in blocks of bounded size, against all rows:

1. Each task keeps, for each query and slice, the best entries of its local list, and sends the whole scores of the
   rows on these lists, at most k + 1 of them, for a chunk of queries in one row. The (k + 1)-th best of all that were
   sent is a safe cutoff: at least k + 1 rows are as good, the query's own among them.
2. The cutoffs, one pair of numbers a query, are broadcast. A row as good as the cutoff has a local score of at least
   the cutoff divided by the number of slices, so only rows with such an entry are collected; of these, rows whose seen
   local scores and that threshold for all others can't reach the cutoff go.
3. What remains is scored exactly, and rows behind the cutoff, ties by the smaller id included, go. Some k + 1 rows a
   query are left to be ranked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from formloom.llm.common import fresh, table
from formloom.llm.jaccard import groups_of
from formloom.session import kept

K, SCALE, EVERY = 10, 1024, 100
SLICES = 4
#: Queries of a block (what is broadcast at a time) and of a row that a task sends.
BLOCK, CHUNK = 8192, 512
#: Vectors that a task scores at a time, and cells of the matrix (vector, query) at that time.
ROWS, CELLS = 4096, 1 << 20
#: Float64 products are exact below, whole-number ones below the second bound; beyond it Python's numbers are used.
EXACT_FLOAT, EXACT_INT = 2**53, 2**62
#: Stands for a missing id, which ranks behind all others.
NO_ID = np.iinfo(np.int64).max
FOUND = "block bigint, query bigint, query_id bigint, vec_id bigint, score bigint, own_score bigint"
LEAST = np.iinfo(np.int64).min + 1  # its negative is a number too


def whole(vector: str | Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component; null for vectors that are null or hold null or non-finite components."""
    vector = F.col(vector) if isinstance(vector, str) else vector
    doubles = F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("double"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == F.lit(float("inf")))
    return F.when(~F.exists(vector, bad), doubles)


def matrix(vectors: list[np.ndarray], width: int = 0) -> np.ndarray:
    """Rows of one width, missing components zero; float64, int64 or Python's numbers, as their size needs."""
    width = max([width, *map(len, vectors)])
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def kind_for(a: np.ndarray, b: np.ndarray) -> type:
    """A number type in which no inner product of a row of ``a`` and one of ``b`` loses a digit."""
    # One more factor for the places that break ties in a block.
    bound = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1]) * ROWS * SLICES
    return np.float64 if bound < EXACT_FLOAT else np.int64 if bound < EXACT_INT else object


def exact(x: np.ndarray, kind: type) -> np.ndarray:
    if kind is object:
        return np.array([[int(v) for v in row] for row in x.tolist()], object).reshape(x.shape)
    return x.astype(kind)


def saturated(x: np.ndarray) -> np.ndarray:
    """As 64-bit numbers; scores beyond them become the ends of their range."""
    if x.dtype == object:
        return np.array([min(max(int(v), LEAST + 1), NO_ID) for v in x.ravel()], np.int64).reshape(x.shape)
    return x.astype(np.int64)


def local_scores(vectors: np.ndarray, queries: np.ndarray) -> list[np.ndarray]:
    """One matrix (vector, query) of local scores for each slice of dimensions."""
    width = max(vectors.shape[1], queries.shape[1])
    vectors, queries = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (vectors, queries))
    kind = kind_for(vectors, queries)
    vectors, queries = exact(vectors, kind), exact(queries, kind)
    cuts = [width * i // SLICES for i in range(SLICES + 1)]
    return [vectors[:, a:b] @ queries[:, a:b].T if b > a else np.zeros((len(vectors), len(queries)), kind) for a, b in zip(cuts, cuts[1:], strict=False)]


def best_rows(scores: np.ndarray, n: int) -> np.ndarray:
    """Places of the ``n`` highest scores of each column, ties to the smaller place."""
    if len(scores) <= n:
        return np.repeat(np.arange(len(scores))[:, None], scores.shape[1], axis=1)
    keys = scores * len(scores) - np.arange(len(scores))[:, None]
    return np.argpartition(-keys, n - 1, axis=0)[:n] if scores.dtype != object else np.argsort(-keys, axis=0)[:n]


def merged(scores: np.ndarray, ids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``n`` best entries of each row, by score, ties to the smaller id; places without an entry have LEAST."""
    order = np.lexsort((ids, -scores), axis=1)[:, :n]
    return np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)


class Queries:
    """A block of queries: ids (NO_ID for none) and vectors as they come from one packed row."""

    def __init__(self, ids: bytes, vectors: bytes, width: int):
        self.ids = np.frombuffer(ids, np.int64)
        self.vectors = np.frombuffer(vectors, np.float64).reshape(len(self.ids), width)
        self.step = min(ROWS, max(1, CELLS // max(1, len(self.ids))))

    def own_scores(self) -> np.ndarray:
        own = exact(self.vectors, kind_for(self.vectors, self.vectors))
        return saturated((own * own).sum(axis=1)) if own.shape[1] else np.zeros(len(own), np.int64)


def blocks_of(batches: Iterator[pa.RecordBatch], step: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors) in order of ids, ``step`` rows at a time; batches have vec_id and vector, no null vectors."""
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            ids = part.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False)
            lists = part.column(1)
            flat, offsets = lists.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
            sizes = np.diff(offsets)
            width = int(sizes.max(initial=0))
            vectors = flat.reshape(len(ids), width) if (sizes == width).all() else matrix([flat[a:b] for a, b in zip(offsets, offsets[1:], strict=False)])
            order = np.argsort(ids, kind="stable")
            yield ids[order], vectors[order]


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Queries in rows of at most ``BLOCK``."""
    def row(ids: list[np.ndarray], vectors: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        every = matrix([v for part in vectors for v in part])
        for at in range(0, len(every), BLOCK):
            some = np.concatenate(ids)[at : at + BLOCK]
            values = [pa.array([some.tobytes()], pa.binary()), pa.array([every[at : at + BLOCK].tobytes()], pa.binary()), pa.array([every.shape[1]], pa.int64())]
            yield pa.RecordBatch.from_arrays(values, ["ids", "vectors", "width"])

    ids, vectors = [], []
    for some, own in blocks_of(batches, ROWS):
        ids.append(some)
        vectors.append(own)
        if sum(map(len, ids)) >= BLOCK:
            yield from row(ids, vectors)
            ids, vectors = [], []
    if ids:
        yield from row(ids, vectors)


def _lists(queries: Broadcast, n: int):
    """First phase: for each chunk of queries one row with the best whole scores among the rows on local lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Queries(*queries.value)
        m = len(block.ids)
        scores, owners = np.full((m, n), LEAST, np.int64), np.full((m, n), NO_ID, np.int64)
        for ids, vectors in blocks_of(batches, block.step):
            local = local_scores(vectors, block.vectors)
            listed = np.zeros(local[0].shape, bool)
            for own in local:
                np.put_along_axis(listed, best_rows(own, n), True, axis=0)
            row, query = np.nonzero(listed)
            totals = saturated(sum(own[row, query] for own in local))
            order = np.lexsort((row, -totals, query))  # rows come in order of ids
            row, query, totals = row[order], query[order], totals[order]
            first = np.searchsorted(query, np.arange(m))
            place = np.arange(len(query)) - first[query]
            use = place < n
            new, new_ids = np.full((m, n), LEAST, np.int64), np.full((m, n), NO_ID, np.int64)
            new[query[use], place[use]], new_ids[query[use], place[use]] = totals[use], ids[row[use]]
            scores, owners = merged(np.hstack([scores, new]), np.hstack([owners, new_ids]), n)
        chunks = range(0, m, CHUNK)
        columns = [pa.array([i // CHUNK for i in chunks], pa.int64())]
        columns += [pa.array([x[i : i + CHUNK].tobytes() for i in chunks], pa.binary()) for x in (scores, owners)]
        yield pa.RecordBatch.from_arrays(columns, ["chunk", "scores", "owners"])

    return run


def _cutoffs(n: int):
    """The lists of all tasks merged, one row of them at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in groups_of(batches, "chunk"):
            scores = owners = None
            for s, o in zip(df["scores"], df["owners"], strict=True):
                s, o = (np.frombuffer(x, np.int64).reshape(-1, n) for x in (s, o))
                scores, owners = (s, o) if scores is None else merged(np.hstack([scores, s]), np.hstack([owners, o]), n)
            yield pd.DataFrame({"chunk": [df["chunk"].iloc[0]], "scores": [scores[:, -1].tobytes()], "owners": [owners[:, -1].tobytes()]})

    return run


def _collected(queries: Broadcast, cutoffs: Broadcast, n: int, number: int):
    """Second and third phase: rows at least as good as the cutoff, at most ``n`` of a task for a query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, (cut, cut_id) = Queries(*queries.value), (np.frombuffer(x, np.int64) for x in cutoffs.value)
        m = len(block.ids)
        open_ = cut == LEAST  # fewer rows than wanted: all of them are collected
        held: list[tuple[np.ndarray, ...]] = []
        for ids, vectors in blocks_of(batches, block.step):
            local = local_scores(vectors, block.vectors)
            # Whole numbers of 64 bits stay far below 2**58 here, and four times that is one yet.
            level = np.clip(cut, -(2**58), 2**58) if local[0].dtype == np.int64 else cut.astype(local[0].dtype)
            bound, any_seen = 0, open_[None, :]
            for own in local:
                seen = own * SLICES >= level[None, :]
                any_seen = any_seen | seen
                bound = bound + np.where(seen, own * SLICES, level[None, :])
            row, query = np.nonzero(any_seen & ((bound >= level[None, :] * SLICES) | open_[None, :]))
            totals = saturated(sum(own[row, query] for own in local))
            good = (totals > cut[query]) | ((totals == cut[query]) & (ids[row] <= cut_id[query])) | open_[query]
            held.append((query[good], totals[good], ids[row[good]]))
            if sum(len(h[0]) for h in held) > 4 * n * m:
                held = [best_of(held, n)]
        query, totals, ids = best_of(held, n)
        own = block.own_scores()
        for at in range(0, len(query), 1 << 16):
            q, i = query[at : at + (1 << 16)], ids[at : at + (1 << 16)]
            named = [pa.array(x, pa.int64(), mask=x == NO_ID) for x in (block.ids[q], i)]
            columns = [pa.array(np.full(len(q), number)), pa.array(q), *named, pa.array(totals[at : at + (1 << 16)]), pa.array(own[q])]
            yield pa.RecordBatch.from_arrays(columns, ["block", "query", "query_id", "vec_id", "score", "own_score"])

    return run


def best_of(held: list[tuple[np.ndarray, ...]], n: int) -> list[np.ndarray]:
    query, totals, ids = (np.concatenate([np.zeros(0, np.int64), *[h[i] for h in held]]) for i in range(3))
    order = np.lexsort((ids, -totals, query))
    query, totals, ids = query[order], totals[order], ids[order]
    use = np.arange(len(query)) - np.searchsorted(query, query) < n
    return [query[use], totals[use], ids[use]]


def nearest(rows: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of ``queries`` the ``k`` rows of ``rows`` with the highest inner
    products, itself left out; ties go to the smaller id. Both have vec_id and vector (whole doubles, see ``whole``),
    and ``queries`` are rows of ``rows``; further columns are left out.

    Null vectors take no part. A vector shorter than another counts as if zeros followed; an empty one scores 0. Each
    row is a candidate of its own, so rows with one id can all be found, and a query finds copies of itself; queries
    that repeat get their ranks each. Null ids come after all others. Scores beyond a long become its ends. Fewer rows
    than ``k`` are all returned; an empty table gives an empty result.
    """
    spark, n = rows.sparkSession, k + 1
    rows, asked = (df.filter(F.col("vector").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), "vector") for df in (rows, queries))
    asked = kept(asked)
    parts = max(1, -(-asked.count() // BLOCK))
    packed = kept(asked.repartition(parts).mapInArrow(_packed, "ids binary, vectors binary, width bigint"))
    found = []
    # One block at a time is on the driver, whatever the number of queries.
    for number, block in enumerate(packed.toLocalIterator()):
        sent = spark.sparkContext.broadcast((bytes(block.ids), bytes(block.vectors), block.width))
        lists = rows.mapInArrow(_lists(sent, n), "chunk bigint, scores binary, owners binary")
        lists = lists.repartition("chunk").sortWithinPartitions("chunk").mapInPandas(_cutoffs(n), "chunk bigint, scores binary, owners binary")
        cut = sorted(lists.collect(), key=lambda r: r.chunk)  # two numbers a query of the block
        limits = spark.sparkContext.broadcast(tuple(b"".join(bytes(r[c]) for r in cut) for c in ("scores", "owners")))
        best = rows.mapInArrow(_collected(sent, limits, n, number), FOUND)
        found.append(kept(best))
    if not found:
        return ranked(spark.createDataFrame([], FOUND), k)
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return ranked(every, k)


def ranked(every: DataFrame, k: int) -> DataFrame:
    """The first ``k`` of each query without one entry of its own; a query has some ``k`` rows from each task at most."""
    own = F.col("vec_id").eqNullSafe(F.col("query_id")) & (F.col("score") == F.col("own_score"))
    each = Window.partitionBy("block", "query")
    placed = every.withColumn("place", F.row_number().over(each.orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))))
    placed = placed.withColumn("own_place", F.min(F.when(own, F.col("place"))).over(each))
    others = placed.filter(~F.col("place").eqNullSafe(F.col("own_place")))
    rank = F.col("place") - F.when(F.col("place") > F.col("own_place"), 1).otherwise(0)
    return others.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def prepared(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """vec_id and vector for ``nearest``."""
    (name,) = fresh(vectors, "vector_")
    return vectors.withColumn(name, whole(column)).select("vec_id", F.col(name).alias("vector"))


def op12_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = prepared(table(spark, sf_dir, "embeddings"))
    return nearest(rows, rows.filter(F.col("vec_id") % EVERY == 0))


SQL = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS ints
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, v.vec_id,
         CAST(list_sum(list_transform(list_zip(q.ints, v.ints), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v AS q, v
  WHERE q.vec_id % {EVERY} = 0 AND v.vec_id <> q.vec_id
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= {K}
"""
