"""Importance resampling of documents towards a target distribution, on hashed features.

Features are runs of one word up to ``longest`` words, hashed by CRC-32 into buckets. How much commoner a bucket is in
the target than in the corpus is its gain; a document's weight is the mean gain of its features. Gumbel noise drawn from
the id turns weights into a sample without replacement: the highest scores are drawn.

The vocabulary has a head and a tail. One pass over the corpus finds the most frequent words and pairs of words; the CRC
state after each such word, and the bucket of each such pair, are broadcast. A checksum goes on from the state of the
word before, so a pair outside the head costs its second word only, and a word outside the head takes the direct
checksum. Head and tail give the same buckets, so totals are exact whatever the head holds.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from formloom.llm.common import fresh, table
from formloom.operators.ordinals import running_total
from formloom.session import kept

BUCKETS, LONGEST, LEAST_WORDS, PERCENT, SEED = 10_000, 1, 20, 10, 2024
#: Words and pairs of the head, the bytes of a word in it, and counts that a task holds before it sends them.
HEAD, HEAD_BYTES, HELD = 50_000, 40, 400_000
#: Levels of counts to a doubling.
LEVELS = 16
ADDED = ("n_features", "weight", "score", "rank")
#: Bytes of words: digits, letters of ASCII in lower case and everything beyond ASCII; all others become spaces.
TO_WORDS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(TO_WORDS).split() if text else []


class States(dict):
    """CRC states after the words of the head; others are computed and not kept."""

    def __missing__(self, word: bytes) -> int:
        return crc32(word)


class Features:
    """Buckets of the features of a text; the head makes it faster and never changes them."""

    def __init__(self, states: dict[bytes, int], pairs: dict[tuple[bytes, bytes], int], longest: int, buckets: int):
        self.states, self.pairs, self.longest, self.buckets = States(states), pairs, longest, buckets

    def of(self, words: list[bytes]) -> np.ndarray:
        state = list(map(self.states.__getitem__, words))
        found = [np.array(state, np.int64) % self.buckets]
        for length in range(2, self.longest + 1):
            if length == 2:
                own = []
                for i, pair in enumerate(zip(words, words[1:], strict=False)):
                    bucket = self.pairs.get(pair)
                    own.append(crc32(b" " + pair[1], state[i]) % self.buckets if bucket is None else bucket)
                found.append(np.array(own, np.int64))
                if self.longest > 2:
                    state = [crc32(b" " + w, s) for w, s in zip(words[1:], state, strict=False)]
            else:
                state = [crc32(b" " + w, s) for w, s in zip(words[length - 1 :], state, strict=False)]
                found.append(np.array(state, np.int64) % self.buckets)
        return np.concatenate(found)


def _frequent(longest: int):
    """(word, follower, n): counts of words, and of pairs if features have pairs, in parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, pairs = Counter(), Counter()

        def sent() -> Iterator[pa.RecordBatch]:
            rows = [*((w, None, n) for w, n in words.items() if len(w) <= HEAD_BYTES)]
            rows += [(a, b, n) for (a, b), n in pairs.items() if len(a) <= HEAD_BYTES and len(b) <= HEAD_BYTES]
            kinds = (pa.binary(), pa.binary(), pa.int64())
            for at in range(0, len(rows), 1 << 16):
                part = list(zip(*rows[at : at + (1 << 16)], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(part, kinds, strict=True)], ["word", "follower", "n"])
            words.clear()
            pairs.clear()

        for batch in batches:
            for text in batch.column(0).to_pylist():
                own = words_of(text)
                words.update(own)
                if longest > 1:
                    pairs.update(zip(own, own[1:], strict=False))
                if len(words) + len(pairs) >= HELD:
                    yield from sent()
        yield from sent()

    return run


def head_of(texts: DataFrame, longest: int, buckets: int) -> tuple[dict[bytes, int], dict[tuple[bytes, bytes], int]]:
    """States of the most frequent words and buckets of the most frequent pairs: at most ``HEAD`` of each, of bounded length.

    Words are taken by levels of their count, the highest first, as long as a whole level has room; so no more than the
    head itself comes to the driver.
    """
    counted = texts.mapInArrow(_frequent(longest), "word binary, follower binary, n bigint").groupBy("word", "follower").agg(F.sum("n").alias("n"))
    counted = kept(counted.withColumn("level", F.floor(F.log2("n") * LEVELS)))
    chosen = []
    for pair in (False, True)[:longest]:
        own = counted.filter(F.col("follower").isNotNull() == pair)
        least, room = None, HEAD
        for level, n in sorted(map(tuple, own.groupBy("level").count().collect()), reverse=True):  # some hundred rows
            room -= n
            if room < 0:
                break
            least = level
        chosen.append(own.filter(F.col("level") >= least).select("word", "follower").collect() if least is not None else [])
    states = {bytes(r.word): crc32(bytes(r.word)) for r in chosen[0]}
    pairs = chosen[1] if longest > 1 else []
    return states, {(bytes(r.word), bytes(r.follower)): crc32(bytes(r.word) + b" " + bytes(r.follower)) % buckets for r in pairs}


def _totals(features: Broadcast):
    """One row a task: features in each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Features(*features.value)
        total = np.zeros(own.buckets, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                total += np.bincount(own.of(words_of(text)), minlength=own.buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["bucket", "n"])

    return run


def totals(texts: DataFrame, features: Broadcast) -> DataFrame:
    """(bucket, n) of all texts."""
    return texts.mapInArrow(_totals(features), "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """floor(1000 * ln of the smoothed ratio) for each bucket; one row a bucket comes to the driver."""
    s, t = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
    for counts, df in ((s, source), (t, target)):
        for r in df.collect():
            counts[r.bucket] = r.n
    up = (t + 1).astype(float) * float(int(s.sum()) + buckets)
    down = (s + 1).astype(float) * float(int(t.sum()) + buckets)
    return np.floor(1000 * np.log(up / down)).astype(np.int64)


def _weighed(features: Broadcast, gain: Broadcast, k: int):
    """The text is the last of ``k + 1`` columns; n_words, n_features and weight take its place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, value = Features(*features.value), gain.value
        for batch in batches:
            rows = []
            for text in batch.column(k).to_pylist():
                words = words_of(text)
                found = own.of(words)
                rows.append((len(words), len(found), int(value[found].sum()) // len(found) if len(found) else 0))
            columns = [pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else ([], [], []))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:k], *columns], [f"c{i}" for i in range(k + 3)])

    return run


def noise(doc_id: str | Column, seed: int = SEED) -> Column:
    """floor of 1000 times a Gumbel draw that depends on the id only; a null id is an empty one."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))


def drawn(scored: DataFrame, score: str, doc_id: str, eligible: Column, percent: int, out: str) -> DataFrame:
    """``scored`` with ``out``: places of the highest scores among eligible rows, null for rows that aren't drawn.

    Counts by score, a table as small as the range of scores, give the least score that is drawn. Only rows at or above
    it are placed, by running totals over ranges of (score, id); equal rows share a range whose size is not bounded by
    the task, so they are told apart by a number first.
    """
    fine = scored.filter(eligible)
    n = fine.count() * percent // 100
    if not n:
        return scored.withColumn(out, F.lit(None).cast("long"))
    by_score = fine.groupBy(score).agg(F.count("*").alias("n_"))
    above = running_total(by_score.withColumn("down_", -F.col(score)), ["down_"], "n_", "upto_")
    cut = above.filter(F.col("upto_") >= n).agg(F.max(score)).first()[0]
    candidate = eligible & (F.col(score) >= cut)
    marked = scored.withColumn("row_", F.monotonically_increasing_id()).withColumn("down_", -F.col(score)).withColumn("no_id_", F.col(doc_id).isNull())
    above = marked.filter(candidate).withColumn("one_", F.lit(1).cast("long"))
    placed = running_total(above, ["down_", "no_id_", doc_id, "row_"], "one_", out)
    placed = placed.withColumn(out, F.when(F.col(out) <= n, F.col(out)))
    rest = marked.filter(~F.coalesce(candidate, F.lit(False))).withColumn(out, F.lit(None).cast("long"))
    columns = [*scored.columns, out]
    return placed.select(*columns).unionByName(rest.select(*columns))


def resampled(
    docs: DataFrame, target: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED
) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` without text, with n_features, weight, score and rank (null for rows that aren't drawn); also their names.

    ``target`` has a column text. Texts without words have no features and weight 0; null texts have none. Rows with
    fewer than ``least_words`` words are never drawn. Ties go to the smaller id, null ids last; rows of one id share
    their noise, and rows that are equal take their places in any order. Without any features all gains are 0. An
    empty table gives an empty result; columns with the added names keep theirs.
    """
    spark = docs.sparkSession
    wanted = dict(zip(ADDED, fresh(docs, *ADDED), strict=True))
    others = [c for c in docs.columns if c != "text"]
    k, at = len(others), others.index("doc_id")
    binary = lambda df: df.select(F.col("text").cast("string").cast("binary").alias("text"))
    corpus, aim = binary(docs), binary(target)
    states, pairs = head_of(corpus, longest, buckets)
    features = spark.sparkContext.broadcast((states, pairs, longest, buckets))
    gain = spark.sparkContext.broadcast(gains(totals(corpus, features), totals(aim, features), buckets))
    plain = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(others)], F.col("text").cast("string").cast("binary").alias("text"))
    fields = [f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(plain.schema.fields[:-1])]
    schema = ", ".join([*fields, *[f"c{k + i} bigint" for i in range(3)]])
    weighed = plain.mapInArrow(_weighed(features, gain, k), schema)
    scored = kept(weighed.withColumn("score_", F.col(f"c{k + 2}") + noise(f"c{at}", seed)))
    ranked = drawn(scored, "score_", f"c{at}", F.col(f"c{k}") >= least_words, percent, "rank_")
    added = [f"c{k + 1}", f"c{k + 2}", "score_", "rank_"]
    return ranked.select(
        *[F.col(f"c{i}").alias(c) for i, c in enumerate(others)], *[F.col(c).cast("long").alias(n) for c, n in zip(added, wanted.values(), strict=True)]
    ), wanted


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return resampled(docs, table(spark, sf_dir, "benchmark"))[0]


#: Checksums by the usual table of 256 entries, which the query makes itself from the polynomial.
SQL = f"""
WITH steps AS (
  SELECT list(x ORDER BY i) AS entries FROM (
    SELECT i, list_reduce(list_prepend(CAST(i AS BIGINT), CAST(range(8) AS BIGINT[])),
                          lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS x
    FROM range(256) AS r(i))
), words AS (
  SELECT 'd' AS side, doc_id AS id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS word FROM documents
  UNION ALL
  SELECT 'b', item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) FROM benchmark
), spelled AS (
  SELECT word, list_transform(range(CAST(length(hex(encode(word))) / 2 AS BIGINT)),
                              lambda i: CAST('0x' || substr(hex(encode(word)), 2 * i + 1, 2) AS BIGINT)) AS bytes
  FROM (SELECT DISTINCT word FROM words)
), hashed AS (
  SELECT word, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), bytes),
                   lambda c, b: xor(c >> 8, entries[(xor(c, b) & 255) + 1])), 4294967295) % {BUCKETS} AS bucket
  FROM spelled, steps
), counted AS (
  SELECT bucket, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 'b') AS t FROM words JOIN hashed USING (word) GROUP BY bucket
), gain AS (
  SELECT bucket, floor(1000 * ln((CAST(t + 1 AS DOUBLE) * CAST((SELECT sum(s) FROM counted) + {BUCKETS} AS DOUBLE))
                               / (CAST(s + 1 AS DOUBLE) * CAST((SELECT sum(t) FROM counted) + {BUCKETS} AS DOUBLE)))) AS g FROM counted
), weighed AS (
  SELECT id, count(*) AS n, CAST(floor(sum(g) / count(*)) AS BIGINT) AS weight
  FROM words JOIN hashed USING (word) JOIN gain USING (bucket) WHERE side = 'd' GROUP BY id
), scored AS (
  SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('{SEED}:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM documents LEFT JOIN weighed ON id = doc_id
), placed AS (
  SELECT *, row_number() OVER (ORDER BY n_features < {LEAST_WORDS}, score DESC, doc_id) AS place,
         count(*) FILTER (n_features >= {LEAST_WORDS}) OVER () AS n FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= n * {PERCENT} // 100 THEN place END AS rank FROM placed
"""
