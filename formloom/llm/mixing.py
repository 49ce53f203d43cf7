"""Mix sources to target weights by systematic sampling.

Every document of a source is expected equally often: target / size of its source. Documents of a source are put
in one order, the expected copies are summed along it, one random offset per source is added, and a document is
emitted once for each whole number that its step crosses. Ordering by size spreads the picks evenly over short and
long documents, so the words taken come within about one document of the target.

A source may hold a third of all rows. Its order is therefore cut into groups (source, size, salt); only their
counts are summed along the source, and rows are numbered within a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from formloom.llm.common import fresh, n_words, table, text_of
from formloom.session import kept

WEIGHTS = (1, 2, 3)
MAX_COPIES = 3
SALTS = 32
SEED = "mix-1"


def source_key(source: Column) -> Column:
    """A join key that keeps null apart from every string; it sorts like the source."""
    return F.when(source.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), source))


def offset(key: Column, seed: str = SEED) -> Column:
    """One number in [0, 1) per source, a multiple of 2^-20, so that sums with whole numbers stay exact."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + "/"), key)), 1, 5), 16, 10).cast("double") / F.lit(1048576.0)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """``sizes`` (key, source_size) with ``target``: a row per source, so its windows see the list of sources only.

    Shares are proportional to the weights, a share stops at ``max_copies`` times the source, and the rest is shared
    again. In order of size per weight the sources that stop come first, so the level of the others follows from
    running sums: it is the first level that its own source doesn't exceed.
    """
    in_order = Window.orderBy((F.col("key") == "0").asc(), "key")
    rank = F.row_number().over(in_order) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (rank % len(weights) + 1).cast("int")).cast("long")
    by_room = Window.orderBy(F.col("source_size") / F.col("weight"), "key")
    before, whole = by_room.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    df = (
        sizes.withColumn("weight", weight)
        .withColumn("cap", F.lit(max_copies) * F.col("source_size"))
        .withColumn("left", F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("rest", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("level", F.col("left").cast("double") / F.col("rest"))
        .withColumn("fits", F.col("level") * F.col("weight") <= F.col("cap"))
    )
    df = df.withColumn("final", F.max_by(F.when(F.col("fits"), F.col("level")), F.when(F.col("fits"), F.col("rest"))).over(whole))
    share = F.least(F.col("final") * F.col("weight"), F.col("cap").cast("double"))
    return df.select("key", "source_size", F.coalesce(share, F.lit(0.0)).alias("target"))


def mix(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_copies: int = MAX_COPIES, seed: str = SEED, salts: int = SALTS
) -> tuple[DataFrame, dict[str, str]]:
    """All rows of ``docs`` with size, source_size, target and copies; also the names of these columns.

    Nulls: a null text has size 0, a null source is a source of its own and sorts last, null ids sort first. Rows
    without words cost nothing and get copies like any other of their source; a source without any word has target 0
    and no copies. Equal rows are interchangeable. An empty table gives an empty result; a column of ``docs``
    that has one of the added names keeps it, the added one gets underscores in front.
    """
    size, source_size, target, copies, key, salt, at, start, expected = names = fresh(
        docs, "size", "source_size", "target", "copies", "key_", "salt_", "at_", "start_", "expected_"
    )
    sized = (
        docs.withColumn(size, n_words(text_of(docs["text"])))
        .withColumn(key, source_key(docs["source"]))
        .withColumn(salt, F.coalesce(F.pmod(docs["doc_id"], F.lit(salts)), F.lit(0)).cast("int"))
    )
    if set(docs.columns) <= {"doc_id", "text", "source"}:  # narrow input: the words are counted once
        sized = kept(sized.drop("text"))
    groups = kept(sized.groupBy(F.col(key).alias("key"), F.col(size).alias("size"), F.col(salt).alias("salt")).agg(F.count("*").alias("n")))
    by_size = groups.groupBy("key", "size").agg(F.sum("n").alias("rows"))
    upto = Window.partitionBy("key").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    by_size = by_size.withColumn("first", F.coalesce(F.sum("rows").over(upto), F.lit(0)))
    aims = targets(by_size.groupBy("key").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size")), weights, max_copies)
    within = Window.partitionBy("key", "size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        groups.withColumn("inner", F.coalesce(F.sum("n").over(within), F.lit(0)))
        .join(by_size, ["key", "size"])
        .join(aims, "key")
        .select(
            F.col("key").alias(key), F.col("size").alias(size), F.col("salt").alias(salt), (F.col("first") + F.col("inner")).alias(start),
            F.col("source_size").alias(source_size), F.col("target").alias(target),
        )
    )
    numbered = sized.withColumn(at, F.row_number().over(Window.partitionBy(key, size, salt).orderBy("doc_id")) - 1)
    step = F.when(F.col(source_size) > 0, F.col(target) / F.col(source_size)).otherwise(F.lit(0.0))
    place = F.col(start) + F.col(at)
    crossed = F.floor(offset(F.col(key), seed) + (place + 1) * F.col(expected)) - F.floor(offset(F.col(key), seed) + place * F.col(expected))
    out = numbered.join(starts, [key, size, salt]).withColumn(expected, step).withColumn(copies, crossed.cast("long"))
    return out.drop(key, salt, at, start, expected), dict(zip(("size", "source_size", "target", "copies"), names[:4], strict=True))


def emitted(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each document as often as it is taken, in the columns of ``docs``."""
    mixed, name = mix(docs, **options)
    (again,) = fresh(mixed, "again_")
    wanted = mixed.filter(F.col(name["copies"]) > 0).withColumn(again, F.explode(F.sequence(F.lit(1), F.col(name["copies"]).cast("int"))))
    return wanted.select(*docs.columns)


def op10_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed, _ = mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def mix_sql(docs: str = "documents") -> str:
    """Query of (doc_id, size, source_size, target, copies) for a table or subquery of documents."""
    return f"""
WITH d AS (SELECT doc_id, CASE WHEN source IS NULL THEN '0' ELSE '1' || source END AS skey,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM {docs}),
s AS (SELECT skey, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY skey),
w AS (SELECT *, 1 + (row_number() OVER (ORDER BY skey = '0', skey) - 1) % 3 AS weight FROM s),
c AS (SELECT *, 3 * source_size AS cap, (SELECT sum(source_size) FROM s) AS total, (SELECT sum(weight) FROM w) AS weights FROM w),
l AS (SELECT *, CAST(total - coalesce(sum(cap) OVER b, 0) AS DOUBLE) / CAST(weights - coalesce(sum(weight) OVER b, 0) AS DOUBLE) AS level,
    weights - coalesce(sum(weight) OVER b, 0) AS rest FROM c
    WINDOW b AS (ORDER BY CAST(source_size AS DOUBLE) / weight, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT arg_max(level, rest) AS level FROM l WHERE level * weight <= cap),
t AS (SELECT skey, source_size, coalesce(least((SELECT level FROM f) * weight, CAST(cap AS DOUBLE)), 0.0) AS target,
    CAST(CAST('0x' || substr(md5('{SEED}/' || skey), 1, 5) AS INTEGER) AS DOUBLE) / 1048576.0 AS start,
    CASE WHEN source_size > 0 THEN coalesce(least((SELECT level FROM f) * weight, CAST(cap AS DOUBLE)), 0.0) / source_size ELSE 0.0 END AS e FROM l),
o AS (SELECT d.*, row_number() OVER (PARTITION BY skey ORDER BY size, coalesce(((doc_id % {SALTS}) + {SALTS}) % {SALTS}, 0), doc_id NULLS FIRST) - 1 AS i FROM d)
SELECT doc_id, size, source_size, target, CAST(floor(start + (i + 1) * e) - floor(start + i * e) AS BIGINT) AS copies FROM o JOIN t USING (skey)"""


ORACLE = f"SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM ({mix_sql()})"
