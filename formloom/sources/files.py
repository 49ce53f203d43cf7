"""Listing scanned files and naming their pages (A2, A3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from formloom.operators.sizing import hot_safe_join

# Accepted file suffixes.
SUFFIXES = ("pdf", "jpg", "jpeg", "png")


def suffix_of(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([^./\\]+)$", 1))


def split_sources(files: DataFrame, name: str = "name") -> DataFrame:
    """Flag the files that can be read; the others form the skipped ledger."""
    return files.withColumn("accepted", suffix_of(F.col(name)).isin(*SUFFIXES))


def list_sources(spark: SparkSession, path: str) -> DataFrame:
    """A2: files below ``path`` with the hash of their bytes; nothing is decoded.

    Files with other suffixes are listed without being opened, their hashes are NULL. Files without
    a byte are not listed, as the source has no rows for them.
    """
    either = ",".join("*." + "".join(f"[{c}{c.upper()}]" for c in s) for s in SUFFIXES)

    def listed(**options: str) -> DataFrame:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").options(**options).load(path)
        return split_sources(files.withColumn("name", F.regexp_extract("path", r"([^/\\]+)$", 1)))

    head = ["name", "path", F.col("length").alias("bytes")]
    accepted = listed(pathGlobFilter=f"{{{either}}}").filter("accepted").select(
        *head, F.sha1("content").alias("hash"), F.sha2("content", 256).alias("image_sha256"), "accepted"
    )
    nothing = F.lit(None).cast("string")
    return accepted.unionByName(listed().filter("NOT accepted").select(*head, nothing.alias("hash"), nothing.alias("image_sha256"), "accepted"))


def assign_page_ids(pages: DataFrame, existing: DataFrame, spread: str = "page_no") -> DataFrame:
    """A3: stable page ids.

    ``pages`` has ``source_file, page_no``. A page already in ``existing`` keeps
    its id. A new one is ``<stem>_pNNNN``, or carries eight hex digits of the
    SHA-1 of its file name when that base id belongs to another file: one that
    already owns it, or the first by name among the new ones.
    """
    stem = F.regexp_replace(F.regexp_extract("source_file", r"([^/\\]+)$", 1), r"\.[^.]*$", "")
    base = F.format_string("%s_p%04d", stem, F.col("page_no"))
    fresh = pages.join(
        existing.select("source_file", "page_no", F.col("page_id").alias("kept")),
        ["source_file", "page_no"],
        "left",
    ).withColumn("base", base)
    claims = fresh.filter(F.col("kept").isNull()).groupBy("base").agg(
        F.min("source_file").alias("first_file"), F.count(F.lit(1)).alias("claims")
    )
    taken = existing.select(F.col("page_id").alias("base"), F.lit(True).alias("taken"))
    owners = claims.join(taken, "base", "left")
    named = hot_safe_join(fresh, owners, ["base"], "claims", ["source_file", spread])
    free = F.col("taken").isNull() & (F.col("source_file") == F.col("first_file"))
    salted = F.format_string(
        "%s_%s_p%04d", stem, F.substring(F.sha1("source_file"), 1, 8), F.col("page_no")
    )
    return named.select(
        *pages.columns,
        F.coalesce("kept", F.when(free, F.col("base")).otherwise(salted)).alias("page_id"),
    )
