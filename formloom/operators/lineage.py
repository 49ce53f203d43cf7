"""What came in, what is still valid, and what has to run again."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formloom.operators.ordinals import running_total
from formloom.operators.sizing import broadcast_if_small, hot_safe_join

ALIGNED_STATES = ("aligned", "sending", "received")
MONTHLY_CAP = 900


def reconcile_sources(incoming: DataFrame, manifest: DataFrame, pages: DataFrame) -> DataFrame:
    """C14: compare incoming files with what is known.

    ``incoming`` (name, hash) and ``manifest`` (name, hash) have unique names,
    ``pages`` is (source_file, state). Adds ``replaced`` (same name, other
    content: its old pages go) and ``action``:

    * same: known under this name;
    * duplicate: the content belongs to ``other``, which is part of the input
      (a known name, or the first by name of this input);
    * renamed: known under ``other``, which is gone, and the new name has no
      pages or only skipped duplicates: pages move and keep their ids;
    * rename_fallback: as before, but the new name has pages: processed again;
    * new.

    The comparison is set based: entries of names replaced by this input are
    ignored when looking for known content. (A file by file walk would call the
    first of two files that swap contents a duplicate of content the second no
    longer has.)

    Copies of one content are never gathered: they are reduced to (first name,
    count) before the shuffle and joined back with hot contents spread.
    """
    by_name = manifest.select("name", F.col("hash").alias("prev_hash"))
    flagged = incoming.join(by_name, "name", "left").withColumn(
        "replaced", F.coalesce(F.col("prev_hash") != F.col("hash"), F.lit(False))
    )
    busy = pages.groupBy(F.col("source_file").alias("name")).agg(
        F.max(F.col("state") != "skipped_duplicate").alias("has_pages")
    )
    flagged = flagged.join(busy, "name", "left").withColumn(
        "has_pages", F.coalesce(F.col("has_pages"), F.lit(False)) & ~F.col("replaced")
    )
    present = flagged.select("name", F.lit(True).alias("present"), "replaced")
    known = (
        manifest.join(present, "name", "left")
        .filter(~F.coalesce("replaced", F.lit(False)))
        .groupBy("hash")
        .agg(F.min(F.struct("name", F.coalesce("present", F.lit(False)).alias("present"))).alias("k"))
        .select("hash", F.col("k.name").alias("known_as"), F.col("k.present").alias("known_present"))
    )
    owners = (
        incoming.groupBy("hash")
        .agg(F.min("name").alias("first_name"), F.count(F.lit(1)).alias("copies"))
        .join(known, "hash", "left")
    )
    joined = hot_safe_join(flagged, owners, ["hash"], "copies", ["name"])
    name = F.col("name")
    first = name == F.col("first_name")
    action = (
        F.when(name == F.col("known_as"), "same")
        .when(F.col("known_present"), "duplicate")
        .when(~first, "duplicate")
        .when(F.col("known_as").isNull(), "new")
        .when(F.col("has_pages"), "rename_fallback")
        .otherwise("renamed")
    )
    return joined.withColumn("action", action).select(
        *incoming.columns, "replaced", "action",
        F.when(F.col("action") == "duplicate", F.when(F.col("known_present"), F.col("known_as")).otherwise(F.col("first_name")))
        .when(F.col("action").isin("renamed", "rename_fallback"), F.col("known_as"))
        .alias("other"),
    )


def skip_rows(actions: DataFrame, page_counts: DataFrame) -> DataFrame:
    """C14: one skipped page per page of the original of a duplicate, at least one.

    ``page_counts`` (name, pages) has one row per file. One original may have
    very many copies, so their count is used to spread the join.
    """
    dups = actions.filter(F.col("action") == "duplicate").select("name", "other")
    wanted = dups.groupBy("other").agg(F.count(F.lit(1)).alias("copies"))
    sized = wanted.join(page_counts.withColumnRenamed("name", "other"), "other", "left")
    return (
        hot_safe_join(dups, sized, ["other"], "copies", ["name"])
        .select(
            F.col("name").alias("source_file"), "other",
            F.explode(F.sequence(F.lit(1).cast("long"), F.greatest(F.coalesce("pages", F.lit(1)), F.lit(1)).cast("long"))).alias("page_no"),
        )
    )


def missing_inputs(pages: DataFrame, incoming: DataFrame) -> DataFrame:
    """Source files with pages that are not part of this input; reported, not deleted."""
    return pages.select(F.col("source_file").alias("name")).distinct().join(incoming, "name", "left_anti")


def cascade_delete(pages: DataFrame, derived: dict[str, DataFrame], names: DataFrame) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Pages of the named sources and all rows derived from them go."""
    files = broadcast_if_small(names.select(F.col("name").alias("source_file")))
    gone = broadcast_if_small(pages.join(files, "source_file", "left_semi").select("page_id"))
    left = pages.join(files, "source_file", "left_anti")
    return left, {k: df.join(gone, "page_id", "left_anti") for k, df in derived.items()}


def upsert_page_rows(old: DataFrame, new: DataFrame, touched: DataFrame) -> DataFrame:
    """C17: all rows of the touched pages are replaced; keys not written again vanish.

    ``touched`` is one batch of pages. If its size allows, the old rows are
    filtered in place; otherwise they meet the pages in a shuffle whose skewed
    partitions adaptive execution splits (an anti join may split its left side).
    """
    pages = broadcast_if_small(touched.select("page_id").distinct())
    return old.join(pages, "page_id", "left_anti").unionByName(new)


@dataclass(frozen=True)
class Current:
    """What the present run works with."""

    template_hash: str
    geometry_hash: str
    algo_version: str
    snap_enabled: bool


def stale_pages(pages: DataFrame, alignment: DataFrame, now: Current) -> DataFrame:
    """Done pages made with another template, geometry, method or snap setting, or never aligned."""
    odd = (
        ~F.col("template_hash").eqNullSafe(now.template_hash)
        | F.col("geometry_hash").isNull()
        | (F.col("geometry_hash") != now.geometry_hash)
        | (F.col("algo_version") != now.algo_version)
        | (F.col("snap_enabled") != now.snap_enabled)
    )
    return (
        pages.filter(F.col("state") == "done")
        .join(alignment.select("page_id", "geometry_hash", "algo_version", "snap_enabled"), "page_id", "left")
        .filter(odd)
        .select("page_id")
        .distinct()
    )


def check_reusable(pages: DataFrame, alignment: DataFrame, now: Current, check_template: bool = True) -> DataFrame:
    """One row with the first reason why stored data may not be used, or NULL.

    Compared are the sets found on done pages; nothing stored is fine. Only
    whether anything differs is kept, so no set of hashes is ever collected.
    """
    done = pages.filter(F.col("state") == "done").select("page_id", "template_hash")
    seen = done.join(alignment, "page_id", "left")

    def differs(column: str, value) -> Column:
        return F.coalesce(F.max(F.col(column) != F.lit(value)), F.lit(False))

    facts = seen.agg(
        differs("geometry_hash", now.geometry_hash).alias("g"),
        differs("algo_version", now.algo_version).alias("a"),
        differs("snap_enabled", now.snap_enabled).alias("s"),
        F.coalesce(
            F.max((F.col("template_hash") != "") & (F.col("template_hash") != now.template_hash)), F.lit(False)
        ).alias("t"),
    )
    reason = F.when(F.col("g"), "geometry").when(F.col("a"), "method").when(F.col("s"), "snap")
    if check_template:
        reason = reason.when(F.col("t"), "template")
    return facts.select(reason.alias("reason"))


def resend_policy(pages: DataFrame, stale: DataFrame, allow: bool) -> DataFrame:
    """Stale pages go back to pending if allowed, otherwise they are marked refused."""
    marked = pages.join(stale.select("page_id", F.lit(True).alias("stale")), "page_id", "left")
    is_stale = F.coalesce("stale", F.lit(False))
    state = F.when(is_stale & F.lit(allow), "pending").otherwise(F.col("state"))
    return marked.withColumn("state", state).withColumn("refused", is_stale & ~F.lit(allow)).drop("stale")


def fold_page_state(log: DataFrame) -> DataFrame:
    """State per page from an event log (page_id, ts, ord, state, has_response).

    done and skipped_duplicate are final. A page that reached aligned, sending
    or received is not sent back by a later pending or expanded; after a
    failure it is. A page found sending with a stored response counts as
    received. Only maxima are kept per page, so the same aggregation runs as a
    stream in update mode.
    """
    state = F.col("state")
    moment = F.struct("ts", "ord", "state")
    facts = log.groupBy("page_id").agg(
        F.max(state == "done").alias("done"),
        F.max(state == "skipped_duplicate").alias("dup"),
        F.max(F.when(state.isin(*ALIGNED_STATES, "failed"), moment)).alias("step"),
        F.max(moment).alias("last"),
        F.max("has_response").alias("response"),
    )
    step = F.col("step.state")
    held = F.when(step.isin(*ALIGNED_STATES), F.when((step == "sending") & F.col("response"), "received").otherwise(step))
    return facts.select(
        "page_id",
        F.when(F.col("done"), "done").when(F.col("dup"), "skipped_duplicate")
        .otherwise(F.coalesce(held, F.col("last.state"))).alias("state"),
    )


def budget_gate(requests: DataFrame, cap: int = MONTHLY_CAP, period: str = "period", order: str = "ord",
                units: str = "units") -> DataFrame:
    """Requests admitted per period before the cap stops everything.

    Units are counted before sending and are not negative, so the running total
    only grows: a request is admitted exactly when the total including it stays
    within the cap, and after the first refusal none is.
    """
    total = running_total(requests, [order], units, "used", keys=[period])
    return total.withColumn("admitted", F.col("used") <= cap)


def send_limit_gate(pages: DataFrame, limit: int, order: tuple[str, ...] = ("source_file", "page_no")) -> DataFrame:
    """Sent, reused or capped, in page order.

    The limit is tested before the stored response: once ``limit`` sends are
    used every later page is capped, whether it has a response or not.
    """
    need = pages.withColumn("_need", F.when(F.col("has_response"), 0).otherwise(1).cast("long"))
    counted = running_total(need, list(order), "_need", "_upto")
    before = F.col("_upto") - F.col("_need")
    return counted.withColumn(
        "gate", F.when(before >= limit, "capped").when(F.col("has_response"), "reused").otherwise("sent")
    ).drop("_need", "_upto")


def dedupe_content(incoming: DataFrame, manifest: DataFrame) -> DataFrame:
    """S3, batch form: one file per content that is not known yet (the first by name)."""
    return (
        incoming.groupBy("hash").agg(F.min("name").alias("name"))
        .join(manifest.select("hash"), "hash", "left_anti")
    )


def rename_pages(pages: DataFrame, actions: DataFrame) -> DataFrame:
    """C14: pages of renamed sources move to the new name and keep their ids."""
    moved = broadcast_if_small(
        actions.filter(F.col("action") == "renamed").select(F.col("other").alias("source_file"), F.col("name").alias("_to"))
    )
    return pages.join(moved, "source_file", "left").withColumn(
        "source_file", F.coalesce("_to", "source_file")
    ).drop("_to")
