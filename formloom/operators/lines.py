"""Line positions against templates: votes, residuals, verdicts, snapping.

Positions are whole pixels, so after removing duplicates a page holds at most
its height plus its width of them, however many rows it came from. Every
per-page window or array here is bounded by that. Tables with rows of pages meet
in sorted joins: they compress many times over, so Spark, which sees bytes of
files only, must not send them to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formloom.functions.scalars import page_size_verdict
from formloom.operators.islands import number_chains
from formloom.operators.lint import template_profile
from formloom.operators.sizing import broadcast_if_small
from formloom.session import kept
from formloom.sources.templates import ANCHOR_SEARCH, BASE_DPI, TEMPLATE_SCHEMA, expand_templates

# Fixed values, px at 300 dpi and ratios.
LINE_GAP = 6
MATCH_RATIO = 0.5
VOTE_LEAD = 2
RUNNER_DISTANCE = 4
EDGE_SLACK = 2
DETECT_RATIO = 0.5
SNAP_MIN_LINES = 4
SEARCH_SPARE = 2
CLEAR_LEAD = 0.1
ASPECT_BUCKET = 0.0102


def otsu_threshold(hist: DataFrame, keys: list[str]) -> DataFrame:
    """The bin that separates two classes best (pixels of bin <= k are dark).

    ``hist`` has keys, ``bin`` (0-255) and ``n``; several rows per bin are
    added up before the windows, which then see at most 256 rows. Without two
    classes the result is 128; the first maximum wins.
    """
    bins = hist.groupBy(*keys, "bin").agg(F.sum("n").alias("n"))
    upto = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    n = F.col("n").cast("double")
    total = F.sum(n).over(whole)
    omega = F.sum(n).over(upto) / total
    mu = F.sum(n * F.col("bin")).over(upto) / total
    mean = F.sum(n * F.col("bin")).over(whole) / total
    spread = omega * (1 - omega)
    sigma = F.when(spread > 0, (mean * omega - mu) * (mean * omega - mu) / spread)
    scored = bins.select(*keys, "bin", sigma.alias("sigma"))
    return scored.groupBy(*keys).agg(
        F.coalesce(
            F.max_by("bin", F.when(F.col("sigma").isNotNull(), F.struct("sigma", -F.col("bin")))), F.lit(128)
        ).alias("threshold")
    )


def line_positions(profile: DataFrame, keys: list[str], threshold: Column, gap: int = LINE_GAP) -> DataFrame:
    """Centres of bands where the profile (scan, ink) exceeds the threshold."""
    dark = profile.filter(F.col("ink") > threshold)
    return (
        number_chains(dark, keys, "scan", gap, "band")
        .groupBy(*keys, "band")
        .agg(F.floor(F.avg("scan")).cast("int").alias("pos"))
        .drop("band")
    )


def expected_lines(faces: DataFrame) -> DataFrame:
    """The lines that the documents of ``faces`` (from ``expand_templates``) say are printed, one row a line.

    A face with tables has the row and column lines of each block, with its number; two blocks may have equal lines. A
    face without has the sides of its fields that are long enough to show as lines. ``limit`` is how far the face is
    searched along the axis: less than half of the closest lines of its blocks, or a fixed length for fields; ``apart``
    is the distance from which a second shift is a rival. ``is_edge`` marks the first and last row line of each block,
    or the outermost lines of both axes of a face without tables. Lengths grow with the resolution of the document.
    """
    keys = ["template_id", "face_id"]

    def scaled(px: int, least: int) -> Column:
        return F.greatest(F.lit(least), F.bround(F.lit(px) * F.col("dpi") / BASE_DPI).cast("int"))

    def reach(name: str) -> Column:
        """Less than half of the smallest distance of neighbouring lines in any block; null without neighbours."""

        def steps(g: Column) -> Column:
            at = F.array_sort(g[name])
            return F.zip_with(F.slice(at, F.lit(2), F.greatest(F.size(at) - 1, F.lit(0))), F.slice(at, F.lit(1), F.greatest(F.size(at) - 1, F.lit(0))), lambda b, a: b - a)

        return F.floor(F.array_min(F.flatten(F.transform("geoms", steps))) / 2).cast("int") - SEARCH_SPARE

    along_x, along_y = reach("v_lines"), reach("h_lines")
    closed = along_x.isNull() | along_y.isNull()
    known = faces.withColumn("n_x", F.when(closed, 0).otherwise(F.greatest(along_x, F.lit(0)))).withColumn(
        "n_y", F.when(closed, 0).otherwise(F.greatest(along_y, F.lit(0)))
    ).withColumn("anchor", scaled(ANCHOR_SEARCH, 0)).withColumn("apart", scaled(RUNNER_DISTANCE, 1))
    blocks = known.select(*keys, "is_table", "n_x", "n_y", "anchor", "apart", F.posexplode("geoms").alias("block", "g"))

    def of(axis: str, name: str) -> Column:
        ends = F.array(F.array_min(F.col("g")[name]), F.array_max(F.col("g")[name]))
        return F.transform(F.col("g")[name], lambda p: F.struct(F.lit(axis).alias("axis"), p.alias("pos"), F.array_contains(ends, p).alias("end")))

    lines = blocks.select(*[c for c in blocks.columns if c != "g"], F.explode(F.concat(of("h", "h_lines"), of("v", "v_lines"))).alias("l"))
    # one window per face of a document
    face = Window.partitionBy(*keys, "l.axis")
    outer = (F.col("l.pos") == F.min("l.pos").over(face)) | (F.col("l.pos") == F.max("l.pos").over(face))
    return lines.select(
        *keys, "l.axis", F.when(F.col("is_table"), F.col("block")).alias("block_idx"), "l.pos",
        F.when(F.col("is_table"), F.when(F.col("l.axis") == "h", F.col("n_y")).otherwise(F.col("n_x"))).otherwise(F.col("anchor")).alias("limit"),
        "apart", F.when(F.col("is_table"), (F.col("l.axis") == "h") & F.col("l.end")).otherwise(outer).alias("is_edge"),
    )


def expected_stats(expected: DataFrame, keys: list[str]) -> DataFrame:
    """Expected lines of a template per ``keys`` as arrays; duplicates stay in ``lines``."""
    apart = [F.max("apart").alias("apart")] if "apart" in expected.columns else []
    return expected.groupBy(*keys).agg(F.sort_array(F.collect_list("pos")).alias("lines"), F.max("limit").alias("limit"), *apart)


def axis_votes(detected: DataFrame, stats: DataFrame, page_keys: list[str], template_keys: list[str]) -> DataFrame:
    """How many expected entries have a line within one pixel, per shift.

    ``detected`` has page_keys + template_keys + pos. The expected lines come in
    by broadcast; every line meets only entries within the search limit. The
    lines of a key meet in one array, in which each entry votes once for a
    shift, so votes are counted where they arise and are never shuffled.
    """
    keys = [*page_keys, *template_keys]
    found = detected.groupBy(*keys).agg(F.collect_set("pos").alias("at")).join(broadcast_if_small(stats), template_keys)

    def shifts(e: Column) -> Column:
        near = F.filter("at", lambda p: F.abs(p - e) <= F.col("limit") + 1)
        each = F.flatten(F.transform(near, lambda p: F.array(p - e - 1, p - e, p - e + 1)))
        return F.array_distinct(F.filter(each, lambda s: F.abs(s) <= F.col("limit")))

    # outer, as Spark would else build the list once more to leave out pages without a vote
    hits = found.select(*keys, F.explode_outer(F.flatten(F.transform("lines", shifts))).alias("shift")).filter(F.col("shift").isNotNull())
    return hits.groupBy(*keys, "shift").agg(F.count(F.lit(1)).alias("votes"))


def axis_shift(votes: DataFrame, base: DataFrame, keys: list[str], runner_distance: int = RUNNER_DISTANCE) -> DataFrame:
    """Best shift per key, its votes, the best distant rival, and whether it hits the limit.

    ``base`` holds every key with ``lines`` and ``limit``, and with ``apart``
    where the distance of rivals depends on the document. Ties go to the
    smaller shift, then to the negative one; without votes the shift is 0.
    """
    rival = F.col("apart") if "apart" in base.columns else F.lit(runner_distance)
    packed = votes.groupBy(*keys).agg(F.collect_list(F.struct("votes", "shift")).alias("v"))
    best = F.array_max(
        F.transform(
            "v", lambda t: F.struct(t["votes"].alias("votes"), (-F.abs(t["shift"])).alias("near"), (-t["shift"]).alias("neg"))
        )
    )
    out = base.join(packed.hint("merge"), keys, "left").withColumn("b", best)
    shift = F.coalesce(-F.col("b.neg"), F.lit(0))
    out = out.withColumn("shift", shift).withColumn("votes", F.coalesce("b.votes", F.lit(0)))
    far = F.filter("v", lambda t: F.abs(t["shift"] - F.col("shift")) >= rival)
    return out.select(
        *[c for c in base.columns], "shift", "votes",
        F.coalesce(F.array_max(F.transform(far, lambda t: t["votes"])), F.lit(0)).alias("runner"),
        ((F.abs("shift") >= F.col("limit")) & (F.col("limit") > 0)).alias("at_boundary"),
    )


def nearest_lines(targets: DataFrame, detected: DataFrame, keys: list[str]) -> DataFrame:
    """Signed distance from every target to the nearest line; on a tie the larger position.

    One sort per key instead of pairs: the last line at or before and the first
    one after each target. ``targets`` keeps its columns; ``distance`` is NULL
    where a key has no line.
    """
    extra = [c for c in targets.columns if c not in (*keys, "target")]
    marks = targets.select(*keys, F.col("target").alias("_at"), F.lit(1).alias("_kind"), F.struct("target", *extra).alias("_row"))
    lines = detected.select(*keys, F.col("pos").alias("_at"), F.lit(0).alias("_kind")).distinct().withColumn(
        "_row", F.lit(None).cast(marks.schema["_row"].dataType)
    )
    w = Window.partitionBy(*keys).orderBy("_at", "_kind")
    line = F.when(F.col("_kind") == 0, F.col("_at"))
    both = (
        marks.unionByName(lines)
        .withColumn("_below", F.last(line, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_above", F.first(line, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)))
        .filter(F.col("_kind") == 1)
    )
    up, down = F.col("_above") - F.col("_at"), F.col("_at") - F.col("_below")
    return both.select(
        *keys, "_row.*", F.when(down.isNull() | (up <= down), up).otherwise(-down).alias("distance")
    )


def lower_median(values: Column) -> Column:
    """The middle of a list, the smaller of two middles."""
    ordered = F.array_sort(values)
    return F.get(ordered, F.floor((F.size(ordered) - 1) / 2).cast("int"))


def line_residuals(near: DataFrame, keys: list[str], window: Column) -> DataFrame:
    """What is left between expected and found lines after the shift."""
    paired = F.when(F.abs("distance") <= window, F.col("distance"))
    return near.groupBy(*keys).agg(
        F.coalesce(lower_median(F.collect_list(paired)), F.lit(0)).alias("med"),
        F.coalesce(F.max(F.abs(paired)), F.lit(0)).alias("max_abs"),
        F.count(paired).alias("pairs"),
        F.count_if(paired.isNull()).alias("unpaired"),
    )


def estimate_shift(shifts: DataFrame, near: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """One estimate per face with the first reason to reject it.

    ``shifts``: keys + axis rows of :func:`axis_shift`; ``near``: keys + axis +
    distance + is_edge for the distinct expected lines at that shift; ``found``:
    keys + axis + detected count. Order of reasons: few_lines, boundary,
    ambiguous, edge_mismatch.
    """
    facts = near.groupBy(*keys, "axis").agg(
        F.count_if(F.abs("distance") <= 1).alias("matched_uniq"),
        F.count(F.lit(1)).alias("exp_uniq"),
        F.coalesce(
            F.min(F.when(F.col("is_edge"), F.coalesce(F.abs("distance") <= EDGE_SLACK, F.lit(False)))), F.lit(True)
        ).alias("edges_ok"),
    )
    counts = found.groupBy(*keys, "axis").agg(F.count_distinct("pos").alias("detected"))
    rows = shifts.join(facts.hint("merge"), [*keys, "axis"], "left").join(counts.hint("merge"), [*keys, "axis"], "left")
    need = F.greatest(F.lit(2), F.ceil(F.size("lines") * MATCH_RATIO))
    rows = rows.select(
        *keys, "axis",
        F.struct(
            "shift", "votes", "runner", "at_boundary", F.size("lines").alias("expected"), need.alias("need"),
            F.coalesce("matched_uniq", F.lit(0)).alias("matched_uniq"), F.coalesce("exp_uniq", F.lit(0)).alias("exp_uniq"),
            F.coalesce("detected", F.lit(0)).alias("detected"), F.coalesce("edges_ok", F.lit(True)).alias("edges_ok"),
        ).alias("m"),
    )
    both = rows.groupBy(*keys).agg(
        F.max(F.when(F.col("axis") == "h", F.col("m"))).alias("h"), F.max(F.when(F.col("axis") == "v", F.col("m"))).alias("v")
    )

    def of(axis: str, name: str, default) -> Column:
        return F.coalesce(F.col(f"{axis}.{name}"), F.lit(default))

    def either(test) -> Column:
        return test("h") | test("v")

    reason = (
        F.when(either(lambda a: of(a, "votes", 0) < of(a, "need", 2)), "few_lines")
        .when(either(lambda a: of(a, "at_boundary", False)), "boundary")
        .when(either(lambda a: of(a, "votes", 0) - of(a, "runner", 0) < VOTE_LEAD), "ambiguous")
        .when(either(lambda a: ~of(a, "edges_ok", True)), "edge_mismatch")
        .otherwise("")
    )
    return both.select(
        *keys, of("v", "shift", 0).alias("dx"), of("h", "shift", 0).alias("dy"),
        (of("h", "votes", 0) + of("v", "votes", 0)).alias("matched"),
        (of("h", "expected", 0) + of("v", "expected", 0)).alias("total"),
        of("h", "detected", 0).alias("det_h"), of("v", "detected", 0).alias("det_v"),
        of("h", "exp_uniq", 0).alias("exp_h"), of("v", "exp_uniq", 0).alias("exp_v"),
        (of("h", "matched_uniq", 0) + of("v", "matched_uniq", 0)).alias("matched_uniq"),
        (of("h", "at_boundary", False) | of("v", "at_boundary", False)).alias("at_boundary"),
        reason.alias("reason"),
    )


def face_verdicts(estimates: DataFrame) -> DataFrame:
    """Verdict, reason code and score of a face."""
    reason, exp = F.col("reason"), F.col("exp_h") + F.col("exp_v")
    sparse = ((F.col("exp_h") > 0) & (F.col("det_h") < F.col("exp_h") * DETECT_RATIO)) | (
        (F.col("exp_v") > 0) & (F.col("det_v") < F.col("exp_v") * DETECT_RATIO)
    )
    lines = (
        F.when((exp == 0) | sparse, F.struct(F.lit("undecidable").alias("verdict"), F.lit("few_lines").alias("why")))
        .when(F.col("at_boundary"), F.struct(F.lit("undecidable").alias("verdict"), F.lit("boundary").alias("why")))
        .otherwise(F.struct(F.lit("mismatch").alias("verdict"), F.lit("lines").alias("why")))
    )

    def fixed(verdict: str, why: str) -> Column:
        return F.struct(F.lit(verdict).alias("verdict"), F.lit(why).alias("why"))

    out = (
        F.when(reason == "", fixed("match", ""))
        .when(reason == "boundary", fixed("undecidable", "boundary"))
        .when(reason == "edge_mismatch", fixed("undecidable", "edge"))
        .when(reason == "ambiguous", fixed("mismatch", "ambiguous"))
        .when(reason == "few_lines", lines)
        .otherwise(fixed("undecidable", "unknown"))
    )
    score = F.when(exp > 0, F.col("matched_uniq") / exp).otherwise(F.lit(-1.0))
    return estimates.withColumn("_v", out).withColumn("verdict", F.col("_v.verdict")).withColumn(
        "why", F.col("_v.why")
    ).withColumn("score", score).withColumn("detected", F.col("det_h") + F.col("det_v")).withColumn("expected", exp).drop("_v")


def fold_verdicts(faces: DataFrame, keys: list[str], order: str = "face_ord") -> DataFrame:
    """The verdict of a page is that of its worst face, all five values from that one face.

    Skipped faces do not count; among equally bad faces the lowest measured
    score decides. (A score of -1 means not measured.)
    """
    rank = F.when(F.col("verdict") == "mismatch", 0).when(F.col("verdict") == "match", 2).otherwise(1)
    live = F.col("verdict") != "skipped"
    picked = faces.groupBy(*keys).agg(
        F.min_by(
            F.struct("verdict", "why", "score", "detected", "expected"),
            F.when(live, F.struct(rank.alias("r"), (F.col("score") == -1.0).alias("u"), "score", order)),
        ).alias("p")
    )
    return picked.select(
        *keys, F.coalesce("p.verdict", F.lit("undecidable")).alias("verdict"), F.coalesce("p.why", F.lit("unknown")).alias("why"),
        F.coalesce("p.score", F.lit(-1.0)).alias("score"), F.coalesce("p.detected", F.lit(0)).alias("detected"),
        F.coalesce("p.expected", F.lit(0)).alias("expected"),
    )


def renamed(documents: DataFrame) -> DataFrame:
    """Bodies of documents (name, body) that are told apart by their name, not by the id inside."""
    doc = F.from_json("body", TEMPLATE_SCHEMA)
    return documents.select(F.to_json(doc.withField("template_id", F.col("name"))).alias("body"))


def screen_candidates(templates: DataFrame, limit: int | None = None, max_bytes: int | None = None) -> DataFrame:
    """C11: candidate templates (name, body) with the reason to leave one out, or NULL.

    size: more than ``max_bytes``; parse: not a JSON object; schema: no template,
    no output columns or duplicate names; limit: beyond the first ``limit``
    usable candidates by name. Neither limit holds unless it is given.
    """
    is_object = F.coalesce(F.schema_of_variant(F.try_parse_json("body")).startswith("OBJECT"), F.lit(False))
    large = F.lit(False) if max_bytes is None else F.octet_length("body") > max_bytes
    rough = F.when(large, "size").when(~is_object, "parse")
    judged = templates.select("name", "body", rough.alias("rough"))
    named = renamed(judged.filter(F.col("rough").isNull()))
    good = kept(template_profile(expand_templates(named)).filter("usable").select(F.col("template_id").alias("name")))
    first = good if limit is None else good.orderBy("name").limit(limit)
    first = first.withColumn("taken", F.lit(True))
    return (
        judged.drop("body")
        .join(good.withColumn("usable", F.lit(True)), "name", "left")
        .join(first, "name", "left")
        .select(
            "name",
            F.coalesce("rough", F.when(F.col("usable").isNull(), "schema"), F.when(F.col("taken").isNull(), "limit")).alias("reason"),
        )
    )


def candidate_pairs(pages: DataFrame, candidates: DataFrame) -> DataFrame:
    """C11: pages (page_id, w, h) with the candidates (template_id, image_w, image_h) of their aspect.

    The one per cent of tolerance is a range join on the logarithm of the
    aspect through buckets a little wider than it; pairs that differ more are a
    mismatch by size and never built.
    """
    def bucket(w: Column, h: Column) -> Column:
        return F.floor(F.log(w / h) / ASPECT_BUCKET)

    sized = pages.filter((F.col("w") > 0) & (F.col("h") > 0)).withColumn("_b", bucket(F.col("w"), F.col("h")))
    near = candidates.filter((F.col("image_w") > 0) & (F.col("image_h") > 0)).withColumn(
        "_b", F.explode(F.sequence(bucket(F.col("image_w"), F.col("image_h")) - 1, bucket(F.col("image_w"), F.col("image_h")) + 1))
    )
    fits = page_size_verdict(F.col("w"), F.col("h"), F.col("image_w"), F.col("image_h")) == "ok"
    return sized.join(broadcast_if_small(near), "_b").filter(fits).select("page_id", "template_id")


def match_lines(pages: DataFrame, detected: DataFrame, expected: DataFrame) -> DataFrame:
    """C11 up to the faces: estimates per (page, template, face).

    ``pages`` (page_id, template_id) lists which templates a page is compared
    with: its own one, or every candidate of its aspect. ``detected`` has
    page_id, face_id, axis, pos; ``expected`` template_id, face_id, axis, pos,
    block_idx, limit.
    """
    keys, tkeys = ["page_id"], ["template_id", "face_id", "axis"]
    stats = expected_stats(expected, tkeys)
    small = broadcast_if_small(stats)
    base = pages.select("page_id", "template_id").join(small, "template_id")
    # the raw rows are read once; votes, distances and counts use the distinct positions
    lines = kept(
        detected.select("page_id", "face_id", "axis", "pos").distinct().join(pages.hint("merge"), "page_id").select(*keys, *tkeys, "pos")
    )
    every = [*keys, *tkeys]
    # one row per page, face and axis, read by the residuals and the estimate
    shifts = kept(axis_shift(axis_votes(lines, stats, keys, tkeys), base, every))
    # A face with tables must find the first and last line of every block, on the y axis; one without must find its
    # outermost lines on both axes, else a shift by one pitch would pass.
    span = [F.min("pos").alias("lo"), F.max("pos").alias("hi")]
    blocks = expected.filter((F.col("axis") == "h") & F.col("block_idx").isNotNull()).groupBy(*tkeys, "block_idx").agg(*span)
    outer = expected.join(blocks.select("template_id", "face_id").distinct(), ["template_id", "face_id"], "left_anti").groupBy(*tkeys).agg(*span)
    ends = blocks.drop("block_idx").unionByName(outer).groupBy(*tkeys).agg(F.flatten(F.collect_list(F.array("lo", "hi"))).alias("edges"))
    # the nearest line within the array of a key; on a tie the larger position
    at = lines.groupBy(*every).agg(F.collect_set("pos").alias("at"))
    ahead = F.transform("at", lambda p: p - F.col("e") - F.col("shift"))
    near = (
        shifts.join(broadcast_if_small(ends), tkeys, "left").join(at.hint("merge"), every, "left")
        .select(*every, "shift", "edges", "at", F.explode(F.array_distinct("lines")).alias("e"))
        .select(
            *every, (-F.array_min(F.transform(ahead, lambda d: F.struct(F.abs(d).alias("far"), (-d).alias("back"))))["back"]).alias("distance"),
            F.coalesce(F.array_contains("edges", F.col("e")), F.lit(False)).alias("is_edge"),
        )
    )
    return estimate_shift(shifts, near, lines, ["page_id", "template_id", "face_id"])


def block_shifts(pages: DataFrame, detected: DataFrame, expected: DataFrame, face_shift: DataFrame) -> DataFrame:
    """Per block of a face the residual after the face shift and the votes of its own search."""
    tkeys = ["template_id", "face_id", "axis", "block_idx"]
    every = ["page_id", *tkeys]
    only_h = expected.filter(F.col("axis") == "h")
    stats = expected_stats(only_h, tkeys)
    base = pages.select("page_id", "template_id").join(broadcast_if_small(stats), "template_id")
    lines = kept(
        detected.filter(F.col("axis") == "h").select("page_id", "face_id", "axis", "block_idx", "pos").distinct()
        .join(pages.hint("merge"), "page_id").select(*every, "pos")
    )
    own = axis_shift(axis_votes(lines, stats, ["page_id"], tkeys), base, every)
    targets = (
        base.join(face_shift.select("page_id", "template_id", "face_id", "dy").hint("merge"), ["page_id", "template_id", "face_id"])
        .select(*every, "dy", "limit", F.explode(F.array_distinct("lines")).alias("e"))
        .select(*every, "limit", (F.col("e") + F.col("dy")).alias("target"))
    )
    residual = line_residuals(nearest_lines(targets, lines, every), every, F.col("limit"))
    return own.select(*every, F.col("votes").alias("block_votes"), F.size("lines").alias("block_expected")).join(residual.hint("merge"), every).drop("axis")


def snap_plan(blocks: DataFrame, tolerance: DataFrame) -> DataFrame:
    """Whether the blocks of a face may follow their own lines.

    A block with four expected lines or fewer is excluded; one with too few
    matches or too large a move is unhealthy. A face moves only if all its
    blocks are fine; an excluded block outranks an unhealthy one.
    """
    keys = ["page_id", "template_id", "face_id"]
    need = F.greatest(F.lit(2), F.ceil(F.col("block_expected") / 2))
    reason = (
        F.when(F.col("block_expected") <= SNAP_MIN_LINES, "excluded")
        .when(F.col("block_votes") < need, "few_lines")
        .when(F.abs("med") > F.col("row_gap"), "over_tolerance")
        .otherwise("")
    )
    judged = blocks.join(broadcast_if_small(tolerance), ["template_id", "face_id", "block_idx"]).withColumn("block_reason", reason)
    faces = judged.groupBy(*keys).agg(
        F.max(F.col("block_reason") == "excluded").alias("excluded"),
        F.max(F.col("block_reason").isin("few_lines", "over_tolerance")).alias("failsafe"),
        F.sort_array(F.collect_list(F.struct("block_idx", F.col("med").alias("dy"), F.col("block_reason").alias("reason")))).alias("blocks"),
    )
    return faces.select(
        *keys, F.when(F.col("excluded"), "excluded").when(F.col("failsafe"), "failsafe").otherwise("none").alias("outcome"),
        (~F.col("excluded") & ~F.col("failsafe")).alias("applied"), "blocks",
    )


def apply_shift(cells: DataFrame, plan: DataFrame) -> DataFrame:
    """Cells of the pages with the y moves of their blocks.

    ``cells`` (template_id, face_id, block_idx, field_id, x, y, w, h): single
    fields have no block and stay. Adds ``new_y``.
    """
    moves = plan.select("page_id", "template_id", "face_id", F.when(F.col("applied"), F.col("blocks")).alias("blocks"))
    small = broadcast_if_small(cells)
    dy = F.get(F.filter("blocks", lambda b: b["block_idx"] == F.col("block_idx")), F.lit(0))["dy"]
    return moves.join(small, ["template_id", "face_id"]).withColumn("new_y", F.col("y") + F.coalesce(dy, F.lit(0))).drop("blocks")


def rank_candidates(matches: DataFrame, truncated: DataFrame | None = None) -> DataFrame:
    """Candidates of a page in the order to show, and whether the first may be picked.

    ``matches`` (page_id, name, verdict, score) has at most as many rows per
    page as there are candidate templates. By name and without a pick when the
    list was cut short, nothing matches, or the two best matches are close;
    otherwise by score, and the best match is the pick. ``show_score`` is false
    where the list was cut short or the best matches are close.
    """
    hit = F.col("verdict") == "match"
    if truncated is not None:
        matches = matches.join(truncated.select("page_id", F.lit(True).alias("_cut")), "page_id", "left")
    else:
        matches = matches.withColumn("_cut", F.lit(False))
    matches = matches.withColumn("_hit", F.when(hit, F.col("score")))
    best = Window.partitionBy("page_id").orderBy(F.col("_hit").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = matches.withColumn("_top", F.first("_hit").over(best)).withColumn("_second", F.nth_value("_hit", 2).over(best))
    whole = ~F.coalesce("_cut", F.lit(False))
    apart = F.coalesce(F.col("_top") - F.col("_second") >= CLEAR_LEAD, F.lit(True))
    marked = ends.withColumn("_clear", whole & F.col("_top").isNotNull() & apart)
    order = Window.partitionBy("page_id").orderBy(
        F.when(F.col("_clear"), -F.col("score")).asc_nulls_first(), "name"
    )
    return (
        marked.withColumn("rank", F.row_number().over(order))
        .withColumn("pick", F.col("_clear") & hit & (F.col("score") == F.col("_top")))
        .withColumn("show_score", whole & (F.col("_top").isNull() | apart))
        .drop("_clear", "_cut", "_hit", "_top", "_second")
    )
