"""Which of many templates a page was printed from, as one job.

Documents are screened, paired with the pages of their catalogue, compared by size and then by lines. A template
can only match a page that has enough of its gaps between lines, so an index of gaps and their places can leave
the others out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formloom.functions.scalars import page_size_verdict
from formloom.operators.lines import (
    MATCH_RATIO, expected_lines, expected_stats, face_verdicts, fold_verdicts, match_lines, rank_candidates, renamed, screen_candidates,
)
from formloom.operators.sizing import broadcast_if_small, dealt
from formloom.session import kept
from formloom.sources.templates import expand_templates

# A vote allows one pixel at each line, so two at a gap; a posting of five pixels meets a gap and its slack in at most two.
GAP_SLACK = 2
GAP_WIDTH = 2 * GAP_SLACK + 1
# Pixels of one posting along the axis, about twice a search limit at 300 dpi.
PLACE_WIDTH = 64
# A line has postings for the gaps to this many lines that follow it.
GAP_REACH = 3
SIDE = ["template_id", "face_id", "axis"]


def _bucket(px: Column, width: int) -> Column:
    return F.floor(px / width).cast("int")


def line_gaps(expected: DataFrame) -> DataFrame:
    """Postings of expected lines: ``gap`` from a line at ``pos`` to one of the next, by buckets of both.

    ``need`` is how many of the gaps (``pair``) of an axis a page must have to match. Of n lines at least
    k = max(2, n / 2) must be found at one shift. Going through these in order, at most (n - k) / GAP_REACH steps pass
    over GAP_REACH lines or more; each of the other k - 1 steps is a pair. ``sides`` counts the axes of all faces of the
    template. A pair has a posting for each place its first line can be found at within the search limit.
    """
    stats = expected_stats(expected, SIDE)
    n = F.size("lines")
    votes = F.greatest(F.lit(2), F.ceil(n * MATCH_RATIO))
    sides = stats.groupBy("template_id").agg(F.count(F.lit(1)).alias("sides"))
    steps = F.flatten(F.transform("lines", lambda p, i: F.transform(
        F.slice("lines", i + 2, F.lit(GAP_REACH)), lambda q, j: F.struct((i * GAP_REACH + j).alias("pair"), p.alias("pos"), (q - p).alias("gap"))
    )))
    each = stats.select(*SIDE, "limit", (votes - 1 - F.floor((n - votes) / GAP_REACH)).cast("int").alias("need"), F.explode(steps).alias("s"))
    reach = F.col("limit") + 1
    places = F.sequence(_bucket(F.col("s.pos") - reach, PLACE_WIDTH), _bucket(F.col("s.pos") + reach, PLACE_WIDTH))
    return each.select(
        *SIDE, "need", "limit", "s.*", _bucket(F.col("s.gap"), GAP_WIDTH).alias("gap_at"), F.explode(places).alias("place")
    ).join(broadcast_if_small(sides), "template_id")


def gap_candidates(pairs: DataFrame, detected: DataFrame, expected: DataFrame) -> DataFrame:
    """The ``pairs`` (page_id, template_id) whose page has the gaps that a match needs on every axis of every face.

    No pair that matches is lost: a gap between two lines that vote for one shift lies within two pixels of the
    printed one, its first line within the search limit of the printed line, and lines closer than the slack may be
    found as one (gap 0). A page looks up, for each line, the lines that follow within the widest gap of any template.
    """
    postings = kept(line_gaps(expected))
    side = ["page_id", "face_id", "axis"]
    far = postings.groupBy("face_id", "axis").agg((F.max("gap") + GAP_SLACK).alias("far"))
    # A page stays in one task: its lines grow to hits of all templates, which are counted there and never shuffled. The
    # number of tasks follows the most hits there can be, by the pairs of templates that a line may be part of.
    lines = kept(detected.select(*side, "pos").distinct().join(pairs.select("page_id").distinct(), "page_id", "left_semi"))
    forms = postings.select("template_id").distinct().count()
    marks = (
        dealt(lines, ["page_id"], lines.count() * GAP_REACH * max(1, forms)).groupBy(*side)
        .agg(F.sort_array(F.collect_set("pos")).alias("at")).join(broadcast_if_small(far), ["face_id", "axis"])
    )
    # one line of the page at a time, so that a row never holds more gaps than the page has lines
    each = marks.select(*side, "at", "far", F.posexplode("at").alias("i", "p")).select(
        *side, F.col("p").alias("_pos"), F.explode(F.concat(F.array(F.lit(0)), F.transform(
            F.filter(F.slice("at", F.col("i") + 2, F.size("at")), lambda q: q - F.col("p") <= F.col("far")), lambda q: q - F.col("p")
        ))).alias("_gap"),
    )
    buckets = F.array_distinct(F.array(_bucket(F.col("_gap") - GAP_SLACK, GAP_WIDTH), _bucket(F.col("_gap") + GAP_SLACK, GAP_WIDTH)))
    probes = each.select(*side, "_pos", "_gap", _bucket(F.col("_pos"), PLACE_WIDTH).alias("place"), F.explode(buckets).alias("gap_at"))
    close = (F.abs(F.col("_gap") - F.col("gap")) <= GAP_SLACK) & (F.abs(F.col("_pos") - F.col("pos")) <= F.col("limit") + 1)
    shared = probes.join(broadcast_if_small(postings), ["face_id", "axis", "gap_at", "place"]).filter(close)
    hits = shared.select("page_id", *SIDE, "need", "sides", "pair").distinct()
    enough = hits.groupBy("page_id", *SIDE, "need", "sides").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= F.col("need"))
    whole = enough.groupBy("page_id", "template_id", "sides").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == F.col("sides"))
    pair, n = ["page_id", "template_id"], pairs.count()
    return dealt(pairs, pair, n).hint("merge").join(dealt(whole.select(*pair), pair, n), pair, "left_semi")


def offered_templates(documents: DataFrame, catalogue: DataFrame, limit: int | None = None, max_bytes: int | None = None) -> DataFrame:
    """The entries of each catalogue with ``excluded``, the reason to leave one out, or NULL.

    ``documents`` has one row per name; ``catalogue`` (catalogue, kind, name). With a limit the first entries are taken
    whatever their state, kind ``shipped`` before others, then by name; all others are left out as ``limit``.
    """
    judged = screen_candidates(documents, max_bytes=max_bytes).withColumn("_known", F.lit(True))
    listed = catalogue.select("catalogue", "kind", "name").distinct().join(broadcast_if_small(judged), "name", "left")
    reason = F.when(F.col("_known").isNull(), "not_found").otherwise(F.col("reason"))
    if limit is not None:
        # one window per catalogue, which lists templates, not pages
        place = F.row_number().over(Window.partitionBy("catalogue").orderBy(F.col("kind") != "shipped", "name", "kind"))
        listed = listed.withColumn("_place", place)
        reason = F.when(F.col("_place") > limit, "limit").otherwise(reason)
    return listed.select("catalogue", "kind", "name", reason.alias("excluded"))


def matched_templates(
    pages: DataFrame, detected: DataFrame, documents: DataFrame, catalogue: DataFrame, prune: bool = False,
    limit: int | None = None, max_bytes: int | None = None,
) -> DataFrame:
    """C11: one row per page and entry of its catalogue.

    ``pages`` (page_id, catalogue, w, h); ``detected`` (page_id, face_id, axis, pos); ``documents`` (name, body and,
    where known, updated_at), one row per name; ``catalogue`` (catalogue, kind, name). A catalogue offers a name once.

    Entries that were left out have ``excluded`` (not_found, size, parse, schema, limit) and no verdict. Where page and
    template differ in shape the verdict is mismatch by ``size`` with score -1, and lines aren't looked at; the same holds
    for pages without a size. Faces without printed lines are undecidable. ``rank``, ``pick`` and ``show_score`` are
    those of :func:`rank_candidates`; where entries were left out by the limit nothing is picked.

    With ``prune`` pairs that the gaps of lines rule out aren't voted on: mismatch by ``gaps``, score -1. Matches, their
    scores and the pick are the same either way; the others lose the exact reason and score.
    """
    dated = documents if "updated_at" in documents.columns else documents.withColumn("updated_at", F.lit(None).cast("string"))
    offers = kept(offered_templates(documents, catalogue, limit, max_bytes))
    usable = documents.join(broadcast_if_small(offers.filter("excluded IS NULL").select("name").distinct()), "name", "left_semi")
    tables = expand_templates(renamed(usable)).settled()
    expected = kept(expected_lines(tables.faces))

    fields = tables.cells.groupBy(F.col("template_id").alias("name")).agg(
        F.count_if(F.col("table_id").isNull()).alias("fields"), F.count_distinct("table_id").alias("tables")
    )
    image = tables.faces.groupBy(F.col("template_id").alias("name")).agg(F.first("image_w").alias("image_w"), F.first("image_h").alias("image_h"))
    heads = usable.select("name", F.get_json_object("body", "$.template_id").alias("template_id"))
    known = offers.join(dated.select("name", "updated_at"), "name", "left").join(heads, "name", "left").join(image, "name", "left").join(fields, "name", "left")
    zero = F.lit(0)
    fits = page_size_verdict(F.coalesce("w", zero), F.coalesce("h", zero), F.coalesce("image_w", zero), F.coalesce("image_h", zero)) == "ok"
    entries = kept(
        pages.select("page_id", "catalogue", "w", "h").join(broadcast_if_small(kept(known)), "catalogue")
        .withColumn("fits", F.col("excluded").isNull() & fits).drop("w", "h", "image_w", "image_h")
    )

    pairs = entries.filter("fits").select("page_id", F.col("name").alias("template_id"))
    if prune:
        pairs = kept(gap_candidates(pairs, detected, expected))
    faces = tables.faces.select("template_id", "face_id", "face_ord")
    judged = face_verdicts(match_lines(pairs, detected, expected)).join(broadcast_if_small(faces), ["template_id", "face_id"])
    blank = faces.join(expected.select("template_id", "face_id").distinct(), ["template_id", "face_id"], "left_anti")
    plain = ["page_id", "template_id", "face_ord", "verdict", "why", "score", "detected", "expected"]
    unruled = pairs.join(broadcast_if_small(blank), "template_id").select(
        "page_id", "template_id", "face_ord", F.lit("undecidable").alias("verdict"), F.lit("few_lines").alias("why"), F.lit(-1.0).alias("score"),
        zero.cast("long").alias("detected"), zero.alias("expected"),
    )
    folded = fold_verdicts(judged.select(*plain).unionByName(unruled), ["page_id", "template_id"]).withColumnRenamed("template_id", "name")
    voted = pairs.select("page_id", F.col("template_id").alias("name"), F.lit(True).alias("voted"))
    live = entries.filter("excluded IS NULL").join(voted, ["page_id", "name"], "left").join(folded, ["page_id", "name"], "left")

    def found(name: str, otherwise) -> Column:
        return F.when(F.col("voted"), F.col(name)).otherwise(otherwise).alias(name)

    rows = live.select(
        "page_id", "kind", "name", "template_id", found("verdict", F.lit("mismatch")), found("why", F.when(F.col("fits"), "gaps").otherwise("size")),
        found("score", F.lit(-1.0)), found("detected", zero), found("expected", zero), "fields", "tables", "updated_at", "excluded",
    )
    cut = entries.filter(F.col("excluded") == "limit").select("page_id").distinct()
    ranked = rank_candidates(rows, cut)
    left_out = entries.filter("excluded IS NOT NULL").select("page_id", "kind", "name", "updated_at", "excluded")
    return ranked.unionByName(left_out, allowMissingColumns=True)
