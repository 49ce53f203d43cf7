"""Pages against all templates of their catalogue."""

import json
import random

import pytest

from formloom.operators import matching as M

FOUND = "page_id STRING, face_id STRING, axis STRING, pos INT"
PAGES = "page_id STRING, catalogue INT, w INT, h INT"
DOCS = "name STRING, body STRING, updated_at STRING"
OFFER = "catalogue INT, kind STRING, name STRING"


def form(xs, ys, w=900, h=900, fields=(), blank=False):
    """One face with a field per rectangle of neighbouring lines, so that all lines are printed."""
    rects = [(xs[0], ys[i], xs[-1] - xs[0], ys[i + 1] - ys[i]) for i in range(0, len(ys) - 1, 2)]
    rects += [(xs[i], ys[0], xs[i + 1] - xs[i], ys[-1] - ys[0]) for i in range(0, len(xs) - 1, 2)]
    cells = [{"field_id": f"n{i}", "kind": "text", "rect": dict(zip("xywh", r))} for i, r in enumerate(rects)]
    source = {"page_offset": 0, "rect": {"x": 0, "y": 0, "w": w, "h": h}}
    faces = [{"face_id": "f", "source": source, "exclusions": [], "fields": cells, "tables": []}]
    if blank:
        faces.append({"face_id": "g", "source": source, "exclusions": [], "fields": [], "tables": []})
    return json.dumps({"schema_version": 1, "template_id": "same", "render_dpi": 300, "image": {"width": w, "height": h}, "record": {"pages": 1}, "faces": faces})


@pytest.fixture(scope="module")
def inputs(spark):
    """Twelve random forms; pages print one of them, moved, with lines lost and others added."""
    rnd = random.Random(5)
    spots = {f"t{i:02d}": [sorted(rnd.sample(range(20, 860, 14), rnd.choice([4, 6, 8]))) for _ in range(2)] for i in range(12)}
    docs = [(n, form(*xy), "2024-01-01") for n, xy in spots.items()]
    docs += [("wide", form([20, 400, 700, 900], [20, 200, 300, 400], w=1800), None), ("bare", form(*spots["t00"], blank=True), None), ("bad", "{", None)]
    pages, found = [], []
    for i in range(40):
        name, dx, dy = f"t{i % 12:02d}", rnd.randint(-20, 20), rnd.randint(-20, 20)
        pages.append((f"p{i:02d}", i % 2, 900, 900 if i % 9 else None))
        for axis, at, move in (("v", spots[name][0], dx), ("h", spots[name][1], dy)):
            held = [p + move + rnd.choice([-1, 0, 0, 1]) for p in at if p in (at[0], at[-1]) or rnd.random() < 0.8]
            found += [(f"p{i:02d}", "f", axis, p) for p in held + [rnd.randrange(0, 900) for _ in range(3)]]
    offer = [(c, "user", n) for c in (0, 1) for n in spots] + [(0, "shipped", "wide"), (1, "user", "bare"), (1, "user", "bad"), (0, "user", "gone")]
    make = spark.createDataFrame
    return make(pages, PAGES), make(found + found[:9], FOUND), make(docs, DOCS), make(offer, OFFER)


def by_pair(df):
    return {(r.page_id, r.name): r for r in df.collect()}


def test_gaps_lose_no_match(inputs):
    whole, pruned = by_pair(M.matched_templates(*inputs)), by_pair(M.matched_templates(*inputs, prune=True))
    assert whole.keys() == pruned.keys() and len(whole) == 20 * 14 + 20 * 14
    matches = [k for k, r in whole.items() if r.verdict == "match"]
    assert len(matches) > 20
    for key, r in whole.items():
        other = pruned[key]
        assert (r.verdict == "match", r.pick, r.excluded, r.show_score) == (other.verdict == "match", other.pick, other.excluded, other.show_score)
        if other.why != "gaps":
            assert (r.verdict, r.why, r.score, r.detected, r.expected) == (other.verdict, other.why, other.score, other.detected, other.expected)
    gone = sum(r.why == "gaps" for r in pruned.values())
    assert gone > 0.3 * sum(r.why not in ("size", None) for r in whole.values())


def test_reasons(inputs):
    got = by_pair(M.matched_templates(*inputs))
    assert (got["p02", "wide"].verdict, got["p02", "wide"].why, got["p02", "wide"].score) == ("mismatch", "size", -1.0)
    assert got["p00", "t00"].why == got["p09", "t09"].why == "size"  # pages without a height
    assert (got["p01", "bad"].excluded, got["p02", "gone"].excluded) == ("parse", "not_found")
    assert got["p01", "bad"].verdict is None and got["p01", "bad"].rank is None
    # a face without lines can't be decided, however well the other one fits
    assert (got["p25", "bare"].verdict in ("undecidable", "mismatch")) and not got["p25", "bare"].pick
    assert got["p01", "t01"].template_id == "same" and got["p01", "t01"].fields > 0 and got["p01", "t01"].tables == 0
    assert got["p01", "t01"].updated_at == "2024-01-01"


def test_limit_and_order(inputs):
    got = by_pair(M.matched_templates(*inputs, limit=2))
    mine = sorted((r for (p, _), r in got.items() if p == "p02"), key=lambda r: r.name)
    assert [r.name for r in mine if r.excluded != "limit"] == ["gone", "wide"]  # the shipped one is taken first, then by name
    assert {r.excluded for r in mine} == {None, "not_found", "limit"}
    assert not any(r.pick or r.show_score for r in got.values() if r.excluded is None)


def test_nothing_to_match(spark, inputs):
    pages, found, docs, offer = inputs
    assert M.matched_templates(pages.limit(0), found, docs, offer).count() == 0
    assert M.matched_templates(pages, found, docs, offer.limit(0)).count() == 0
    none = by_pair(M.matched_templates(pages, found, docs.limit(0), offer))
    assert {r.excluded for r in none.values()} == {"not_found"}
    bare = M.matched_templates(pages, found.limit(0), docs, offer, prune=True)
    assert bare.filter("verdict = 'match'").count() == 0
