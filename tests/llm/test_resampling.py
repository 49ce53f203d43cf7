"""Importance resampling against plain loops over all features."""

import hashlib
import math
import re
from collections import Counter
from zlib import crc32

import pytest

from formloom.llm import resampling

SCHEMA = "doc_id bigint, text string, weight string, rank int, c0 int, row_ int"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
AIM = ["Alpha beta gamma delta", "alpha BETA", None, "", "ÄÖ ünïcode ÄÖ 日本"]
DOCS = [
    (1, None), (2, ""), (3, " .,;\n\x00"), (4, "alpha beta " * 30), (5, "ALPHA, beta. " * 30), (5, "ALPHA, beta. " * 30), (None, "alpha beta " * 30), (None, None),
    (6, "other words " * 19), (7, " ".join(f"w{i % 7}" for i in range(19))), (8, "x" * 200 + " " + "y1 " * 50), (9, "ÄÖ ünïcode äö 日本 " * 9), (10, " ".join(f"w{i}" for i in range(3000))),
    *((100 + i, f"alpha gamma w{i} " * 8) for i in range(60)),
]


def features(text, longest):
    words = WORD.findall((text or "").translate(LOW))
    return len(words), [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def brute(docs, aim, longest, buckets, percent):
    bucket = lambda f: crc32(f.encode()) % buckets
    s, t = (Counter(bucket(f) for x in texts for f in features(x, longest)[1]) for texts in ([d[1] for d in docs], aim))
    size_s, size_t = sum(s.values()) + buckets, sum(t.values()) + buckets
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * size_s / ((s[b] + 1) * size_t)))
    rows = []
    for doc_id, text in docs:
        n_words, own = features(text, longest)
        weight = sum(gain(bucket(f)) for f in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"{resampling.SEED}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append([doc_id, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n_words])
    fine = sorted((r for r in rows if r[5] >= resampling.LEAST_WORDS), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for rank, r in enumerate(fine[: len(fine) * percent // 100], start=1):
        r[4] = rank
    return sorted((tuple(r[:5]) for r in rows), key=str)


@pytest.mark.parametrize(("longest", "buckets", "percent", "head"), [(1, 10_000, 10, 50_000), (2, 100, 50, 3), (3, 1000, 100, 5), (2, 500, 30, 50_000)])
def test_resampled(spark, monkeypatch, longest, buckets, percent, head):
    monkeypatch.setattr(resampling, "HEAD", head)
    monkeypatch.setattr(resampling, "HELD", 50)
    docs = spark.createDataFrame([(*r, "w", 1, 2, 3) for r in DOCS], SCHEMA).repartition(3)
    aim = spark.createDataFrame([(a,) for a in AIM], "text string")
    rows, n = resampling.resampled(docs, aim, longest=longest, buckets=buckets, percent=percent)
    assert rows.columns[:5] == ["doc_id", "weight", "rank", "c0", "row_"] and n["weight"] != "weight"
    found = rows.collect()
    assert {(r["weight"], r["rank"], r["c0"], r["row_"]) for r in found} == {("w", 1, 2, 3)}
    got = sorted((tuple(r[c] for c in ("doc_id", *n.values())) for r in found), key=str)
    assert got == brute(DOCS, AIM, longest, buckets, percent)


def test_nothing_to_draw(spark):
    docs = spark.createDataFrame([(*r, "w", 1, 2, 3) for r in DOCS[:3]], SCHEMA)
    aim = spark.createDataFrame([], "text string")
    rows, n = resampling.resampled(docs, aim)
    assert [(r[n["n_features"]], r[n["weight"]], r[n["rank"]]) for r in rows.collect()] == [(0, 0, None)] * 3
    assert resampling.resampled(docs.limit(0), aim)[0].collect() == []
