"""Removal of byte passages that an earlier document has, by suffix arrays.

A byte is removed if a 50-byte string that covers it also starts in a document with a smaller id. All such strings of
all texts are judged, on the input. The steps:

1. Of equal texts only the one with the smallest id is looked at; the others are copies and lose everything, if they
   have 50 bytes. Texts lie in groups by a hash, one exchange for all steps.
2. Each 50-byte string has one anchor, its 28-byte string with the smallest hash, so equal strings have equal anchors.
   A group tells each shard the sorted hashes of its anchors, nothing else; a shard answers each group with those that
   two texts have. Only these can lie in a repeated string.
3. Groups find their anchors once more, and cut out the run of bytes that the strings with a shared anchor cover. Runs go
   to shards by anchor; of equal runs in a group, only the one of the smallest document does.
4. A shard joins its different runs, builds their suffix array by induced sorting, and finds strings of 50 bytes that neighbours in
   the array share through permuted common prefixes. Each string gets the smallest document that has it, and documents
   after that one get the span to remove.
5. Spans go back to the groups, packed, and are cut out of the texts.

What a group and a shard tell each other is one packed row, so a passage that a third of all documents has costs a shard
one run per group, not one per document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from formloom.llm.common import table, text_of
from formloom.llm.suffixes import common_at_least, suffix_array

SIZE, GRAM = 50, 28
#: Bytes of a text that are handled at a time, bytes of runs in one suffix array.
PIECE, ARRAY = 1 << 23, 1 << 20
_PLACE = np.uint64((1 << 24) - 1)
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def runs_of(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, first and last start of each stretch of 50-byte strings that share their anchor place."""
    found = []
    for low in range(0, max(1, len(data) - SIZE + 1), PIECE):
        part = np.frombuffer(data, np.uint8)[low : low + PIECE + SIZE - 1]
        n = len(part) - SIZE + 1
        if n <= 0:
            break
        padded = np.concatenate([part, np.zeros(8, np.uint8)])
        eight = np.ndarray((len(part),), "<u8", padded, strides=(1,)).copy()
        grams = len(part) - GRAM + 1
        h = np.zeros(grams, np.uint64)
        for k in (0, 8, 16, GRAM - 8):  # four words of eight bytes cover the gram
            h ^= eight[k : k + grams]
            h *= _B
            h ^= h >> np.uint64(29)
        h ^= h >> np.uint64(32)
        h *= _A
        least = (h & ~_PLACE) | np.arange(grams, dtype=np.uint64)
        have, width = 1, SIZE - GRAM + 1
        while have < width:
            step = min(have, width - have)
            least = np.minimum(least[:-step], least[step:])
            have += step
        first = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1])
        last = np.concatenate([first[1:], [n]]) - 1
        found.append((h[(least[first] & _PLACE).astype(np.int64)], first + low, last + low))
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def packed(columns: list[np.ndarray], rest: bytes = b"") -> bytes:
    """Columns of 64-bit numbers, byte by byte so that equal high bytes lie together, and further bytes; compressed."""
    flat = b"".join(np.ascontiguousarray(c.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes() for c in columns)
    return len(columns[0]).to_bytes(8, "little") + zstandard.ZstdCompressor(level=1).compress(flat + rest)


def unpacked(pack: bytes, width: int) -> tuple[list[np.ndarray], bytes]:
    n, flat = int.from_bytes(pack[:8], "little"), zstandard.ZstdDecompressor().decompress(pack[8:])
    columns = [np.frombuffer(flat, np.uint8, 8 * n, 8 * n * i).reshape(8, n).T.copy().view("<i8").ravel() for i in range(width)]
    return columns, flat[8 * n * width :]


#: What groups and shards send each other. Known packs go through a shard as they are.
PACKS = "part int, grp int, known boolean, pack binary"
#: What a group is told: its texts (null kind), anchors that are shared (1), spans to remove (2).
TOLD = "grp int, kind int, pack binary"


def _table(rows: list[tuple]) -> pa.Table:
    names, kinds = ("part", "grp", "known", "pack"), (pa.int32(), pa.int32(), pa.bool_(), pa.binary())
    return pa.table({n: pa.array([r[i] for r in rows], k) for i, (n, k) in enumerate(zip(names, kinds, strict=True))})


def _by_part(anchor: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """Shards and the rows of each, in their order."""
    part = (anchor.view(np.uint64) % np.uint64(parts)).astype(np.int64)
    by = np.argsort(part, kind="stable")
    cut = np.searchsorted(part[by], np.arange(parts + 1))
    for p in np.flatnonzero(np.diff(cut)).tolist():
        yield p, by[cut[p] : cut[p + 1]]


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and sizes of groups of equal keys in sorted columns."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    start = np.flatnonzero(new)
    return start, np.diff([*start, len(new)])


def _texts(left: pa.Table, told: pa.Table) -> list[tuple[int, bytes, bytes]]:
    """Id, digest and bytes of the group's texts that aren't copies, by id; rows that repeat one count once."""
    own = {k for k, kind in zip(told["pack"].to_pylist(), told["kind"].to_pylist(), strict=True) if kind is None}
    found = {}
    for doc, digest, data in zip(*[left[c].to_pylist() for c in ("doc", "digest", "data")], strict=True):
        if digest + doc.to_bytes(8, "big", signed=True) in own:
            found[doc, digest] = data
    return [(*key, found[key]) for key in sorted(found)]


def _packs(told: pa.Table, kind: int, width: int) -> list[np.ndarray]:
    """Columns of all packs of a kind."""
    some = [unpacked(p, width)[0] for p, k in zip(told["pack"].to_pylist(), told["kind"].to_pylist(), strict=True) if k == kind]
    return [np.concatenate([s[i] for s in some] or [np.zeros(0, np.int64)]) for i in range(width)]


def _steps(ordered: np.ndarray) -> np.ndarray:
    """Differences of ordered numbers, which take fewer bytes; ``np.cumsum`` undoes it."""
    return np.diff(ordered, prepend=ordered.dtype.type(0)).view(np.int64)


def _anchored(parts: int):
    """Per group: for each shard the anchors of the group, and whether several of its texts have them."""

    def run(key: tuple, left: pa.Table, told: pa.Table) -> pa.Table:
        grp = key[0].as_py()
        anchor = np.concatenate([np.zeros(0, np.uint64), *[np.unique(runs_of(data)[0]) for _, _, data in _texts(left, told)]])
        anchor, many = np.unique(anchor, return_counts=True)
        own = (many > 1).astype(np.int64)
        return _table([(p, grp, False, packed([_steps(anchor[at]), own[at]])) for p, at in _by_part(anchor, parts)])

    return run


def _of_parts(batches: Iterator[pd.DataFrame]) -> Iterator[list[tuple[int, bool, bytes]]]:
    """Packs of one shard after the other; known packs come singly."""
    part, held = None, []
    for df in batches:
        for p, grp, known, pack in df.itertuples(index=False):
            if known:
                yield [(grp, known, pack)]
                continue
            if held and p != part:
                yield held
                held = []
            part = p
            held.append((grp, known, pack))
    if held:
        yield held


def _answers(grp: np.ndarray, kind: int, columns: list[np.ndarray], steps: bool = False) -> pd.DataFrame:
    """One pack for each group; rows are in the order of groups."""
    start, many = _groups(grp)
    cuts = [slice(a, a + n) for a, n in zip(start.tolist(), many.tolist(), strict=True)] if len(grp) else []
    packs = [packed([_steps(c[at]) if steps else c[at] for c in columns]) for at in cuts]
    return pd.DataFrame({"grp": grp[start].astype(np.int32) if len(grp) else [], "kind": np.full(len(cuts), kind, np.int32), "pack": packs})


def _shared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """To each group, those of its anchors that two texts have, of the group or of all."""
    for packs in _of_parts(batches):
        told = [unpacked(pack, 2)[0] for _, _, pack in packs]
        anchor = np.concatenate([np.cumsum(t[0].view(np.uint64)) for t in told])
        grp = np.repeat(np.array([g for g, _, _ in packs], np.int64), [len(t[0]) for t in told])
        own = np.concatenate([t[1] for t in told])
        by = np.argsort(anchor, kind="stable")
        start, many = _groups(anchor[by])
        on = np.empty(len(anchor), bool)
        on[by] = np.repeat((many > 1) | (np.add.reduceat(own[by], start) > 0), many)
        anchor, grp = anchor[on], grp[on]
        by = np.lexsort((anchor, grp))
        yield _answers(grp[by], 1, [anchor[by]], steps=True)


def merged(doc: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of each document, those that touch or overlap joined."""
    order = np.lexsort((first, doc))
    doc, first, end = doc[order], first[order], end[order]
    if not len(doc):
        return doc, first, end
    start, size = _groups(doc)
    # A running maximum within each document: documents are lifted apart by more than any end.
    lift = np.repeat(np.arange(len(start)), size) * (int(end.max()) + 1)
    reach = np.maximum.accumulate(end + lift) - lift
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (first[1:] > reach[:-1])
    at = np.flatnonzero(new)
    return doc[at], first[at], reach[np.append(at[1:], len(doc)) - 1]


def _cut(parts: int):
    """Runs around shared anchors, packed for their shards. Of equal runs in a group, only the one of the smallest
    document is sent: the others are spans to remove, since that document has every string of theirs."""

    def run(key: tuple, left: pa.Table, told: pa.Table) -> pa.Table:
        grp = key[0].as_py()
        packs = [unpacked(p, 1)[0][0] for p, k in zip(told["pack"].to_pylist(), told["kind"].to_pylist(), strict=True) if k == 1]
        shared = np.sort(np.concatenate([np.zeros(0, np.uint64), *[np.cumsum(p.view(np.uint64)) for p in packs]]))
        seen: dict[bytes, int] = {}
        columns: list[list[int]] = [[], [], [], [], []]
        runs, spans = [], []
        for i, (doc, _, data) in enumerate(_texts(left, told) if len(shared) else []):
            anchor, first, last = runs_of(data)
            on = shared[np.minimum(np.searchsorted(shared, anchor), len(shared) - 1)] == anchor
            for h, a, e in zip(anchor[on].view(np.int64).tolist(), first[on].tolist(), (last[on] + SIZE).tolist(), strict=True):
                at = seen.setdefault(body := data[a:e], len(runs))
                if at < len(runs) and columns[1][at] < doc:
                    spans.append((i, a, e))
                    continue
                for column, x in zip(columns, (h, doc, i, a, e - a), strict=True):
                    column.append(x)
                runs.append(body)
        sent = [np.array(c, np.int64) for c in columns]
        rows = [(p, grp, False, packed([c[at] for c in sent], b"".join([runs[j] for j in at.tolist()]))) for p, at in _by_part(sent[0], parts)]
        if spans:
            rows.append((grp, grp, True, packed(list(merged(*np.array(spans, np.int64).T)))))
        return _table(rows)

    return run


def repeated(codes: np.ndarray, size: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Run and place of each 50-byte string that a smaller document has, from one suffix array of all runs."""
    owner = np.repeat(np.arange(len(size)), size)
    ends = np.cumsum(size)
    inside = np.arange(len(codes)) + SIZE <= ends[owner]  # strings that don't reach into the next run
    array = suffix_array(codes, SIZE)
    group = np.cumsum(~common_at_least(codes, array, SIZE)) - 1
    whole = inside[array]
    array, group = array[whole], group[whole]
    least = np.full(int(group[-1]) + 1 if len(group) else 0, np.iinfo(np.int64).max)
    np.minimum.at(least, group, doc[owner[array]])
    at = np.sort(array[least[group] < doc[owner[array]]])
    return owner[at], at - (ends - size)[owner[at]]


def _judged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """To each group, spans to remove. A shard's runs are taken by anchor, whole anchors up to a bound in one array."""
    for packs in _of_parts(batches):
        if packs[0][1]:
            yield pd.DataFrame({"grp": [packs[0][0]], "kind": [2], "pack": [packs[0][2]]}).astype({"grp": np.int32, "kind": np.int32})
            continue
        told = [unpacked(pack, 5) for _, _, pack in packs]
        anchor, doc, text, first, size = (np.concatenate([t[0][i] for t in told]) for i in range(5))
        grp = np.repeat(np.array([g for g, _, _ in packs], np.int64), [len(t[0][0]) for t in told])
        body = b"".join([t[1] for t in told])
        flat, begin = np.frombuffer(body, np.uint8), np.cumsum(size) - size
        order = np.lexsort((doc, anchor))
        again = _copies(body, begin[order], size[order], doc[order])
        at, order = order[again], order[~again]
        yield _spans(grp[at], text[at], first[at], first[at] + size[at])
        start, many = _groups(anchor[order])
        filled = np.cumsum(np.add.reduceat(size[order], start))
        lots = np.searchsorted(filled, np.arange(0, filled[-1] + ARRAY, ARRAY), side="right")
        lots = np.unique([0, *lots, len(start)])
        for a, b in zip(lots, lots[1:], strict=False):
            some = order[start[a] : start[b - 1] + many[b - 1]]
            n = size[some]
            codes = flat[np.repeat(begin[some] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            run, place = repeated(codes, n, doc[some])
            at = some[run]
            yield _spans(grp[at], text[at], first[at] + place, first[at] + place + SIZE)


def _copies(body: bytes, begin: np.ndarray, size: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Runs, by rising document, that equal one of a smaller document, which then has every string of theirs."""
    seen: dict[bytes, int] = {}
    ends = zip(begin.tolist(), (begin + size).tolist(), doc.tolist(), strict=True)
    return np.fromiter((seen.setdefault(body[a:e], d) < d for a, e, d in ends), bool, len(size))


def _spans(grp: np.ndarray, text: np.ndarray, first: np.ndarray, end: np.ndarray) -> pd.DataFrame:
    """Spans to each group. Texts of all groups get numbers of their own, in the order of groups."""
    key, number = np.unique(np.stack([grp, text]), axis=1, return_inverse=True)
    number, first, end = merged(number.ravel(), first, end)
    return _answers(key[0][number], 2, [key[1][number], first, end])


def _removed(key: tuple, left: pa.Table, told: pa.Table) -> pa.Table:
    text, first, end = _packs(told, 2, 3)
    by = np.argsort(text, kind="stable")
    text, first, end = text[by], first[by], end[by]
    rows = []
    for i, (doc, digest, data) in enumerate(_texts(left, told)):
        a, b = np.searchsorted(text, [i, i + 1])
        gone = np.zeros(len(data) + 1, np.int32)
        np.add.at(gone, first[a:b], 1)
        np.add.at(gone, end[a:b], -1)
        off = np.cumsum(gone[:-1]) > 0
        rest = np.frombuffer(data, np.uint8)[~off].tobytes() if a < b else data
        n_spans = int(np.count_nonzero(off[1:] & ~off[:-1])) + int(off[:1].sum())
        rows.append((doc, digest, int(off.sum()), n_spans, hashlib.sha256(rest).hexdigest(), rest))
    names = ("doc", "digest", "n_removed", "n_spans", "kept_sha256", "rest")
    kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.binary())
    return pa.table({n: pa.array([r[i] for r in rows], k) for i, (n, k) in enumerate(zip(names, kinds, strict=True))})


LAST_ID = (1 << 63) - 1


def removed(docs: DataFrame, with_rest: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row, and the remaining bytes if ``with_rest``.

    Rows that share an id never lose a string to each other. Null texts are empty. Null ids count as one id larger than
    every other. Texts under 50 bytes lose nothing. An empty table gives an empty result; further columns are left out.
    """
    spark = docs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * docs.rdd.getNumPartitions())
    data = F.encode(text_of(), "UTF-8")
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("doc"), F.unhex(F.md5(data)).alias("digest"), data.alias("data"))

    def group(doc: str) -> Column:
        return F.pmod(F.xxhash64("digest", doc), F.lit(parts)).cast("int").alias("grp")

    def shards(packs: DataFrame) -> DataFrame:
        return packs.repartition(parts, "part").sortWithinPartitions("part")

    # Texts move once: all three steps read the same exchange by group.
    texts = rows.select(group("doc"), "doc", "digest", "data").groupBy("grp")
    least = rows.groupBy("digest").agg(F.min("doc").alias("doc"))
    # The digest and the eight bytes of the id, as ``int.to_bytes`` gives them.
    told = least.select(group("doc"), F.lit(None).cast("int").alias("kind"), F.concat("digest", F.unhex(F.lpad(F.hex("doc"), 16, "0"))).alias("pack"))
    anchors = shards(texts.cogroup(told.groupBy("grp")).applyInArrow(_anchored(parts), PACKS))
    shared = anchors.mapInPandas(_shared, TOLD)
    runs = shards(texts.cogroup(told.unionByName(shared).groupBy("grp")).applyInArrow(_cut(parts), PACKS))
    spans = runs.mapInPandas(_judged, TOLD)
    done = texts.cogroup(told.unionByName(spans).groupBy("grp")).applyInArrow(
        _removed, "doc bigint, digest binary, n_removed bigint, n_spans bigint, kept_sha256 string, rest binary"
    )
    if not with_rest:
        done = done.drop("rest")
    # Copies of an earlier text aren't among the texts that were looked at.
    size, long = F.octet_length("data").cast("long"), F.octet_length("data") >= SIZE
    told_of = {
        "n_removed": F.when(long, size).otherwise(F.lit(0)),
        "n_spans": F.when(long, F.lit(1)).otherwise(F.lit(0)).cast("long"),
        "kept_sha256": F.when(long, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.sha2("data", 256)),
    } | ({"rest": F.when(~long, F.col("data")).otherwise(F.lit(b""))} if with_rest else {})
    copies = rows.select("doc", "digest", size.alias("n_bytes"), *[c.alias(f"copy_{n}") for n, c in told_of.items()])
    out = copies.join(done, ["doc", "digest"], "left")
    return out.select(F.nullif("doc", F.lit(LAST_ID)).alias("doc_id"), "n_bytes", *[F.coalesce(n, f"copy_{n}").alias(n) for n in told_of])


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed(table(spark, sf_dir, "documents").select("doc_id", "text"))
