"""Alignment of two tokenizers' tokens by interval coalescing.

A is a byte-level vocabulary, B one of pieces with byte fallback. Both read a space and the text; byte offsets at which
tokens of both end cut the tokens into groups, and all A-B pairs of a group are links.

1. A task reads texts in lots of bounded size. A text is cut before each single space between two characters that aren't
   white space: no token of A or B crosses such a place, so different pieces of text are encoded and aligned once a lot.
2. Interval coalescing over all pieces of a lot: tokens of A and B are lexsorted by start, ``maximum.accumulate`` runs
   over their ends, and a group begins where a start reaches the running maximum. Groups expand to pairs of ids with
   the number of links of each.
3. A lot sends each pair once, with the number of its documents that hold it. Sums over lots are the corpus counts; the
   highest count of an A id is a table of at most as many rows as the vocabulary has entries.
4. Counts go back to the lots that asked for them. Sums over links are linear, so a lot turns counts into one number for
   each piece of text and adds these up by document; no text is read twice and no link moves.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formloom.llm.common import fresh, table
from formloom.session import kept

BYTE_FILE, PIECE_FILE = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
#: Characters and rows after which a lot is closed; pieces of text that are encoded at a time.
LOT_CHARS, LOT_ROWS, SLICE = 4_000_000, 50_000, 4096
#: A pair is one number: the id of A above the id of B.
SHIFT = 32
ADDED = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
CUT = re.compile(r"(?<=\S)(?= \S)")


def byte_of_sign() -> dict[str, int]:
    """The byte that each character of a byte-level entry stands for: printable ones for themselves, the others in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabularies:
    """Both encoders with the bytes of every id."""

    def __init__(self, byte_json: str, piece_proto: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark gives a task one core
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_str(byte_json), SentencePieceProcessor(model_proto=piece_proto)
        self.a.encode_special_tokens = True
        signs, entries = byte_of_sign(), self.a.get_vocab(with_added_tokens=False)
        self.a_bytes = [b""] * (1 + max(self.a.get_vocab().values()))
        for entry, i in entries.items():
            self.a_bytes[i] = bytes(signs[c] for c in entry) if all(c in signs for c in entry) else entry.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_size, self.b_size = (np.array([len(x) for x in part], np.int64) for part in (self.a_bytes, self.b_bytes))

    def encode(self, parts: list[str], plain: bool) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """Which parts both encoders give back byte for byte, and for A and B the ids and their number in each of these.

        Parts begin with a space, which B adds itself. ``plain`` parts are read as one text, in which no token may
        cross from one to the next; if one does, or the bytes differ, each is read alone.
        """
        own = [p.encode() for p in parts]
        if plain:
            whole, ends = "".join(parts), np.cumsum([len(o) for o in own])
            both = []
            for ids, bytes_of, size in (
                (self.a.encode(whole, add_special_tokens=False).ids, self.a_bytes, self.a_size),
                (self.b.encode(whole[1:]), self.b_bytes, self.b_size),
            ):
                if b"".join(map(bytes_of.__getitem__, ids)) != whole.encode():
                    return self.encode(parts, False)
                ids = np.array(ids, np.int64)
                token_ends = np.cumsum(size[ids])
                last = np.searchsorted(token_ends, ends)
                if (token_ends[last] != ends).any():
                    return self.encode(parts, False)
                both.append((ids, np.diff(last, prepend=-1)))
            return np.ones(len(parts), bool), both
        a = [e.ids for e in self.a.encode_batch(parts, add_special_tokens=False)]
        b = self.b.encode([p[1:] for p in parts], num_threads=1)
        right = np.ones(len(parts), bool)
        for rows, bytes_of in ((a, self.a_bytes), (b, self.b_bytes)):
            right &= [b"".join(map(bytes_of.__getitem__, row)) == o for row, o in zip(rows, own, strict=True)]
        return right, [flat([rows[i] for i in np.flatnonzero(right)]) for rows in (a, b)]


@cache
def vocabularies(byte_json: str, piece_proto: bytes) -> Vocabularies:
    return Vocabularies(byte_json, piece_proto)


def flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(ids) for ids in lists], np.int64)
    return np.array(list(chain.from_iterable(lists)), np.int64), sizes


def coalesced(a_size: np.ndarray, b_size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Group numbers of the tokens of A and of B, whose bytes cover the same range without gaps."""
    sizes = np.concatenate([a_size, b_size])
    ends = np.concatenate([np.cumsum(a_size), np.cumsum(b_size)])
    starts, side = ends - sizes, np.repeat(np.array([0, 1], np.int8), [len(a_size), len(b_size)])
    order = np.lexsort((side, starts))
    reached = np.maximum.accumulate(ends[order])
    new = np.ones(len(order), bool)
    new[1:] = starts[order][1:] >= reached[:-1]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(new) - 1
    return group[: len(a_size)], group[len(a_size) :]


def counted(group: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different (group, id) rows in order, with their number."""
    keys, n = np.unique((group << SHIFT) | ids, return_counts=True)
    return keys >> SHIFT, keys & ((1 << SHIFT) - 1), n


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All numbers of the ranges start, start + 1, ... of the given sizes, one range after the other."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


class Parts:
    """The different pieces of text of a lot: whether both encoders keep their bytes, their tokens, groups and links."""

    def __init__(self, parts: list[str], v: Vocabularies):
        n = len(parts)
        self.right = np.zeros(n, bool)
        self.n_a, self.n_b, self.n_groups, self.n_links = (np.zeros(n, np.int64) for _ in range(4))
        self.written = [""] * n  # groups as text
        owners, keys, links = [], [], []
        plain = np.array([len(p) > 1 and not p[1].isspace() and not p[-1].isspace() for p in parts], bool)
        slices = [(kind, i[at : at + SLICE]) for kind, i in ((True, np.flatnonzero(plain)), (False, np.flatnonzero(~plain))) for at in range(0, len(i), SLICE)]
        for kind, which in slices:
            right, ((a_ids, a_n), (b_ids, b_n)) = v.encode([parts[i] for i in which], kind)
            where = which[right]
            self.right[where] = True
            if not len(where):
                continue
            a_group, b_group = coalesced(v.a_size[a_ids], v.b_size[b_ids])
            # Numbers of parts are those of ``where`` up to the end of this step.
            part_of_group = np.repeat(np.arange(len(where)), a_n)[np.unique(a_group, return_index=True)[1]]
            for i, text in zip(where.tolist(), self._texts(part_of_group, a_ids, a_group, b_ids, b_group), strict=True):
                self.written[i] = text
            ga, ua, ca = counted(a_group, a_ids)
            gb, ub, cb = counted(b_group, b_ids)
            wide = np.bincount(gb, minlength=len(part_of_group))  # different ids of B in a group
            first = np.cumsum(wide) - wide
            mate, times = ranges(first[ga], wide[ga]), wide[ga]
            owner = part_of_group[np.repeat(ga, times)]
            owners.append(where[owner])
            keys.append((np.repeat(ua, times) << SHIFT) | ub[mate])
            links.append(np.repeat(ca, times) * cb[mate])
            self.n_a[where], self.n_b[where] = a_n, b_n
            self.n_groups[where] = np.bincount(part_of_group, minlength=len(where))
            self.n_links[where] = np.bincount(owner, weights=links[-1], minlength=len(where))
        none = np.zeros(0, np.int64)
        self.pairs, index = np.unique(np.concatenate([none, *keys]), return_inverse=True)
        owner = np.concatenate([none, *owners])
        # A pair may stand in several groups of a part.
        rows, back = np.unique(owner * max(1, len(self.pairs)) + index, return_inverse=True)
        self.link_owner, self.link_pair = np.divmod(rows, max(1, len(self.pairs)))
        self.link_n = np.bincount(back, weights=np.concatenate([none, *links]), minlength=len(rows)).astype(np.int64)
        self.width = np.bincount(self.link_owner, minlength=n)
        self.first = np.cumsum(self.width) - self.width

    @staticmethod
    def _texts(part_of_group: np.ndarray, a_ids: np.ndarray, a_group: np.ndarray, b_ids: np.ndarray, b_group: np.ndarray) -> list[str]:
        """The groups of each part as text, with a semicolon behind each group."""
        group, side = np.concatenate([a_group, b_group]), np.repeat([0, 1], [len(a_group), len(b_group)])
        order = np.lexsort((side, group))  # stable, so ids of one side stay in order
        group, side = group[order], side[order]
        last = np.ones(len(order), bool)
        last[:-1] = (group[1:] != group[:-1]) | (side[1:] != side[:-1])
        ids = np.concatenate([a_ids, b_ids])[order].tolist()
        marks = np.where(last, side + 1, 0).tolist()
        tokens = [f"{i}{',|;'[m]}" for i, m in zip(ids, marks, strict=True)]
        ends = np.cumsum(np.bincount(part_of_group[group])).tolist()
        return ["".join(tokens[i:j]) for i, j in zip([0, *ends], ends, strict=False)]


def packed(x: np.ndarray) -> bytes:
    """Whole numbers from 0 on in as few bytes as the largest needs, behind one byte that says how many."""
    kind = np.min_scalar_type(int(x.max(initial=0)))
    return bytes([kind.itemsize]) + x.astype(kind).tobytes()


def unpacked(b: bytes) -> np.ndarray:
    return np.frombuffer(b, f"u{b[0]}", offset=1).astype(np.int64)


class Numbered(dict):
    """Strings to their number, in order of appearance."""

    def __missing__(self, part: str) -> int:
        self[part] = n = len(self)
        return n


def lot(texts: list[str | None], v: Vocabularies) -> tuple[list[np.ndarray | list[str]], list]:
    """Columns n_a, n_b, n_groups, n_links, groups_sha256 of the texts, and what the lot needs to use counts later.

    That is: pairs, documents of each pair, then rows (pair, links) with their number in each part and rows (part,
    times) with their number in each document.
    """
    numbers = Numbered()
    own = [np.fromiter(map(numbers.__getitem__, CUT.split(f" {t}")), np.int64) if t else np.zeros(0, np.int64) for t in texts]
    parts = Parts(list(numbers), v)
    n, m = len(texts), max(1, len(numbers))
    right = np.fromiter((len(o) > 0 and bool(parts.right[o].all()) for o in own), bool, n)
    own = [o if r else o[:0] for o, r in zip(own, right, strict=True)]
    sizes = np.fromiter(map(len, own), np.int64, n)
    keys, times = np.unique(np.repeat(np.arange(n), sizes) * m + np.concatenate([np.zeros(0, np.int64), *own]), return_counts=True)
    doc, part = np.divmod(keys, m)
    sums = [np.bincount(doc, weights=times * x[part], minlength=n).astype(np.int64) for x in (parts.n_a, parts.n_b, parts.n_groups, parts.n_links)]
    written = parts.written
    digests = [hashlib.sha256("".join([written[i] for i in o.tolist()])[:-1].encode()).hexdigest() if r else "" for o, r in zip(own, right, strict=True)]
    held = parts.link_pair[ranges(parts.first[part], parts.width[part])]
    u = max(1, len(parts.pairs))
    docs_of_pair = np.bincount(np.unique(np.repeat(doc, parts.width[part]) * u + held) % u, minlength=len(parts.pairs))
    seen = docs_of_pair > 0  # parts of texts that count as without tokens leave pairs that no document holds
    kept_pairs = np.cumsum(seen) - 1
    use = seen[parts.link_pair]
    widths, rows = np.bincount(parts.link_owner[use], minlength=len(numbers)), np.bincount(doc, minlength=n)
    blobs = [widths, kept_pairs[parts.link_pair[use]], parts.link_n[use], rows, part, times]
    return [*sums, digests], [parts.pairs[seen], docs_of_pair[seen], [packed(x) for x in blobs], n]


def _aligned(files: Broadcast, k: int):
    """Rows of documents, and one row a lot; the text is the last of ``k + 1`` columns."""

    def closed(batches: list[pa.RecordBatch], number: int, v: Vocabularies, types: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
        texts = [t for b in batches for t in b.column(k).to_pylist()]
        columns, (pairs, docs, blobs, n) = lot(texts, v)
        names = [*[f"c{i}" for i in range(k)], "lot", "pos", *ADDED[:4], ADDED[6], "pairs", "docs", "blobs"]
        longs = lambda x: pa.array(x, pa.int64())
        none = pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.list_(pa.binary()))
        others = [pa.concat_arrays([b.column(i) for b in batches]) for i in range(k)]
        head = [longs(np.full(n, number)), longs(np.arange(n)), *[longs(c) for c in columns[:4]], pa.array(columns[4], pa.string())]
        yield pa.RecordBatch.from_arrays([*others, *head, *none], names)
        lists = pa.array([pairs], pa.list_(pa.int64())), pa.array([docs], pa.list_(pa.int64())), pa.array([blobs], pa.list_(pa.binary()))
        empty = [pa.nulls(1, t) for t in types] + [longs([number]), longs([n]), *[pa.nulls(1, pa.int64())] * 4, pa.nulls(1, pa.string())]
        yield pa.RecordBatch.from_arrays([*empty, *lists], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabularies(*files.value)
        number = TaskContext.get().partitionId() << 24
        open_, chars, rows = [], 0, 0
        for batch in batches:
            types = [batch.column(i).type for i in range(k)]
            lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column(k)), 0).to_numpy(zero_copy_only=False)
            start = 0
            for i, size in enumerate(lengths.tolist()):
                chars, rows = chars + size, rows + 1
                if chars >= LOT_CHARS or rows >= LOT_ROWS:
                    open_.append(batch.slice(start, i + 1 - start))
                    yield from closed(open_, number, v, types)
                    open_, chars, rows, start, number = [], 0, 0, i + 1, number + 1
            if start < batch.num_rows:
                open_.append(batch.slice(start))
        if open_:
            yield from closed(open_, number, v, types)

    return run


def _summed(asked: pd.DataFrame, lots: pd.DataFrame) -> pd.DataFrame:
    """n_best and count_sum of the documents of one lot; ``asked`` has count and best for each of its pairs."""
    row = lots.iloc[0]
    widths, link_pair, link_n, rows, part, times = map(unpacked, row["blobs"])
    link_part, doc = (np.repeat(np.arange(len(x)), x) for x in (widths, rows))
    pairs = np.asarray(row["pairs"], np.int64)
    n, best = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), np.int64)
    at = np.searchsorted(pairs, asked["key"].to_numpy(np.int64))
    n[at], best[at] = asked["n"].to_numpy(np.int64), asked["best"].to_numpy(np.int64)
    out = {"lot": row["own"], "pos": np.arange(len(rows))}
    for name, value in (("n_best", best), ("count_sum", n)):
        of_part = np.zeros(len(widths), np.int64)
        np.add.at(of_part, link_part, link_n * value[link_pair])
        of_doc = np.zeros(len(rows), np.int64)
        np.add.at(of_doc, doc, times * of_part[part])
        out[name] = of_doc
    return pd.DataFrame(out)


def aligned(docs: DataFrame, byte_file: str = BYTE_FILE, piece_file: str = PIECE_FILE) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` without text, with n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256; also their names.

    Null and empty texts, and texts that one of the encoders doesn't give back byte for byte (those with U+2581), have
    no tokens: zeros and an empty digest; they count in no document count. Texts of any length are one row of one lot.
    Every row is a document: repeated rows and null ids each count. An empty table gives an empty result; columns with
    the added names keep theirs.
    """
    spark = docs.sparkSession
    wanted = dict(zip(ADDED, fresh(docs, *ADDED), strict=True))
    others = [c for c in docs.columns if c != "text"]
    k = len(others)
    plain = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(others)], F.col("text").cast("string").alias("text"))
    with open(byte_file, encoding="utf-8") as a, open(piece_file, "rb") as b:
        files = spark.sparkContext.broadcast((a.read(), b.read()))
    fields = [f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(plain.schema.fields[:-1])]
    fields += ["lot bigint", "pos bigint", *[f"{c} bigint" for c in ADDED[:4]], f"{ADDED[6]} string"]
    schema = ", ".join([*fields, "pairs array<bigint>, docs array<bigint>, blobs array<binary>"])
    rows = kept(plain.mapInArrow(_aligned(files, k), schema))
    lots = rows.filter(F.col("pairs").isNotNull())
    asks = lots.select("lot", F.explode(F.arrays_zip("pairs", "docs")).alias("p")).select("lot", F.col("p.pairs").alias("key"), F.col("p.docs").alias("docs"))
    counts = kept(asks.groupBy("key").agg(F.sum("docs").alias("n"))).withColumn("a", F.shiftright("key", SHIFT))
    # One row for each id of A at most, so the size of its vocabulary bounds the broadcast.
    highest = counts.groupBy("a").agg(F.max("n").alias("most"))
    told = counts.join(F.broadcast(highest), "a").select("key", "n", (F.col("n") == F.col("most")).alias("best"))
    answers = asks.select("lot", "key").join(told, "key")
    waiting = lots.select(F.col("lot").alias("own"), "pairs", "blobs").groupBy("own")
    sums = answers.groupBy("lot").cogroup(waiting).applyInPandas(_summed, "lot bigint, pos bigint, n_best bigint, count_sum bigint")
    own = rows.filter(F.col("pairs").isNull()).drop("pairs", "docs", "blobs")
    found = own.join(sums, ["lot", "pos"], "left")
    names = [*others, *ADDED]
    columns = [*[F.col(f"c{i}") for i in range(k)], *[F.col(c) for c in ADDED]]
    return found.select(*[c.alias(wanted.get(n, n) if i >= k else n) for i, (c, n) in enumerate(zip(columns, names, strict=True))]), wanted


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aligned(table(spark, sf_dir, "documents").select("doc_id", "text"))[0]
