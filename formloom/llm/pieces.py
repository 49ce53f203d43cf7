"""SentencePiece encoding and decoding by batched numpy Viterbi.

The text gets a leading space, spaces become U+2581, and it is cut before each run of them; no piece crosses such a
cut. Different words are encoded once per worker: words of one length form a matrix and advance together, character
by character. Hashes of all their substrings probe the sorted hashes of the pieces; then, for each prefix, the best
last piece is kept as backpointer.

The pieces of the model come from byte-pair merges, so a path isn't scored by a sum. Merging leaves exactly one path
in which no two neighbours would have merged otherwise; a step scores 1 if its pair of pieces can stand side by side
and 0 if not, and the maximum over the last pieces of a prefix is the one path that merging makes. Ids are therefore
the same as those of the public library. Characters without a piece become byte pieces.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formloom.llm.common import fresh, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Characters of text that are handled at a time, cells of a word matrix, words that a worker remembers.
CHUNK_CHARS, MATRIX_CELLS, CACHE_WORDS = 1_000_000, 100_000, 400_000
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
FILTER_BITS = 20


@dataclass(frozen=True)
class Pieces:
    """Tables of one model; their size is that of the piece list, some ten thousand rows."""

    pieces: list[bytes]  # what each id decodes to
    byte_base: int  # id of the piece of byte 0
    rank: np.ndarray  # order in which merges make a piece; -1 for single characters and unknown ones
    left: np.ndarray
    right: np.ndarray
    pair_keys: np.ndarray  # sorted left * width + right of pairs that merge
    pair_ranks: np.ndarray
    hashes: np.ndarray  # sorted hashes of pieces
    hash_ids: np.ndarray
    longest: int
    spaces: dict[int, int]  # ids of runs of spaces by length

    @property
    def unknown(self) -> int:
        return len(self.pieces)


def _merged(chars: list[str], rank: dict[str, int]) -> list[str]:
    """Plain pairwise merging, for single pieces and runs of spaces only."""
    parts = list(chars)
    while len(parts) > 1:
        best = min(((rank.get(a + b, 1 << 40), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))))
        if best[0] == 1 << 40:
            break
        i = best[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts


def _hash(codes: np.ndarray) -> np.ndarray:
    """Polynomial hash of the rows, modulo 2**64."""
    h = np.zeros(len(codes), np.uint64)
    for j in range(codes.shape[1]):
        h = h * MULTIPLIER + codes[:, j].astype(np.uint64) + np.uint64(1)
    return h


def _matrix(words: list[str], length: int) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), length)


def load(model_file: str = MODEL) -> Pieces:
    """Read a piece file on the driver; all tables follow from its list of pieces and scores."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    n = model.get_piece_size()
    names = [model.id_to_piece(i) for i in range(n)]
    special = {i for i in range(n) if model.is_control(i) or model.is_unknown(i) or model.is_unused(i)}
    in_bytes = [i for i in range(n) if model.is_byte(i)]
    if len(in_bytes) != 256:
        raise ValueError("the model has no byte pieces")
    plain = [i for i in range(n) if i not in special and not model.is_byte(i)]
    if any(a != SPACE and b == SPACE for i in plain for a, b in zip(names[i], names[i][1:], strict=False)):
        raise ValueError("a piece crosses the start of a word")
    runs = {len(names[i]): i for i in plain if set(names[i]) == {SPACE}}
    words = [i for i in plain if len(names[i]) == 1 or set(names[i]) != {SPACE}]
    if any(names[i].startswith(SPACE * 2) for i in words):
        raise ValueError("a piece joins several spaces and other characters")
    order = sorted((i for i in words if len(names[i]) > 1), key=lambda i: (-model.get_score(i), i))
    by_name = {names[i]: k for k, i in enumerate(order)}
    ids = {names[i]: i for i in words}
    rank, left, right = (np.full(n + 1, -1, np.int64) for _ in range(3))
    reached = []
    for k, i in enumerate(order):
        last, name = {}, names[i]
        earlier = {s: r for a in range(len(name)) for b in range(a + 2, len(name) + 1) if (r := by_name.get(s := name[a:b], k)) < k}
        last = _merged(list(name), earlier)
        if len(last) == 2 and last[0] in ids and last[1] in ids:
            rank[i], left[i], right[i] = k, ids[last[0]], ids[last[1]]
            reached.append(i)
    usable = {names[i]: i for i in [*reached, *(i for i in words if len(names[i]) == 1)]}
    pairs = sorted(
        (usable[name[:j]] * (n + 1) + usable[name[j:]], int(rank[i]))
        for i in reached for name in [names[i]] for j in range(1, len(name)) if name[:j] in usable and name[j:] in usable
    )
    hashes = np.array([_hash(_matrix([name], len(name)))[0] ^ np.uint64(len(name)) for name in usable], np.uint64)
    at = np.argsort(hashes)
    if len(np.unique(hashes)) != len(hashes):
        raise ValueError("two pieces have one hash")
    decoded = [b"" if i in special else names[i].replace(SPACE, " ").encode() for i in range(n)]
    for byte, i in enumerate(in_bytes):
        decoded[i] = bytes([byte])
    return Pieces(
        decoded, in_bytes[0], rank, left, right, np.array([p[0] for p in pairs], np.int64), np.array([p[1] for p in pairs], np.int64),
        hashes[at], np.array(list(usable.values()), np.int64)[at], max(map(len, usable)), runs,
    )


class Encoder:
    """Encodes words of one worker; remembers words and pairs it has seen, within fixed bounds."""

    def __init__(self, pieces: Pieces) -> None:
        self.p = pieces
        self.width = np.int64(len(pieces.pieces) + 1)
        self.near = np.zeros(1 << FILTER_BITS, bool)
        self.near[pieces.hashes >> np.uint64(64 - FILTER_BITS)] = True
        self.pair_seen = np.full(1 << 18, -1, np.int64)
        self.pair_fits = np.zeros(1 << 18, bool)
        self.runs: dict[int, list[int]] = {}
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []
        self.starts = np.zeros(1, np.int64)

    def space_run(self, k: int) -> list[int]:
        """Ids of ``k`` spaces; runs all have one score, so the leftmost pair merges first."""
        if k not in self.runs:
            one = self.p.spaces[1]
            self.runs[k] = [self.p.spaces.get(len(s), one) for s in _merged([SPACE] * k, {SPACE * m: 0 for m in self.p.spaces if m > 1})] if k else []
        return self.runs[k]

    def fits(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging leaves piece a beside piece b.

        Seen backwards, merges are undone from the last to the first; at each moment the two parts at the border must
        not have had a merge that comes before the one undone last.
        """
        keys = a * self.width + b
        slot = (keys * 0x9E3779B1 >> 7) & (len(self.pair_seen) - 1)
        out = self.pair_fits[slot]
        todo = np.flatnonzero(self.pair_seen[slot] != keys)
        if not len(todo):
            return out
        p = self.p
        x, y, limit = a[todo].copy(), b[todo].copy(), np.full(len(todo), 1 << 40, np.int64)
        good, live = np.ones(len(todo), bool), np.arange(len(todo))
        while len(live):
            xs, ys = x[live], y[live]
            at = np.minimum(np.searchsorted(p.pair_keys, xs * self.width + ys), len(p.pair_keys) - 1)
            crossed = (p.pair_keys[at] == xs * self.width + ys) & (p.pair_ranks[at] < limit[live])
            good[live[crossed]] = False
            rx, ry = p.rank[xs], p.rank[ys]
            go = ~crossed & ((rx >= 0) | (ry >= 0))
            undo_x = go & (rx > ry)
            undo_y = go & ~undo_x
            limit[live[undo_x]], x[live[undo_x]] = rx[undo_x], p.right[xs[undo_x]]
            limit[live[undo_y]], y[live[undo_y]] = ry[undo_y] + 1, p.left[ys[undo_y]]
            live = live[go]
        out[todo] = good
        self.pair_seen[slot[todo]], self.pair_fits[slot[todo]] = keys[todo], good
        return out

    def paths(self, words: list[str], length: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of one length, one after the other, and the number of ids of each."""
        p, n, most = self.p, len(words), min(self.p.longest, length)
        codes = _matrix(words, length)
        prefix, power = np.zeros((n, length + 1), np.uint64), 1
        for j in range(length):
            prefix[:, j + 1] = prefix[:, j] * MULTIPLIER + codes[:, j].astype(np.uint64) + np.uint64(1)
        # piece[:, end, size - 1]: id of the substring of that size and end, or -1
        piece = np.full((n, length + 1, most), -1, np.int32)
        for size in range(1, most + 1):
            power = power * int(MULTIPLIER) % (1 << 64)
            h = (prefix[:, size:] - prefix[:, :-size] * np.uint64(power)) ^ np.uint64(size)
            row, end = np.nonzero(self.near[h >> np.uint64(64 - FILTER_BITS)])
            probe = h[row, end]
            at = np.minimum(np.searchsorted(p.hashes, probe), len(p.hashes) - 1)
            hit = p.hashes[at] == probe
            piece[row[hit], end[hit] + size, size - 1] = p.hash_ids[at[hit]]
        lone = piece[:, 1:, 0]
        lone[lone < 0] = p.unknown
        last, back = np.full((n, length + 1), -1, np.int64), np.zeros((n, length + 1), np.int64)
        for i in range(1, length + 1):
            row, less = np.nonzero(piece[:, i, : min(i, most)] >= 0)
            new, start = piece[row, i, less].astype(np.int64), i - 1 - less
            score = (start == 0) | self.fits(last[row, start], new)
            row, new, less = row[score], new[score], less[score]
            last[row, i], back[row, i] = new, less + 1
        taken, at, rows = np.full((n, length), -1, np.int64), np.full(n, length), np.arange(n)
        while len(rows):
            here = at[rows]
            taken[rows, here - 1] = last[rows, here]
            at[rows] = here - back[rows, here]
            rows = rows[at[rows] > 0]
        row, place = np.nonzero(taken >= 0)
        ids = taken[row, place]
        counts = np.ones(len(ids), np.int64)
        if (unknown := np.flatnonzero(ids == p.unknown)).size:
            spelt = [chr(c).encode("utf-8", "surrogatepass") for c in codes[row[unknown], place[unknown]].tolist()]
            counts[unknown] = [len(b) for b in spelt]
            out = np.repeat(ids, counts)
            out[out == p.unknown] = np.frombuffer(b"".join(spelt), np.uint8).astype(np.int64) + p.byte_base
            ids = out
        return ids.astype(np.int32), np.bincount(row, weights=counts, minlength=n).astype(np.int64)

    def learn(self, words: list[str]) -> None:
        """Encode words that aren't known yet. Each starts with at least one space; further ones are set apart."""
        by_length: dict[int, list[str]] = {}
        for w in words:
            by_length.setdefault(len(w), []).append(w)
        for length, group in by_length.items():
            step = max(1, MATRIX_CELLS // length)
            for a in range(0, len(group), step):
                part = group[a : a + step]
                single = [SPACE + w.lstrip(SPACE) for w in part]
                if all(map(str.__eq__, single, part)):
                    ids, sizes = self.paths(part, length)
                else:
                    told = []
                    for w, s in zip(part, single, strict=True):
                        spaces, (own, _) = len(w) - len(s), self.paths([s], len(s))
                        if spaces and own[0] == self.p.spaces[1]:
                            spaces, own = spaces + 1, own[1:]
                        told.append(np.concatenate([np.array(self.space_run(spaces), np.int32), own]))
                    ids, sizes = np.concatenate(told), np.array([len(t) for t in told], np.int64)
                self.known.update(zip(part, range(len(self.known), len(self.known) + len(part)), strict=True))
                self.flat.append(ids)
                self.sizes.append(sizes)
        if len(self.flat) == 1:
            self.starts = np.concatenate([[0], np.cumsum(self.sizes[0])])

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after the other, and where those of each word end."""
        if len(self.known) > CACHE_WORDS:
            self.forget()
        if new := [w for w in dict.fromkeys(words) if w not in self.known]:
            self.learn(new)
        if len(self.flat) > 1:
            self.flat, self.sizes = [np.concatenate(self.flat)], [np.concatenate(self.sizes)]
            self.starts = np.concatenate([[0], np.cumsum(self.sizes[0])])
        which = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        sizes, first = self.sizes[0][which], self.starts[which]
        ends = np.cumsum(sizes)
        return self.flat[0][np.arange(ends[-1]) - np.repeat(ends - sizes - first, sizes)], ends


WORD = re.compile(f"{SPACE}+[^{SPACE}]*")


def cuts(text: str) -> Iterator[list[str]]:
    """Words of a text in lists of bounded size, cut between words."""
    spaced = SPACE + text.replace(" ", SPACE)
    at = 0
    while at < len(spaced):
        end = spaced.find(SPACE, at + CHUNK_CHARS)
        while end > 0 and spaced[end - 1] == SPACE:
            end = spaced.find(SPACE, end + 1)
        end = len(spaced) if end < 0 else end
        yield WORD.findall(spaced, at, end)
        at = end


def encode_texts(encoder: Encoder, texts: list[str]) -> list[np.ndarray]:
    """Ids of each text. Words of many texts are encoded together, a bounded number of characters at a time."""
    found: list[list[np.ndarray]] = [[] for _ in texts]
    words: list[str] = []
    parts: list[tuple[int, int]] = []  # text, words of it in the present lot
    size = 0

    def flush() -> None:
        nonlocal size
        ids, ends = encoder.encode(words)
        word = piece = 0
        for text, n in parts:
            word += n
            end = int(ends[word - 1])
            found[text].append(ids[piece:end])
            piece = end
        words.clear()
        parts.clear()
        size = 0

    for k, text in enumerate(texts):
        for some in cuts(text) if text else ():
            words += some
            parts.append((k, len(some)))
            size += sum(map(len, some)) if len(text) > CHUNK_CHARS else len(text)
            if size >= CHUNK_CHARS:
                flush()
    if words:
        flush()
    none = np.zeros(0, np.int32)
    return [own[0] if len(own) == 1 else np.concatenate([none, *own]) for own in found]


def decode_ids(pieces: list[bytes], ids: np.ndarray) -> str:
    """The text of ids; the space that encoding put in front goes, bytes that aren't UTF-8 become U+FFFD."""
    text = b"".join(map(pieces.__getitem__, ids.tolist())).decode("utf-8", "replace")
    return text[1:] if text[:1] == " " else text


def _with_ids(pieces):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoded = Encoder(pieces.value), pieces.value.pieces
        base = pieces.value.byte_base
        for batch in batches:
            ids, sizes, in_bytes, same = [], [], [], []
            texts = batch.column(batch.num_columns - 1).to_pylist()
            for text, own in zip(texts, encode_texts(encoder, texts), strict=True):
                ids.append(own)
                sizes.append(len(own))
                in_bytes.append(int(np.count_nonzero((own >= base) & (own < base + 256))))
                same.append(text is None or decode_ids(decoded, own) == text)
            flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
            offsets = pa.array(np.concatenate([[0], np.cumsum(np.array(sizes, np.int64))]).astype(np.int32))
            lists = pa.ListArray.from_arrays(offsets, pa.array(flat, pa.int32()))
            columns = [*batch.columns[:-1], pa.array(sizes, pa.int64()), pa.array(in_bytes, pa.int64()), lists, pa.array(same, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, [f"c{i}" for i in range(len(columns))])

    return run


def encoded(docs: DataFrame, model_file: str = MODEL) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` without text, with n_tokens, n_byte_tokens, token_ids and round_trip; also the names of these columns.

    ``round_trip`` tells whether decoding the ids gives the text again; it doesn't where the text has the space
    sign U+2581 itself. Null and empty texts have no ids. Rows are only mapped: equal rows and null ids stay, an
    empty table gives an empty result, columns with the added names keep theirs.
    """
    spark = docs.sparkSession
    names = fresh(docs, "n_tokens", "n_byte_tokens", "token_ids", "round_trip")
    others = [c for c in docs.columns if c != "text"]
    plain = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(others)], F.col("text").cast("string").alias("text"))
    fields = [f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(plain.schema.fields[:-1])]
    k = len(others)
    schema = ", ".join([*fields, f"c{k} bigint", f"c{k + 1} bigint", f"c{k + 2} array<int>", f"c{k + 3} boolean"])
    out = plain.mapInArrow(_with_ids(spark.sparkContext.broadcast(load(model_file))), schema)
    wanted = [*others, *names]
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(wanted)]), dict(zip(("n_tokens", "n_byte_tokens", "token_ids", "round_trip"), names, strict=True))


def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents").select("doc_id", "text"))[0]
