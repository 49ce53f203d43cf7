"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained and run in numpy.

A word enters as two vectors: an embedding of its own, and the summed embeddings of its character runs, which are all
trigrams and the starts of up to six characters. A run without white space of more than ``LONGEST`` characters (a text
of a script without spaces, an address, encoded data) is many words: overlapping pieces that share no trigram and miss
none, so every character reaches some window. Texts are cut into windows of 32 words that overlap by 8; all windows of a text are scored and the largest logit counts, mapped
to a probability by a logistic curve.

Training runs on the driver, on a sample with documented bounds: at most ``TOXIC_ROWS`` and ``CLEAN_ROWS`` labelled rows
and ``WINDOWS`` windows, alike many of each text unless it has fewer. The model has embeddings for words and runs that occur in several contexts
of these windows, so its size is bounded by the sample; it is a few MB. Scoring maps over all rows.
A window is labelled like its text in the first pass; later only the ``TOP`` worst windows of a toxic text count, since
most of its windows are harmless, and the loss allows for a share ``NOISE`` of toxic labels that the text doesn't bear out.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from formloom.llm.common import WORD, fresh, table, text_of

WINDOW, STRIDE = 32, 24
TOXIC_ROWS, CLEAN_ROWS, WINDOWS = 1200, 3600, 38_400
WORD_DIMS, GRAM_DIMS, HIDDEN, ATTENTION = 12, 12, 8, 8
PASSES, BATCH, RATE, DECAY = 4, 128, 0.01, 0.002
TOP, NOISE = 2, 0.02
#: Different neighbours that a word or a run needs in the sample for an embedding; rarer ones count as zero.
MIN_CONTEXTS = 8
CUT = 0.3
#: Characters of a word that stays whole, and of each piece of a longer one; pieces overlap by two.
LONGEST, PIECE = 62, 10
#: Characters of text and new words that a task handles at a time, words that a worker remembers, windows of a block.
CHUNK_CHARS, CHUNK_WORDS, CACHE_WORDS, BLOCK = 500_000, 16_384, 100_000, 1024

FIND = re.compile(WORD).findall

Model = dict  # arrays by name, and the numbers of words and runs


def pieces_of(word: str) -> list[str]:
    """A long word in pieces; a space in front or behind tells a cut from an end of the word."""
    step = PIECE - 2
    starts = range(0, len(word) - 2, step)
    return [f"{' ' if i else ''}{word[i : i + PIECE]}{' ' if i + step < len(word) - 2 else ''}" for i in starts]


def words_of(text: str) -> list[str]:
    """The words of a text in order, long ones as their pieces."""
    words = FIND(text)
    if max(map(len, words), default=0) <= LONGEST:
        return words
    return [p for w in words for p in ((w,) if len(w) <= LONGEST else pieces_of(w))]


def plain(word: str) -> str:
    low = word.lower()
    if low[:1] == " " or low[-1:] == " ":
        return low
    return low.strip(".,;:!?\"'()[]{}*#$%&|<>-_") or word


def runs_of(word: str) -> list[str]:
    """Character runs of a word with its ends marked; a piece has marks only where its word ends."""
    own = plain(word)
    own = f"{'' if own[:1] == ' ' else '<'}{own.strip(' ')}{'' if own[-1:] == ' ' else '>'}"
    return [own[i : i + 3] for i in range(max(1, len(own) - 2))] + [own[:n] for n in (4, 5, 6, 7) if n < len(own)]


def features(words: list[str], known: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of each word, and the numbers of the runs of all words with the number of runs of each; 0 is unknown."""
    word_of, run_of = known["word_of"], known["run_of"]
    own, grams, sizes = np.zeros(len(words), np.int64), [], np.zeros(len(words), np.int64)
    for i, w in enumerate(words):
        own[i] = word_of.get(plain(w), 0)
        some = [n for r in runs_of(w) if (n := run_of.get(r))] or [0]
        grams += some
        sizes[i] = len(some)
    return own, np.array(grams, np.int64), sizes


def vocabulary(windows: list[list[str]]) -> tuple[dict[str, int], dict[str, int]]:
    """Numbers, from 1, of the words and of the character runs that occur between ``MIN_CONTEXTS`` pairs of neighbours.

    Copies of a text repeat its neighbours too, so they don't make a chance word look common.
    """
    contexts = Counter(w for _, w, _ in {t for ws in windows for t in zip(["", *ws], ws, [*ws[1:], ""], strict=False)})
    n_word, n_run = Counter(), Counter()
    for w, n in contexts.items():
        n_word[plain(w)] += n
        for r in set(runs_of(w)):
            n_run[r] += n
    return tuple({x: i for i, x in enumerate(sorted(x for x, n in c.items() if n >= MIN_CONTEXTS), start=1)} for c in (n_word, n_run))


def embedded(m: Model, feats) -> np.ndarray:
    own, grams, sizes = feats
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    chars = np.add.reduceat(m["grams"][grams], starts, axis=0) * np.float32(0.3)
    return np.concatenate([m["words"][own], chars], axis=1)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def tanh(x: np.ndarray) -> np.ndarray:
    return 2 * sigmoid(2 * x) - 1


def fresh_model(word_of: dict[str, int], run_of: dict[str, int], seed: int = 7) -> Model:
    rng = np.random.default_rng(seed)
    d, h = WORD_DIMS + GRAM_DIMS, HIDDEN
    normal = lambda *shape, s: (rng.standard_normal(shape) * s).astype(np.float32)
    words, runs = normal(len(word_of) + 1, WORD_DIMS, s=0.1), normal(len(run_of) + 1, GRAM_DIMS, s=0.1)
    words[0] = runs[0] = 0
    return {
        "words": words, "grams": runs,
        "input": normal(d, 6 * h, s=d**-0.5), "bias": np.zeros(6 * h, np.float32), "state": normal(2, h, 3 * h, s=h**-0.5),
        "look": normal(2 * h, ATTENTION, s=(2 * h) ** -0.5), "look_bias": np.zeros(ATTENTION, np.float32), "query": normal(ATTENTION, s=0.5),
        "out": normal(2 * h, s=0.5), "out_bias": np.zeros(1, np.float32),
    }


def forward(m: Model, inputs: np.ndarray, real: np.ndarray, keep: bool = False):
    """Logits of windows; ``inputs`` (window, place, 6 * hidden) are the projected words, ``real`` tells words from filling."""
    n, t, h = len(inputs), inputs.shape[1], HIDDEN
    states, steps = np.zeros((n, t, 2 * h), np.float32), ([], [])
    for way in (0, 1):
        now, u = np.zeros((n, h), np.float32), m["state"][way]
        for i in range(t) if way == 0 else range(t - 1, -1, -1):
            x, s = inputs[:, i, way * 3 * h : (way + 1) * 3 * h], now @ u
            gates = sigmoid(x[:, : 2 * h] + s[:, : 2 * h])
            z, r = gates[:, :h], gates[:, h:]
            g = tanh(x[:, 2 * h :] + r * s[:, 2 * h :])
            if keep:
                steps[way].append((i, now, z, r, g, s[:, 2 * h :]))
            now = now + z * (g - now)
            states[:, i, way * h : (way + 1) * h] = now
    look = tanh(states @ m["look"] + m["look_bias"])
    score = np.where(real, look @ m["query"], np.float32(-1e9))
    share = np.exp(score - score.max(axis=1, keepdims=True))
    share /= share.sum(axis=1, keepdims=True)
    pooled = np.einsum("nt,nth->nh", share, states)
    logit = pooled @ m["out"] + m["out_bias"]
    return (logit, (states, steps, look, share, pooled)) if keep else logit


def backward(m: Model, inputs: np.ndarray, kept, slope: np.ndarray) -> tuple[Model, np.ndarray]:
    """Gradients of all but the embeddings, and of the projected words."""
    states, steps, look, share, pooled = kept
    h, g = HIDDEN, {}
    g["out"], g["out_bias"] = pooled.T @ slope, slope.sum(keepdims=True)
    d_pooled = slope[:, None] * m["out"]
    d_states = share[:, :, None] * d_pooled[:, None, :]
    d_share = np.einsum("nth,nh->nt", states, d_pooled)
    d_score = share * (d_share - (share * d_share).sum(axis=1, keepdims=True))
    g["query"] = np.einsum("nt,nta->a", d_score, look)
    d_look = d_score[:, :, None] * m["query"] * (1 - look * look)
    g["look"], g["look_bias"] = np.einsum("nth,nta->ha", states, d_look), d_look.sum(axis=(0, 1))
    d_states += d_look @ m["look"].T
    d_inputs, g["state"] = np.zeros_like(inputs), np.zeros_like(m["state"])
    for way in (0, 1):
        u, d_now = m["state"][way], np.zeros((len(inputs), h), np.float32)
        for i, before, z, r, c, s in reversed(steps[way]):
            d = d_now + d_states[:, i, way * h : (way + 1) * h]
            d_c = d * z * (1 - c * c)
            d_z, d_r = d * (c - before) * z * (1 - z), d_c * s * r * (1 - r)
            d_sum = np.concatenate([d_z, d_r, d_c * r], axis=1)
            g["state"][way] += before.T @ d_sum
            d_now = d * (1 - z) + d_sum @ u.T
            d_inputs[:, i, way * 3 * h : (way + 1) * 3 * h] = np.concatenate([d_z, d_r, d_c], axis=1)
    return g, d_inputs


def train(windows: list[list[str]], labels: np.ndarray, texts: np.ndarray, seed: int = 7) -> Model:
    """Fit to windows of words; ``texts`` numbers the text of each. Plain Adam on logistic loss, classes weighted alike."""
    number = {w: i for i, w in enumerate(dict.fromkeys(w for ws in windows for w in ws), start=1)}
    known = dict(zip(("word_of", "run_of"), vocabulary(windows), strict=True))
    feats = features(["", *number], known)
    own, grams, sizes = feats
    gram_word = np.repeat(np.arange(len(own)), sizes)
    ids = np.zeros((len(windows), WINDOW), np.int64)
    for k, ws in enumerate(windows):
        ids[k, : len(ws)] = [number[w] for w in ws]
    m, rng = fresh_model(**known, seed=seed), np.random.default_rng(seed)
    mean, square, t = {k: np.zeros_like(v) for k, v in m.items()}, {k: np.zeros_like(v) for k, v in m.items()}, 0
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    use = np.ones(len(ids), bool)
    for turn in range(PASSES):
        if turn:
            scores = score_windows(m, embedded(m, feats) @ m["input"] + m["bias"], ids)
            order = np.lexsort((-scores, texts))
            first = np.concatenate([[0], np.flatnonzero(np.diff(texts[order])) + 1])
            rank = np.empty(len(ids), np.int64)
            rank[order] = np.arange(len(ids)) - np.repeat(first, np.diff([*first, len(ids)]))
            use = (labels == 0) | (rank < TOP)
        weight = np.where(labels == 1, 0.5 / max(1, (use & (labels == 1)).sum()), 0.5 / max(1, (use & (labels == 0)).sum())).astype(np.float32)
        order = rng.permutation(np.flatnonzero(use))
        for a in range(0, len(order), BATCH):
            some = order[a : a + BATCH]
            words, at = np.unique(ids[some], return_inverse=True)
            at = at.reshape(len(some), WINDOW)
            part = np.concatenate([np.arange(starts[w], starts[w] + sizes[w]) for w in words])
            x = embedded(m, (own[words], grams[part], sizes[words]))
            projected = x @ m["input"] + m["bias"]
            inputs, real = projected[at], ids[some] > 0
            logit, kept = forward(m, inputs, real, keep=True)
            p, noise = sigmoid(logit), NOISE if turn else 0.0
            slope = np.where(labels[some] == 1, (noise - 1) * p * (1 - p) / (noise + (1 - noise) * p), p)
            slope = (slope * weight[some] * len(order)).astype(np.float32) / len(some)
            g, d_inputs = backward(m, inputs, kept, slope)
            d_word = np.zeros_like(projected)
            np.add.at(d_word, at.ravel(), d_inputs.reshape(-1, projected.shape[1]))
            g["input"], g["bias"] = x.T @ d_word, d_word.sum(axis=0)
            d_x = d_word @ m["input"].T
            g["words"], g["grams"] = np.zeros_like(m["words"]), np.zeros_like(m["grams"])
            np.add.at(g["words"], own[words], d_x[:, :WORD_DIMS])
            which = np.searchsorted(words, gram_word[part])
            np.add.at(g["grams"], grams[part], (d_x[:, WORD_DIMS:] * np.float32(0.3))[which])
            g["words"][0] = 0
            g["grams"][0] = 0
            g["grams"] += DECAY * m["grams"]
            t += 1
            for k, d in g.items():
                mean[k] += 0.1 * (d - mean[k])
                square[k] += 0.01 * (d * d - square[k])
                m[k] -= RATE * (mean[k] / (1 - 0.9**t) / (np.sqrt(square[k] / (1 - 0.99**t)) + 1e-6)).astype(np.float32)
    scores = score_windows(m, embedded(m, feats) @ m["input"] + m["bias"], ids)
    worst = np.full(texts.max() + 1, -np.inf)
    np.maximum.at(worst, texts, scores)
    told = np.zeros(texts.max() + 1)
    told[texts] = labels
    m["curve"] = np.array(curve(worst, told), np.float64)
    return m | known


def curve(worst: np.ndarray, told: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of the logistic curve from the largest logit of a text to its score.

    Training texts are set wide apart, so their likelihood doesn't tell where between them the curve should rise: it
    crosses 0.5 half-way from where 99 % of the clean ones end to where 90 % of the toxic ones begin.
    """
    clean, toxic = np.quantile(worst[told == 0], 0.99), np.quantile(worst[told == 1], 0.1)
    slope = 8 / max(1.0, toxic - clean)
    return slope, -slope * (clean + toxic) / 2


def squashed(x: np.ndarray, scale: float) -> np.ndarray:
    """1 / (1 + exp(-scale * x)) in place of ``x``."""
    x *= -scale
    np.minimum(x, 60, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def score_windows(m: Model, projected: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The logits of forward() without what training needs: blocks of windows, one place at a time, in small buffers."""
    h, n_places = HIDDEN, ids.shape[1]
    sides = [np.ascontiguousarray(projected[:, :3 * h], np.float32), np.ascontiguousarray(projected[:, 3 * h :], np.float32)]
    out = np.zeros(len(ids), np.float32)
    for a in range(0, len(ids), BLOCK):
        some = np.ascontiguousarray(ids[a : a + BLOCK].T)
        n = some.shape[1]
        states = np.empty((n_places, n, 2 * h), np.float32)
        for way in (0, 1):
            now, u = np.zeros((n, h), np.float32), m["state"][way]
            for i in range(n_places) if way == 0 else range(n_places - 1, -1, -1):
                x, s = sides[way].take(some[i], axis=0), now @ u
                gates = squashed(x[:, : 2 * h] + s[:, : 2 * h], 1.0)
                g = s[:, 2 * h :] * gates[:, h:]
                g += x[:, 2 * h :]
                g = squashed(g, 2.0)
                g *= 2
                g -= 1
                g -= now
                g *= gates[:, :h]
                now = now + g
                states[i, :, way * h : (way + 1) * h] = now
        look = squashed(states.reshape(-1, 2 * h) @ m["look"] + m["look_bias"], 2.0)
        score = ((look @ m["query"]) * 2 - m["query"].sum()).reshape(n_places, n)
        score[some == 0] = -1e9
        score -= score.max(axis=0)
        share = np.exp(score, out=score)
        value = (states.reshape(-1, 2 * h) @ m["out"]).reshape(n_places, n)
        out[a : a + BLOCK] = (share * value).sum(axis=0) / share.sum(axis=0) + m["out_bias"]
    return out


class Scorer:
    """Scores texts of one worker; remembers the projections of words it has seen, within a bound."""

    def __init__(self, model: Model) -> None:
        self.m = model
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.table = np.empty((0, 6 * HIDDEN), np.float32)
        self._add([""])

    def _project(self, words: list[str]) -> np.ndarray:
        return embedded(self.m, features(words, self.m)) @ self.m["input"] + self.m["bias"]

    def _add(self, new: list[str]) -> None:
        start, end = len(self.known), len(self.known) + len(new)
        if end > len(self.table):
            larger = np.empty((max(end, CACHE_WORDS, len(self.table) * 3 // 2), self.table.shape[1]), np.float32)
            larger[:start] = self.table[:start]
            self.table = larger
        for a in range(0, len(new), CHUNK_WORDS):
            some = new[a : a + CHUNK_WORDS]
            self.table[start + a : start + a + len(some)] = self._project(some)
        self.known.update(zip(new, range(start, end), strict=True))

    def ids(self, words: list[str]) -> np.ndarray:
        if len(self.known) > CACHE_WORDS:
            self.forget()
        if new := [w for w in dict.fromkeys(words) if w not in self.known]:
            self._add(new)
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))

    def largest(self, texts: list[str]) -> np.ndarray:
        """The largest logit of each text, -inf for one without words."""
        out = np.full(len(texts), -np.inf)
        self._score(texts, out, np.arange(len(texts)))
        return out

    def _score(self, texts: list[str], out: np.ndarray, at: np.ndarray) -> None:
        words = [words_of(t) for t in texts]
        sizes = np.array([len(w) for w in words])
        if not sizes.any():
            return
        ids = np.append(self.ids([w for ws in words for w in ws]), np.zeros(WINDOW, np.int64))
        begin = np.cumsum(sizes) - sizes
        # All windows of all texts: every STRIDE words, the last one ending with the text; short texts have one.
        many = np.where(sizes > WINDOW, -((WINDOW - sizes) // STRIDE) + 1, (sizes > 0).astype(np.int64))
        owner = np.repeat(np.arange(len(sizes)), many)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
        first = np.minimum(nth * STRIDE, np.maximum(sizes - WINDOW, 0)[owner])
        place = first[:, None] + np.arange(WINDOW)
        windows = np.where(place < sizes[owner][:, None], ids[begin[owner][:, None] + place], 0)
        scores = score_windows(self.m, self.table, windows)
        filled = np.flatnonzero(many)
        out[at[filled]] = np.maximum.reduceat(scores, (np.cumsum(many) - many)[filled])


def _sampled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Up to ``most`` windows of a text, spread evenly over it."""
    for df in batches:
        rows = []
        for toxic, most, text in zip(df["toxic"], df["most"], df["text"], strict=True):
            words = words_of(text)
            if words:
                last = max(0, len(words) - WINDOW)
                starts = sorted({round(s) for s in np.linspace(0, last, min(most, last // STRIDE + 1))})
                rows.append((toxic, ["\n".join(words[s : s + WINDOW]) for s in starts]))
        yield pd.DataFrame(rows, columns=["toxic", "windows"])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def learned(docs: DataFrame, labels: DataFrame, toxic_rows: int = TOXIC_ROWS, clean_rows: int = CLEAN_ROWS) -> Model | float:
    """The model, or a constant score where the labels of the training rows have fewer than two classes."""
    usable = labels.filter(~held_out(F.col("doc_id")) & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = [F.xxhash64(F.col("doc_id").cast("string")), F.col("doc_id")]
    chosen = usable.filter("toxic = 0").orderBy(*order).limit(clean_rows).unionByName(usable.filter("toxic = 1").orderBy(*order).limit(toxic_rows))
    texts = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(chosen), "doc_id")  # a bounded number of rows
    most = min(64, WINDOWS // max(1, chosen.count()))
    rows = texts.select("toxic", F.lit(most).alias("most"), "text").mapInPandas(_sampled, "toxic int, windows array<string>").collect()
    rows.sort(key=lambda r: (r.windows, r.toxic))
    classes = {r.toxic for r in rows}
    if len(classes) < 2:
        return float(classes.pop()) if classes else 0.0
    windows = [w.split("\n") for r in rows for w in r.windows]
    labels_of = np.array([r.toxic for r in rows for _ in r.windows], np.float32)
    return train(windows, labels_of, np.repeat(np.arange(len(rows)), [len(r.windows) for r in rows]))


def lots(column: pa.Array) -> Iterator[pa.Array]:
    """A column of texts in slices of about ``CHUNK_CHARS`` bytes; a longer text is a slice of its own."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(sizes):
        before = int(sizes[start - 1]) if start else 0
        end = max(start + 1, int(np.searchsorted(sizes, before + CHUNK_CHARS, side="right")))
        yield column.slice(start, end - start)
        start = end


def _scores(model, at: int):
    """Rows with a score as the last column; the text is column ``at``, of which only some part is unpacked at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        scorer = None if isinstance(m, float) else Scorer(m)
        for batch in batches:
            scores = [np.zeros(0)]
            for part in lots(batch.column(at)):
                texts = part.to_pylist()
                if scorer is None:
                    score = np.full(len(texts), m)
                else:
                    a, b = m["curve"]
                    score = sigmoid(a * scorer.largest([t or "" for t in texts]) + b)
                    score[[not t or not t.strip(" \t\n\v\f\r") for t in texts]] = 0.0
                scores.append(score)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(scores), pa.float64())], [*batch.schema.names, "c_score"])

    return run


def scored(docs: DataFrame, labels: DataFrame, **options) -> tuple[DataFrame, str]:
    """``docs`` with a score from 0 to 1, and the name of that column.

    Only the text enters a score. Null texts and texts without words score 0. Where the training labels have no toxic
    row, or no clean one, every text with words scores 0 or 1. Rows are only mapped: equal rows and null ids stay, an
    empty table gives an empty result. Of several labels of one id the worst counts; labels other than 0 and 1 don't.
    """
    spark = docs.sparkSession
    (name,) = fresh(docs, "score")
    model = spark.sparkContext.broadcast(learned(docs, labels, **options))
    plain_rows = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)])
    at = docs.columns.index("text")
    if plain_rows.schema[at].dataType.simpleString() != "string":
        plain_rows = plain_rows.withColumn(f"c{len(docs.columns)}", F.col(f"c{at}").cast("string"))
        at = len(docs.columns)
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plain_rows.schema.fields)
    out = plain_rows.mapInArrow(_scores(model, at), f"{fields}, c_score double")
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)], F.col("c_score").alias(name)), name


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, score = scored(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col(score).alias("score"), (F.col(score) >= CUT).cast("int").alias("predicted"))
