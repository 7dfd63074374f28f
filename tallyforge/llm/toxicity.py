"""Toxicity by a bidirectional gated recurrent network with attention, over words and their characters, in numpy."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_sample, discard, materialise, small_batches
from .training import Adam

#: Words of a window and words from one window's start to the next; the last window of a text ends with it.
WINDOW, STRIDE = 32, 16
#: Words whose n-grams are hashed at once.
WORD_BLOCK = 10_000
#: Rows of the word and of the character n-gram embeddings, and their columns; states of a direction; attention units.
WORDS, GRAMS, COLUMNS, STATES, UNITS = 1 << 13, 1 << 14, 8, 8, 8
#: Labelled documents of each class that the network learns from: those of smallest hash, of any length.
SAMPLE = 3000
#: Spans and words of a span: what the network learns of a document with more words than both give, at hashed places.
SPANS, SPAN = 6, 128
EPOCHS, BATCH = 8, 256
#: Windows of each class in an epoch, and windows of clean documents among which it looks for the hardest.
WINDOWS_EACH, SEARCHED = 4000, 20_000


def words_of(text: str | None) -> list[bytes]:
    """Runs of ASCII letters and digits and of bytes beyond ASCII, A-Z lowered."""
    return text.encode("utf-8").lower().translate(_BREAKS).split() if text else []


_BREAKS = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256))


def window_starts(n: int) -> list[int]:
    """Starts of the overlapping windows that cover n words; one for fewer words than a window."""
    return [*range(0, max(1, n - WINDOW), STRIDE), n - WINDOW] if n > WINDOW else [0]


def features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A word row for each word, and the n-gram rows of all words with each word's first; rows by hashes.

    Words are taken in blocks: what is held of a word's characters meanwhile is many times its n-gram rows.
    """
    rows = np.fromiter((xxhash.xxh32_intdigest(w) for w in words), np.int64, len(words)) % WORDS
    gram, sizes = zip(*(_grams(words[i : i + WORD_BLOCK]) for i in range(0, len(words), WORD_BLOCK)), strict=True)
    sizes = np.concatenate(sizes)
    return rows, np.concatenate(gram), np.cumsum(sizes) - sizes


def _grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram rows of all words, in their order, and how many each has."""
    marked = b"".join(b"<" + w + b">" for w in words)
    x = np.frombuffer(marked, np.uint8).astype(np.uint64)
    length = np.fromiter(map(len, words), np.int64, len(words)) + 2
    end = np.cumsum(length)
    left = np.repeat(end, length) - np.arange(len(x))  # characters from here to the word's end
    grams, owner = [], []
    of = np.repeat(np.arange(len(words)), length)
    h = np.zeros(len(x), np.uint64)
    for n in range(1, 6):
        shifted = x[n - 1 :]
        h = h[: len(shifted)] * np.uint64(0x9E3779B97F4A7C15) + shifted + np.uint64(n)
        if n >= 3:
            fits = left[: len(h)] >= n
            mixed = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            grams.append(((mixed >> np.uint64(40)).astype(np.int64)[fits] % GRAMS).astype(np.int32))
            owner.append(of[: len(h)][fits])
    gram, own = np.concatenate(grams), np.concatenate(owner)
    return gram[np.argsort(own, kind="stable")], np.bincount(own, minlength=len(words))


def _means(table: np.ndarray, gram: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The mean row of table of each word's n-grams, word block by word block; zeros for words without any."""
    out, ends = np.zeros((len(first), table.shape[1]), table.dtype), np.append(first, len(gram))
    for i in range(0, len(first), WORD_BLOCK):
        at = ends[i : i + WORD_BLOCK + 1]
        some, counts = gram[at[0] : at[-1]], np.diff(at)
        if len(some):
            sums = np.add.reduceat(table[some], np.minimum(at[:-1] - at[0], len(some) - 1))
            out[i : i + WORD_BLOCK] = np.where(counts[:, None] > 0, sums, 0) / np.maximum(counts, 1)[:, None].astype(table.dtype)
    return out


@dataclass
class GatedNetwork:
    """Gated recurrent states in both directions over a window, pooled by attention, and a logistic output."""

    weights: dict[str, np.ndarray]

    @classmethod
    def fresh(cls, seed: int = 0) -> GatedNetwork:
        rng = np.random.default_rng(seed)
        normal = lambda scale, *shape: (rng.standard_normal(shape) * scale).astype(np.float32)
        w = {"word": normal(0.1, WORDS, COLUMNS), "gram": normal(0.1, GRAMS, COLUMNS), "unit": normal(0.3, 2 * STATES, UNITS), "pick": normal(0.3, UNITS), "out": normal(0.3, 2 * STATES), "bias": np.zeros(1, np.float32)}
        for d in "fb":
            w |= {f"in{d}": normal(0.3, 2 * COLUMNS, 3 * STATES), f"rec{d}": normal(0.3, STATES, 3 * STATES), f"add{d}": np.zeros(3 * STATES, np.float32)}
        return cls(w)

    def inputs(self, rows: np.ndarray, gram: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Of each word, with a row of zeros at the end for places beyond a text."""
        x = np.concatenate([self.weights["word"][rows], _means(self.weights["gram"], gram, first)], axis=1)
        return np.concatenate([x, np.zeros((1, x.shape[1]), x.dtype)])

    def _direction(self, d: str, projected: np.ndarray, at: np.ndarray, trace: list | None = None) -> np.ndarray:
        """States (steps, windows, STATES). projected: what each word adds; at: the words of each window."""
        rec, s = self.weights[f"rec{d}"], STATES
        n, steps = at.shape
        at = np.ascontiguousarray(at.T)
        out, h = np.empty((steps, n, s), np.float32), np.zeros((n, s), np.float32)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            x, u = projected.take(at[t], axis=0), h @ rec
            gates = np.tanh(0.5 * (x[:, : 2 * s] + u[:, : 2 * s])) * 0.5 + 0.5  # update and reset
            z, r = gates[:, :s], gates[:, s:]
            new = np.tanh(x[:, 2 * s :] + r * u[:, 2 * s :])
            if trace is not None:
                trace.append((t, h, z, r, new, u[:, 2 * s :]))
            h = new + z * (h - new)
            out[t] = h
        return out

    def scores(self, x: np.ndarray, at: np.ndarray, block: int = 2048) -> np.ndarray:
        """Probability of each window; blocks keep the states in cache."""
        w = self.weights
        projected = {d: x @ w[f"in{d}"] + w[f"add{d}"] for d in "fb"}
        found = []
        for i in range(0, len(at), block):
            part = at[i : i + block]
            states = np.concatenate([self._direction(d, projected[d], part) for d in "fb"], axis=2)
            found.append(self._pool(states)[0])
        return 1 / (1 + np.exp(-np.concatenate(found)))

    def _pool(self, states: np.ndarray):
        w = self.weights
        units = np.tanh(states @ w["unit"])
        weight = units @ w["pick"]
        weight = np.exp(weight - weight.max(axis=0))
        weight /= weight.sum(axis=0)
        pooled = np.einsum("tn,tns->ns", weight, states)
        return pooled @ w["out"] + w["bias"], units, weight, pooled

    def slopes(self, rows: np.ndarray, gram: np.ndarray, first: np.ndarray, at: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy of windows `at`, back through pooling, both directions and the embeddings."""
        w, s = self.weights, STATES
        x = self.inputs(rows, gram, first)
        traces = {d: [] for d in "fb"}
        states = np.concatenate([self._direction(d, x @ w[f"in{d}"] + w[f"add{d}"], at, traces[d]) for d in "fb"], axis=2)
        logit, units, weight, pooled = self._pool(states)
        g = (1 / (1 + np.exp(-logit)) - y).astype(np.float32) / len(y)
        out = {"out": pooled.T @ g, "bias": np.array([g.sum()], np.float32)}
        g_pooled = g[:, None] * w["out"]
        g_states = weight[:, :, None] * g_pooled
        g_weight = np.einsum("tns,ns->tn", states, g_pooled)
        g_weight = weight * (g_weight - (weight * g_weight).sum(axis=0))
        out["pick"] = np.einsum("tn,tnu->u", g_weight, units)
        g_units = g_weight[:, :, None] * w["pick"] * (1 - units**2)
        out["unit"] = np.einsum("tns,tnu->su", states, g_units)
        g_states = g_states + g_units @ w["unit"].T
        g_x = np.zeros_like(x)
        for k, d in enumerate("fb"):
            g_in, g_rec, g_h = np.zeros((len(x), 3 * s), np.float32), np.zeros_like(w[f"rec{d}"]), np.zeros((len(at), s), np.float32)
            for t, h, z, r, new, u in reversed(traces[d]):
                total = g_h + g_states[t][:, k * s : (k + 1) * s]
                g_new = total * (1 - z) * (1 - new**2)
                g_z = total * (h - new) * z * (1 - z)
                g_r = g_new * u * r * (1 - r)
                g_u = np.concatenate([g_z, g_r, g_new * r], axis=1)
                g_rec += h.T @ g_u
                g_h = total * z + g_u @ w[f"rec{d}"].T
                np.add.at(g_in, at[:, t], np.concatenate([g_z, g_r, g_new], axis=1))
            out |= {f"rec{d}": g_rec, f"add{d}": g_in.sum(axis=0), f"in{d}": x.T @ g_in}
            g_x += g_in @ w[f"in{d}"].T
        out["word"], out["gram"] = np.zeros_like(w["word"]), np.zeros_like(w["gram"])
        np.add.at(out["word"], rows, g_x[:-1, :COLUMNS])
        counts = np.diff(first, append=len(gram))
        np.add.at(out["gram"], gram, np.repeat(g_x[:-1, COLUMNS:] / np.maximum(counts, 1)[:, None], counts, axis=0))
        return out


def _windows(texts: Iterable[list[bytes]]):
    """Distinct words, the words (by number) of every window, and each text's number of windows and words (by number)."""
    place: dict[bytes, int] = {}
    counts, at, each = [], [], []
    for words in texts:
        ids = np.fromiter((place.setdefault(w, len(place)) for w in words), np.int32, len(words))
        each.append(ids)
        if len(ids) < WINDOW:
            ids = np.concatenate([ids, np.full(WINDOW - len(ids), -1, np.int32)])
        starts = np.array(window_starts(len(words)))
        counts.append(len(starts))
        at.append(ids[starts[:, None] + np.arange(WINDOW)])
    return list(place), np.concatenate(at), np.array(counts), each


def _log_odds(seen: list[np.ndarray]) -> np.ndarray:
    """How much oftener toxic texts than others hold a row, as a centred log of smoothed shares."""
    share = [np.log((n + 0.5) / max(1, n.sum())) for n in seen]
    return np.clip(share[1] - share[0], -3, 3) / 3


def training_spans(text: str) -> list[str]:
    """The words of a text; of a long one, SPANS spans of SPAN words at places that its hash picks."""
    words = words_of(text)
    if len(words) <= SPANS * SPAN:
        return [b" ".join(words).decode()]
    rng = np.random.default_rng(xxhash.xxh32_intdigest(text.encode()))
    starts = np.sort(rng.choice(len(words) // SPAN, SPANS, replace=False)) * SPAN
    return [b" ".join(words[i : i + SPAN]).decode() for i in starts]


def train(docs: DataFrame, labels: DataFrame) -> GatedNetwork | None:
    """Fit on labelled documents, at most SAMPLE a class; None without both classes.

    Only ids and labels are joined and sampled; the texts of the sample are fetched by their ids. A document with
    several labels takes the larger; labels other than 0 and 1 do not count; of texts of one id, the least one does.
    Other columns of either table are ignored, whatever their names.
    """
    known = labels.filter(F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    texts = docs.select("doc_id", "text").filter(F.col("text").isNotNull())
    usable = materialise(texts.select("doc_id").join(known, "doc_id").distinct())
    chosen = bounded_sample(usable, F.col("doc_id"), SAMPLE, by=["toxic"])  # at most SAMPLE rows a class
    cut = F.pandas_udf(lambda part: part.map(training_spans), "array<string>")
    sample = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic"))
    sample = sorted((r["spans"], r["toxic"]) for r in sample.select(cut("text").alias("spans"), "toxic").collect())
    discard(usable)
    doc = np.repeat(np.arange(len(sample)), [len(spans) for spans, _ in sample])
    return fit([t for spans, _ in sample for t in spans], np.array([k for _, k in sample], np.int64)[doc], doc)


def fit(sample: list[str], y: np.ndarray, doc: np.ndarray | None = None, seed: int = 0) -> GatedNetwork | None:
    """Train on texts and their labels 0 or 1; None without both classes. doc: which texts are spans of one document.

    A toxic document's label belongs to some of its windows: the first epoch takes any, later ones those that
    score highest in their document. The embeddings' first columns start from log odds of the sample.
    """
    if len(set(y.tolist())) < 2:
        return None
    doc = np.arange(len(sample)) if doc is None else doc
    words, at, counts, each = _windows(map(words_of, sample))
    rows, gram, first = features(words) if words else features([b"-"])
    text_of, network, rng = np.repeat(np.arange(len(sample)), counts), GatedNetwork.fresh(seed), np.random.default_rng(seed)
    owner = doc[text_of]
    at[at < 0] = len(rows)
    n_grams = np.diff(first, append=len(gram))
    used = [np.concatenate([np.zeros(0, np.int32), *(np.unique(ids) for ids, k in zip(each, y, strict=True) if k == label)]) for label in (0, 1)]
    network.weights["word"][:, 0] += _log_odds([np.bincount(rows[u], minlength=WORDS) for u in used])
    seen = [np.zeros(GRAMS, np.int64), np.zeros(GRAMS, np.int64)]
    for k in (0, 1):
        for i in range(0, len(used[k]), 50_000):  # in blocks: all n-grams of all texts are many times their words
            some = used[k][i : i + 50_000]
            sizes = n_grams[some]
            own = np.cumsum(sizes) - sizes
            seen[k] += np.bincount(gram[np.repeat(first[some] - own, sizes) + np.arange(int(sizes.sum()))], minlength=GRAMS)
    network.weights["gram"][:, 0] += _log_odds(seen)
    adam, clean, toxic = Adam(network.weights, 0.01), np.flatnonzero(y[text_of] == 0), np.flatnonzero(y[text_of] == 1)
    for epoch in range(EPOCHS):
        best = toxic
        picked = [rng.choice(clean, min(WINDOWS_EACH, len(clean)), replace=False)]
        if epoch:
            inputs = network.inputs(rows, gram, first)
            p, top = network.scores(inputs, at[toxic]), np.zeros(len(sample))
            np.maximum.at(top, owner[toxic], p)
            best = toxic[p >= np.maximum(top[owner[toxic]] - 1e-9, 0.5 * (epoch > 2))]
            tried = rng.choice(clean, min(SEARCHED, len(clean)), replace=False)
            picked.append(tried[np.argsort(-network.scores(inputs, at[tried]))[: WINDOWS_EACH // 2]])
        if len(best):
            picked.append(rng.choice(best, min(WINDOWS_EACH, 4 * len(best))))
        picked = np.concatenate(picked)
        rng.shuffle(picked)
        for i in range(0, len(picked), BATCH):
            part = at[picked[i : i + BATCH]]
            used, inverse = np.unique(part, return_inverse=True)
            used = used[used < len(rows)]
            sizes = n_grams[used]
            own = np.cumsum(sizes) - sizes
            sub = gram[np.repeat(first[used] - own, sizes) + np.arange(int(sizes.sum()))]
            adam.step(network.slopes(rows[used], sub, own, inverse.reshape(part.shape), y[text_of[picked[i : i + BATCH]]]))
    return network


def scorer(spark: SparkSession, network: GatedNetwork | None):
    """The highest probability of all overlapping windows of a text column.

    Null and empty texts are one window without words; without a network (one class of labels or none) scores are 0.
    """
    small_batches(spark)
    shipped = spark.sparkContext.broadcast(network)

    @F.pandas_udf("double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(text_scores(texts.tolist(), shipped.value))

    return of


def score(docs: DataFrame, network: GatedNetwork | None) -> DataFrame:
    """doc_id and score of every row of docs; repeated rows are scored apart, other columns ignored.

    Equal texts have equal scores, ties of windows change nothing; all windows of a very long text are scored, in
    blocks; an empty table gives no rows.
    """
    return docs.select("doc_id", scorer(docs.sparkSession, network)("text").alias("score"))


def text_scores(texts: list[str | None], network: GatedNetwork | None, limit: int = 300_000) -> np.ndarray:
    out, at, held, size = np.zeros(len(texts)), 0, [], 0
    if network is None:
        return out
    for i, text in enumerate(texts):
        held.append(words_of(text))
        size += len(text or "")
        if size >= limit or i == len(texts) - 1:
            words, spots, counts, _ = _windows(held)
            parts = features(words) if words else features([b"-"])
            p = network.scores(network.inputs(*parts), np.where(spots < 0, len(parts[0]), spots))
            out[at : i + 1] = np.maximum.reduceat(p, np.cumsum(counts) - counts)
            at, held, size = i + 1, [], 0
    return out


def keep_clean(docs: DataFrame, network: GatedNetwork | None, threshold: float = 0.5) -> DataFrame:
    """The rows of docs, with all their columns, that score below threshold."""
    return docs.filter(scorer(docs.sparkSession, network)("text") < threshold)
