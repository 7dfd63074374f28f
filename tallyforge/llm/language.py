"""Language identification by a byte convolutional network, trained in numpy on labelled text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, slices
from .training import Adam, softmax

#: Bytes of a window; a text is cut into windows without gaps, and the last is filled with spaces.
WINDOW = 256
WIDTHS, FILTERS, EMBEDDING = (2, 3, 4), 8, 8
#: Labelled documents of each language that the network learns from: those of smallest hash. Of each it learns all
#: windows, or so many that are spread evenly over its whole text.
SAMPLE, WINDOWS_EACH = 500, 64
EPOCHS, BATCH = 8, 128


def windows_of(text: bytes) -> np.ndarray:
    n = max(1, -(-len(text) // WINDOW))
    return np.frombuffer(text.ljust(n * WINDOW, b" "), np.uint8).reshape(n, WINDOW)


@dataclass
class ByteNetwork:
    """Embedded bytes, filters of several widths, the largest response of each in a window, softmax."""

    languages: list[str]
    weights: dict[str, np.ndarray]

    @classmethod
    def fresh(cls, languages: list[str], seed: int = 0) -> ByteNetwork:
        rng = np.random.default_rng(seed)
        normal = lambda *shape: (rng.standard_normal(shape) * 0.3).astype(np.float32)
        weights = {"embedding": normal(256, EMBEDDING), "out": normal(len(WIDTHS) * FILTERS, len(languages)), "bias": np.zeros(len(languages), np.float32)}
        for w in WIDTHS:
            weights |= {f"filter{w}": normal(w, EMBEDDING, FILTERS), f"bias{w}": np.zeros(FILTERS, np.float32)}
        return cls(languages, weights)

    def tables(self) -> dict[int, np.ndarray]:
        """What each byte adds to a filter at each of its places: an embedding and a product, looked up by byte."""
        return {w: np.einsum("be,pef->pbf", self.weights["embedding"], self.weights[f"filter{w}"]) for w in WIDTHS}

    def _pooled(self, x: np.ndarray, tables: dict[int, np.ndarray], where: bool = False):
        tops, places, x = [], [], x.astype(np.intp)
        for w in WIDTHS:
            n = x.shape[1] - w + 1
            response = tables[w][0].take(x[:, :n], axis=0)
            for p in range(1, w):
                response += tables[w][p].take(x[:, p : p + n], axis=0)
            if where:
                places.append(response.argmax(axis=1))
            tops.append(response.max(axis=1) + self.weights[f"bias{w}"])
        return np.maximum(np.concatenate(tops, axis=1), 0), places

    def probabilities(self, x: np.ndarray, tables: dict[int, np.ndarray] | None = None, block: int = 64) -> np.ndarray:
        """Of each language, for each window. Blocks keep the responses in cache."""
        tables = tables or self.tables()
        tops = [self._pooled(x[i : i + block], tables)[0] for i in range(0, len(x), block)]
        return softmax(np.concatenate(tops) @ self.weights["out"] + self.weights["bias"])

    def fit(self, x: np.ndarray, y: np.ndarray, seed: int = 0) -> None:
        rng, adam = np.random.default_rng(seed), Adam(self.weights, 0.01)
        for _ in range(EPOCHS):
            order = rng.permutation(len(x))
            for i in range(0, len(x), BATCH):
                rows = order[i : i + BATCH]
                adam.step(self._slopes(x[rows], y[rows]))

    def _slopes(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        pooled, places = self._pooled(x, self.tables(), where=True)
        error = softmax(pooled @ self.weights["out"] + self.weights["bias"])
        error[np.arange(len(y)), y] -= 1
        error /= len(y)
        slopes = {"out": pooled.T @ error, "bias": error.sum(axis=0), "embedding": np.zeros_like(self.weights["embedding"])}
        back = (error @ self.weights["out"].T) * (pooled > 0)
        rows = np.arange(len(x))[:, None]
        for k, w in enumerate(WIDTHS):
            g = back[:, k * FILTERS : (k + 1) * FILTERS]
            slopes[f"bias{w}"] = g.sum(axis=0)
            slopes[f"filter{w}"] = np.zeros_like(self.weights[f"filter{w}"])
            for p in range(w):  # only the place of each filter's largest response has a slope
                seen = np.zeros((256, FILTERS), np.float32)
                np.add.at(seen, (x[rows, places[k] + p], np.arange(FILTERS)[None, :]), g)
                slopes[f"filter{w}"][p] = self.weights["embedding"].T @ seen
                slopes["embedding"] += seen @ self.weights[f"filter{w}"][p].T
        return slopes


def train(labelled: DataFrame) -> ByteNetwork | None:
    """Fit on `text` and `lang` of at most SAMPLE documents a language, those of smallest hash; None without any."""
    usable = labelled.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & (F.length("text") > 0))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"], strict=True):
                windows = windows_of(text.encode("utf-8"))
                spread = np.unique(np.linspace(0, len(windows) - 1, min(WINDOWS_EACH, len(windows))).astype(np.int64))
                yield pd.DataFrame({"lang": lang, "window": [w.tobytes() for w in windows[spread]]})

    chosen = bounded_sample(usable, F.col("doc_id"), SAMPLE, by=["lang"]).select("lang", "text")
    sample = chosen.mapInPandas(cut, "lang string, window binary").distinct().collect()
    if not sample:
        return None
    languages = sorted({r["lang"] for r in sample})
    pairs = sorted((bytes(r["window"]), languages.index(r["lang"])) for r in sample)
    network = ByteNetwork.fresh(languages)
    network.fit(np.frombuffer(b"".join(w for w, _ in pairs), np.uint8).reshape(-1, WINDOW), np.array([y for _, y in pairs]))
    return network


def identify(docs: DataFrame, network: ByteNetwork | None) -> DataFrame:
    """doc_id, lang_pred, score for every row: the language of largest mean probability over all windows.

    Null texts, texts without a letter, and all texts if nothing could be learnt are `und` with score 0. Of equally
    probable languages, the first by name is predicted. Repeated rows are scored apart; all windows of a very long
    text count; an empty table gives no rows; other columns are ignored, whatever their names.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(network)

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shipped.value
        tables = model.tables() if model else None
        for part in slices(batches, "text", 1_000_000):
            known = np.array([bool(model) and t is not None and any(map(str.isalpha, t)) for t in part["text"]])
            lang, score = np.full(len(part), "und", object), np.zeros(len(part))
            if known.any():
                blocks = [windows_of(t.encode("utf-8")) for t in part["text"][known]]
                counts = np.array([len(b) for b in blocks])
                each = model.probabilities(np.concatenate(blocks), tables)
                mean = np.add.reduceat(each, np.cumsum(counts) - counts) / counts[:, None]
                lang[known] = np.array(model.languages, object)[mean.argmax(axis=1)]
                score[known] = np.minimum(1, mean.max(axis=1))
            yield pd.DataFrame({"doc_id": part["doc_id"], "lang_pred": lang, "score": score})

    named = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    out = named.mapInPandas(predict, "doc_id string, lang_pred string, score double")
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))
