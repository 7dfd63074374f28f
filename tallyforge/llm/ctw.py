"""Language-model scores by context-tree weighting over bytes, with word counts beside it."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, slices, with_uid

#: Preceding bytes of the deepest context, and the classes in which contexts see a byte: each by itself.
DEPTH, CLASSES = 5, 256
_CLASS = np.arange(256)
#: Depth of the nodes that the driver weights, of which there is a fixed number, and of the contexts that tasks are dealt by.
TOP, DEALT = 2, 3
#: Contexts of one byte, for tables of all cells.
CONTEXTS = CLASSES
#: Byte after a text's last; no UTF-8 text holds it. Contexts before a text's first byte see it too.
END = 255
#: Cells whose trees are weighted at once, which bounds a task's memory; contexts of DEALT bytes stay whole.
BLOCK = 200_000
#: Words whose counts are sent to every task: the most frequent. The counts of all others are joined.
FREQUENT = 200_000
#: Cells whose scores are sent to every task: the most frequent. The scores of all others are joined.
FREQUENT_CELLS = 500_000
#: Different words, and cells, that a task counts before it passes the counts on.
HELD, HELD_CELLS = 300_000, 3_000_000


def cells(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The cell of every byte of texts that each end with END, and each text's first place.

    A cell is a number of DEPTH + 1 bytes: the context, newest byte first, and the byte that follows it.
    """
    pad = b"\xff" * DEPTH  # contexts do not reach into the text before
    x = np.frombuffer(b"".join(pad + t + b"\xff" for t in texts), np.uint8)
    size = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    first = np.cumsum(size) - size
    wide = x.astype(np.int64)
    cell = wide[DEPTH:].copy()
    for back in range(1, DEPTH + 1):
        cell |= wide[DEPTH - back : len(x) - back] << (8 * (DEPTH + 1 - back))
    own = np.ones(len(cell), bool)
    starts = (first + DEPTH * np.arange(len(texts)))[1:]  # of the padding, less DEPTH below
    for j in range(DEPTH):
        own[starts - DEPTH + j] = False
    return cell[own], first


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """By Stirling's series at x + 6."""
    y = x + 6
    shift = np.log(x) + np.log(x + 1) + np.log(x + 2) + np.log(x + 3) + np.log(x + 4) + np.log(x + 5)
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) - shift


def _log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log probability that Krichevsky and Trofimov's estimator gives a sequence of so many zeros and ones."""
    return _log_gamma(zeros + 0.5) + _log_gamma(ones + 0.5) - math.log(math.pi) - _log_gamma(zeros + ones + 1.0)


class Trees:
    """Nodes of the trees of one level of choices, for sorted cells of contexts of `depth` bytes, up to `floor` bytes.

    A byte is eight binary choices, each with a tree of contexts of its own. A node is a number: its context, newest
    byte first, then the `level` bits that were chosen. A node's probability is half its own estimator's and half the
    product of its children's; the deepest have their own estimator's only, or half of that and half of `below`.
    """

    def __init__(self, cell: np.ndarray, n: np.ndarray, level: int, depth: int, floor: int, below: np.ndarray | None = None):
        self.level, self.bit = level, (cell >> (7 - level)) & 1
        node = cell >> (8 - level)
        new = np.flatnonzero(np.diff(node, prepend=-1))
        self.at = np.cumsum(np.diff(node, prepend=-1) != 0) - 1  # each cell's node
        node = node[new]
        ones = np.bincount(self.at, n * self.bit, len(node))
        zeros = np.bincount(self.at, n, len(node)) - ones
        self.layers = []  # deepest first: node, zeros, ones, log probability, share of its own estimate, each child's parent
        for _ in range(depth, floor - 1, -1):
            alone = _log_kt(zeros, ones)
            if below is None:
                own, share = alone, np.ones(len(node))
            else:
                own = np.logaddexp(alone, below) - math.log(2)
                share = np.exp(np.minimum(0, alone - math.log(2) - own))
            up, parent = np.unique(((node >> (level + 8)) << level) | (node & ((1 << level) - 1)), return_inverse=True)
            self.layers.append((node, zeros, ones, own, share, parent))
            below, zeros, ones = (np.bincount(parent, a, len(up)) for a in (own, zeros, ones))
            node = up
        self.up, self.below = node, below  # the nodes above `floor`, and what their children's probabilities multiply to

    def spread(self, mixed: np.ndarray, remaining: np.ndarray, passed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """From the state of the nodes in `up` to that of the deepest: the estimates mixed so far, the share that
        remains, and the last estimate, which a node that was never seen takes over."""
        for _, zeros, ones, _, share, parent in reversed(self.layers):
            mixed, remaining, passed = mixed[parent], remaining[parent], passed[parent]
            passed = np.where(zeros + ones > 0, (ones + 0.5) / (zeros + ones + 1), passed)
            mixed, remaining = mixed + remaining * share * passed, remaining * (1 - share)
        return mixed, remaining, passed

    def log10(self, mixed: np.ndarray) -> np.ndarray:
        """log10 probability of each cell's choice, from that of a one in its node."""
        p = mixed[self.at]
        return np.log10(np.where(self.bit == 1, p, 1 - p))


#: The state above the root: nothing mixed, all remaining, a half as the estimate.
_ABOVE = (np.zeros(1), np.ones(1), np.full(1, 0.5))


def weighted_tree(counts: np.ndarray) -> np.ndarray:
    """log10 probability of each byte in each context of one byte, from counts (contexts, 256) of all cells."""
    cell, out = np.arange(counts.size), np.zeros(counts.size)
    for level in range(8):
        trees = Trees(cell, counts.ravel(), level, 1, 1)
        whole = np.bincount(trees.layers[0][5], trees.layers[0][3])
        root = Trees(np.arange(256), counts.sum(axis=0), level, 0, 0, whole)
        out += trees.log10(trees.spread(*root.spread(*(np.repeat(a, 1 << level) for a in _ABOVE)))[0])
    return out.reshape(counts.shape)


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sorted cells and their counts in blocks of about BLOCK, which do not cut a context of DEALT bytes."""
    parts = [(b["cell"].to_numpy(), b["n"].to_numpy()) for b in batches]
    if not parts:
        return
    cell, n = (np.concatenate(a) for a in zip(*parts, strict=True))
    order = np.argsort(cell)
    cell, n = cell[order], n[order]
    edges = np.flatnonzero(np.diff(cell >> (8 * (DEPTH + 1 - DEALT)), prepend=-1))
    cuts = edges[np.flatnonzero(np.diff(edges // BLOCK, prepend=-1))]
    for i, j in zip(cuts, [*cuts[1:], len(cell)], strict=True):
        yield cell[i:j], n[i:j]


def _shorter(cell: np.ndarray, depth: int) -> np.ndarray:
    """The cells with only the `depth` newest bytes of their contexts."""
    return ((cell >> (8 * (DEPTH + 1 - depth))) << 8) | (cell & 255)


def _weighted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """level, node, value: of each node of TOP bytes the product of its children's (as logs), and at level 8 the cells' counts."""
    for cell, n in _blocks(batches):
        top, at = np.unique(_shorter(cell, TOP), return_inverse=True)
        yield pd.DataFrame({"level": 8, "node": top, "value": np.bincount(at, n)})
        for level in range(8):
            trees = Trees(cell, n, level, DEPTH, DEALT)
            yield pd.DataFrame({"level": level, "node": trees.up, "value": trees.below})


def _top_states(rows: pd.DataFrame) -> list[tuple[np.ndarray, ...]]:
    """For each level the nodes of TOP bytes, sorted, and their states, from the sums of what _weighted() gives."""
    each = {k: g.sort_values("node") for k, g in rows.groupby("level")}
    cell, n = (each[8][c].to_numpy() for c in ("node", "value")) if each else (np.zeros(0, np.int64), np.zeros(0))
    states = []
    for level in range(8) if each else ():
        trees = Trees(cell, n, level, TOP, 0, each[level]["value"].to_numpy())
        # What is above the root are the chosen bits alone.
        states.append((trees.layers[0][0], *trees.spread(*(np.repeat(a, len(trees.up)) for a in _ABOVE))))
    return states


def _cell_scores(counted: DataFrame) -> DataFrame:
    """cell, n, score (log10 probability) of the cells; written.

    Subtrees of contexts of DEALT bytes are weighted in tasks, what is above them on the driver: nodes of TOP bytes,
    at most 256^TOP * 256 whatever the corpus. Then the estimates are mixed down the same subtrees.
    """
    dealt = counted.repartition(F.shiftright("cell", 8 * (DEPTH + 1 - DEALT)))
    sums = dealt.mapInPandas(_weighted, "level int, node long, value double").groupBy("level", "node").agg(F.sum("value").alias("value"))
    states = counted.sparkSession.sparkContext.broadcast(_top_states(sums.toArrow().to_pandas()))

    def down(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for cell, n in _blocks(batches):
            score = np.zeros(len(cell))
            for level in range(8):
                trees = Trees(cell, n, level, DEPTH, DEALT)
                node, *state = states.value[level]
                at = np.searchsorted(node, trees.up)
                score += trees.log10(trees.spread(*(a[at] for a in state))[0])
            yield pd.DataFrame({"cell": cell, "n": n, "score": score})

    return materialise(dealt.mapInPandas(down, "cell long, n long, score double"))


class CellTable:
    """Scores of cells by a multiplicative hash: one cell a slot, the most frequent of those that meet."""

    def __init__(self, cell: np.ndarray, n: np.ndarray, score: np.ndarray):
        self.bits = max(4, (4 * len(cell)).bit_length())
        self.cell, self.score = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits)
        order = np.argsort(n, kind="stable")
        slot = self._slots(cell[order])
        self.cell[slot], self.score[slot] = cell[order], score[order]  # the last of a slot stays

    def _slots(self, cell: np.ndarray) -> np.ndarray:
        return ((cell.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).view(np.int64)

    def find(self, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each cell is here, and its score, or 0."""
        slot = self._slots(cell)
        here = self.cell.take(slot) == cell
        return here, self.score.take(slot) * here


def _count(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """word, n of every word of the rows that are learnt from, and cell, n of every cell of all rows; written.

    Both come from one pass: rows of words have a null cell. Each task passes on sums. Cells that only other rows
    hold have n = 0: they weigh nothing in the trees, which then score them with the others.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, parts = Counter(), []
        for part in slices(batches, "text", 1_000_000):
            for learnt, rows in part.groupby("learnt"):
                texts = [t.encode("utf-8").lower() for t in rows["text"].fillna("")]
                cell, n = np.unique(cells(texts)[0], return_counts=True)
                parts.append((cell, n if learnt else np.zeros_like(n)))
                if learnt:
                    for t in texts:
                        words.update(t.split())
            if len(words) > HELD:
                yield pd.DataFrame({"word": [w.decode("utf-8") for w in words], "cell": None, "n": list(words.values())})
                words = Counter()
            if sum(len(c) for c, _ in parts) > HELD_CELLS:
                parts = [merged(parts)]
                if len(parts[0][0]) > HELD_CELLS // 2:
                    yield from passed(*parts.pop())
        if words:
            yield pd.DataFrame({"word": [w.decode("utf-8") for w in words], "cell": None, "n": list(words.values())})
        if parts:
            yield from passed(*merged(parts))

    def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        cell, n = (np.concatenate(a) for a in zip(*parts, strict=True))
        order = np.argsort(cell)
        cell = cell[order]
        first = np.flatnonzero(np.diff(cell, prepend=-1))
        return cell[first], np.add.reduceat(n[order], first)

    def passed(cell: np.ndarray, n: np.ndarray) -> Iterator[pd.DataFrame]:
        for i in range(0, len(cell), 200_000):
            yield pd.DataFrame({"word": None, "cell": cell[i : i + 200_000], "n": n[i : i + 200_000]})

    partial = docs.select("text", "learnt").mapInPandas(count, "word string, cell long, n long")
    total = materialise(partial.groupBy("word", "cell").agg(F.sum("n").alias("n")))
    return total.filter("word is not null").select("word", "n"), total.filter("cell is not null").select("cell", "n")


def _frequent(words: DataFrame, limit: int) -> int:
    """The least count such that at most `limit` words reach it, from counts in 16 steps a doubling."""
    step = F.floor(F.log2("n") * 16)
    steps = words.groupBy(step.alias("step")).agg(F.count("*").alias("k"), F.min("n").alias("least")).orderBy(F.desc("step")).collect()
    total, least = 0, None
    for r in steps:
        total += r["k"]
        if total > limit:
            break
        least = r["least"]
    return least if least is not None else (steps[0]["least"] + 1 if steps else 1)


def score_documents(docs: DataFrame, learns) -> DataFrame:
    """All columns of the contract for each row of docs; `learns` is the condition on rows that are learnt from.

    Words are bytes between ASCII white space, A-Z lowered, then an end. base_score: add-one log10 probability of
    the words. score: log10 probability of the text's bytes and its end by the trees of contexts of up to DEPTH whole
    bytes; code length is -score / log10(2) bits. Null text: empty, its end alone. Repeated rows are scored apart;
    nothing learnt: the trees give each bit a half. Counts cover all learnt rows, and the cells grow with them. A very
    long text is scored whole, ties of frequency change no score, an empty table gives no rows, and other columns are
    ignored, whatever their names.
    """
    spark = docs.sparkSession
    training = docs.filter(learns)
    words, counted = _count(docs.select("text", F.coalesce(learns, F.lit(False)).alias("learnt")))
    sums = words.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    ends = training.count()
    total, distinct = int(sums["n"] or 0) + ends, int(sums["v"]) + (ends > 0)
    scores = _cell_scores(counted)
    often = scores.filter(F.col("n") >= _frequent(scores.filter("n > 0"), FREQUENT_CELLS)).toArrow()
    frequent_cells = spark.sparkContext.broadcast(CellTable(*(often[c].to_numpy() for c in ("cell", "n", "score"))))
    least = _frequent(words, FREQUENT)
    common = words.filter(F.col("n") >= least).toArrow()
    frequent = spark.sparkContext.broadcast({w.encode("utf-8"): n for w, n in zip(common["word"].to_pylist(), common["n"].to_pylist(), strict=True)})
    log_of = math.log10(total + distinct + 1)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table, known = frequent_cells.value, {w: math.log10(n + 1) for w, n in frequent.value.items()}
        for part in slices(batches, "text", 1_000_000):
            texts = [t.encode("utf-8").lower() for t in part["text"].fillna("")]
            place, first = cells(texts)
            here, found_log = table.find(place)
            away = np.flatnonzero(~here)
            away = np.split(place[away], np.searchsorted(away, first[1:]))
            rows = []
            for t in texts:
                found = t.split()
                hits = [known[w] for w in found if w in known]
                rest = Counter(w for w in found if w not in known) if len(hits) < len(found) else {}
                rows.append((len(found) + 1, len(hits), sum(hits), [{"word": w.decode("utf-8"), "n": n} for w, n in rest.items()]))
            out = pd.DataFrame(rows, columns=["n_tokens", "common", "common_log", "rest"])
            out["score"], out["cells"] = np.add.reduceat(found_log, first), away
            yield part[["uid", "doc_id", "held_out"]].reset_index(drop=True).join(out)

    named = with_uid(docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text", (~learns).alias("held_out")))
    kind = "uid long, doc_id string, held_out boolean, n_tokens long, common long, common_log double, rest array<struct<word:string,n:long>>, score double, cells array<long>"
    scored = materialise(named.select("uid", "doc_id", "held_out", "text").mapInPandas(score, kind))
    rest = scored.select("uid", F.inline("rest")).withColumnRenamed("n", "k")
    # The frequent words are known to every task, so the others meet only the counts below theirs.
    met = rest.join(words.filter(F.col("n") < least), "word").groupBy("uid").agg(F.sum("k").alias("rare"), F.sum(F.col("k") * F.log10(F.col("n") + 1)).alias("rare_log"))
    # The cells that the table has no slot for meet the scores of all cells.
    rare = scored.select("uid", F.explode("cells").alias("cell")).join(scores.select("cell", F.col("score").alias("cell_log")), "cell").groupBy("uid").agg(F.sum("cell_log").alias("cell_log"))
    end_log, zero = math.log10(ends + 1), F.lit(0).cast("long")
    return scored.drop("rest", "cells").join(met, "uid", "left").join(rare, "uid", "left").select(
        F.col("doc_id").cast("long").alias("doc_id"),
        "held_out",
        "n_tokens",
        (F.col("common") + F.coalesce("rare", zero) + int(ends > 0)).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("common_log") + F.coalesce("rare_log", F.lit(0.0)) + end_log - F.col("n_tokens") * F.lit(log_of)).alias("base_score"),
        (F.col("score") + F.coalesce("cell_log", F.lit(0.0))).alias("score"),
    )
