"""Ranked lexical search by inverted treaps: one treap a term, in doc_id order with the greatest impact on top."""

from __future__ import annotations

import math
import string
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import dealt, discard, materialise

#: Postings of the documents that are searched at once, and cells (ranges by terms) that a search may hold.
BLOCK, CELLS = 1_000_000, 50_000_000
#: Pairs of item and term that are answered in one reading of the documents, about.
PAIRS = 500_000
#: Ranges that one step of a search splits.
WIDTH = 128
#: Bytes of a text that are cut into terms at once.
SLICE = 4_000_000
# Lower-case letters for A-Z, blanks for bytes that no term holds: ASCII but letters and digits.
_BYTES = bytes(ord(chr(b).lower()) if chr(b) in string.ascii_letters + string.digits or b > 127 else 32 for b in range(128)) + bytes(range(128, 256))


def terms_of(text: bytes) -> Iterator[bytes]:
    """The runs of ASCII letters and digits and of bytes beyond ASCII, A-Z lowered; slices end between terms."""
    at = 0
    while at < len(text):
        end, found = at + SLICE, text[at : at + SLICE].translate(_BYTES)
        if end < len(text):
            while (cut := found.rfind(b" ")) < 0 and end < len(text):  # a term longer than the slice
                found, end = found + text[end : end + SLICE].translate(_BYTES), end + SLICE
            if cut >= 0:
                end, found = at + cut + 1, found[:cut]
        yield from found.split()
        at = end


def postings(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, n (terms of the text with repeats), terms (numbers in the vocabulary) and tfs, for documents that have a term."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            ids, ns, terms, tfs, ends = [], [], [], [], [0]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                counts = Counter(terms_of(text.as_py() or b""))
                if not counts:
                    continue
                hits = [(known[t], c) for t, c in counts.items() if t in known]
                ids.append(doc_id)
                ns.append(counts.total())
                terms.extend(t for t, _ in hits)
                tfs.extend(c for _, c in hits)
                ends.append(len(terms))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(v, t)) for v, t in ((terms, pa.int32()), (tfs, pa.int64()))]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ns, pa.int64()), *lists], names=["doc_id", "n", "terms", "tfs"])

    return dealt(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))).mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<long>")


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


@dataclass
class Treaps:
    """The treaps of a block of documents, as arrays: postings in order of term and place, their children, each term's root.

    A place is a document's rank by doc_id. Equal impacts stand in the order of a hash of the place, which keeps the treaps of
    many copies shallow.
    """

    keys: np.ndarray  # term * places + place
    place: np.ndarray
    impact: np.ndarray
    left: np.ndarray
    right: np.ndarray
    root: np.ndarray
    places: int

    @staticmethod
    def build(term: np.ndarray, place: np.ndarray, impact: np.ndarray, places: int, vocabulary: int) -> Treaps:
        keys = term.astype(np.int64) * places + place
        order = np.argsort(keys, kind="stable")
        keys, place, impact = keys[order], place[order].astype(np.int32), impact[order]
        rank = (impact << 20) | ((place.astype(np.int64) * 2654435761 >> 7) & 0xFFFFF)
        left, right = np.full(len(keys) + 1, -1, np.int32), np.full(len(keys) + 1, -1, np.int32)
        root = np.full(vocabulary, -1, np.int32)
        edges = np.flatnonzero(np.diff(term[order], prepend=-1))
        for start, end in zip(edges, [*edges[1:], len(keys)], strict=True):
            spine, below, after = [], [-1] * (end - start), [-1] * (end - start)
            ranks = rank[start:end].tolist()
            for i, r in enumerate(ranks):
                last = -1
                while spine and ranks[spine[-1]] < r:
                    last = spine.pop()
                if last >= 0:
                    below[i] = start + last
                if spine:
                    after[spine[-1]] = start + i
                spine.append(i)
            left[start:end], right[start:end], root[term[order[start]]] = below, after, start + spine[0]
        return Treaps(keys, np.append(place, 0), np.append(impact, 0), left, right, root, places)

    def settle(self, node: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """For nodes above the ranges low to high, the highest node within: that of the greatest impact, or -1."""
        node, low, high = node.copy(), np.broadcast_to(low, node.shape), np.broadcast_to(high, node.shape)
        out = np.nonzero(node >= 0)
        while len(out[0]):
            at = node[out]
            place = self.place[at]
            over, under = place > high[out], place < low[out]
            at = np.where(over, self.left[at], np.where(under, self.right[at], at))
            node[out] = at
            more = (over | under) & (at >= 0)
            out = tuple(o[more] for o in out)
        return node

    def scores(self, terms: np.ndarray, weights: np.ndarray, places: np.ndarray) -> np.ndarray:
        wanted = terms.astype(np.int64)[None, :] * self.places + places[:, None]
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.impact[at] * weights, 0).sum(axis=1)


class Best:
    """The k best (score, id) so far; a null id comes after all others of its score."""

    def __init__(self, k: int):
        self.k, self.rows = k, []

    def edge(self) -> tuple[int, float]:
        """A document of less than this score, or of this score and a greater id, is not among the best."""
        return (-self.rows[-1][0], self.rows[-1][2]) if len(self.rows) == self.k else (1, math.inf)

    def add(self, rows: list[tuple[int, bool, int]]) -> None:
        self.rows = sorted([*self.rows, *((-s, null, i) for s, null, i in rows)])[: self.k]


def search(treaps: Treaps, terms: np.ndarray, weights: np.ndarray, ids: np.ndarray, nulls: int, best: Best) -> None:
    """Add to `best` the documents of a block that belong there. ids: by place; the last `nulls` of them, the greatest number, are null.

    All terms' treaps are walked at once. A range of places holds, for each term, the top node within it; the sum of their
    weighted impacts bounds the scores in the range. Ranges whose bound cannot enter are dropped; of the others, those of
    the highest bounds are split at their weightiest node's document, which is scored.
    """
    here = treaps.root[terms] >= 0
    terms, weights = terms[here], weights[here]
    if not len(terms):
        return
    low, high, nodes = np.array([0]), np.array([treaps.places - 1]), treaps.root[terms][None, :]
    bound = (treaps.impact[nodes] * weights).sum(axis=1)
    while True:
        score, last = best.edge()
        alive = (bound > score) | ((bound == score) & (ids[low] <= last))
        low, high, nodes, bound = low[alive], high[alive], nodes[alive], bound[alive]
        if not len(low):
            return
        first = np.argpartition(-bound, WIDTH)[:WIDTH] if len(bound) > WIDTH else np.arange(len(bound))
        a, b, tops = low[first], high[first], nodes[first]
        heavy = (treaps.impact[tops] * weights * (tops >= 0)).argmax(axis=1)
        at = treaps.place[tops[np.arange(len(tops)), heavy]].astype(np.int64)
        found = treaps.scores(terms, weights, at)
        enters = (found > score) | ((found == score) & (ids[at] <= last))
        best.add(list(zip(found[enters].tolist(), (at[enters] >= len(ids) - nulls).tolist(), ids[at[enters]].tolist(), strict=True)))
        lows, highs = np.concatenate([a, at + 1]), np.concatenate([at - 1, b])
        full = lows <= highs
        lows, highs = lows[full], highs[full]
        parts = treaps.settle(np.concatenate([tops, tops])[full], lows[:, None], highs[:, None])
        bounds = (treaps.impact[parts] * weights * (parts >= 0)).sum(axis=1)
        rest = np.ones(len(low), bool)
        rest[first] = False
        low, high, nodes, bound = np.concatenate([low[rest], lows]), np.concatenate([high[rest], highs]), np.concatenate([nodes[rest], parts]), np.concatenate([bound[rest], bounds])


def _blocks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Batches joined and cut to at most so many rows, and to BLOCK postings unless one document has more."""
    held, size, n = [], 0, 0
    joined = lambda: pa.Table.from_batches(held).combine_chunks().to_batches()[0]
    for batch in batches:
        ends, at = np.append(0, np.cumsum(pa.compute.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False))), 0
        while at < batch.num_rows:
            to = min(int(np.searchsorted(ends, ends[at] + BLOCK - size, "right")) - 1, at + rows - n, batch.num_rows)
            if to <= at and held:
                yield joined()
                held, size, n = [], 0, 0
                continue
            to = max(to, at + 1)
            held.append(batch.slice(at, to - at))
            size, n, at = size + int(ends[to] - ends[at]), n + to - at, to
    if held:
        yield joined()


def _best(found: DataFrame, items: list[tuple[np.ndarray, np.ndarray]], n_docs: int, n_terms: int, vocabulary: int, k: int) -> DataFrame:
    """item (its number), doc_id, score: of each task, the k best documents of each item."""
    shared = found.sparkSession.sparkContext.broadcast(items)
    rows = max(1, CELLS // max(len(t) for t, _ in items))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(k) for _ in shared.value]
        for block in _blocks(batches, rows):
            doc_id, n, terms, tfs = (block.column(i) for i in range(4))
            if not len(terms.flatten()):
                continue
            ids = doc_id.fill_null(2**63 - 1).to_numpy(zero_copy_only=False)
            order = np.lexsort((doc_id.is_null().to_numpy(zero_copy_only=False), ids))
            places = np.empty(len(order), np.int64)
            places[order] = np.arange(len(order))
            m = 100 - 90 + 90 * n.to_numpy() * n_docs // n_terms
            row = np.repeat(np.arange(len(ids)), pa.compute.list_value_length(terms).to_numpy())
            tf = tfs.flatten().to_numpy()
            treaps = Treaps.build(terms.flatten().to_numpy(), places[row], 1_000_000_000 * tf // (1000 * tf + 8 * m[row]), len(ids), vocabulary)
            for (wanted, weights), top in zip(shared.value, best, strict=True):
                search(treaps, wanted, weights, ids[order], doc_id.null_count, top)
        some = [(i, None if null else doc_id, -score) for i, top in enumerate(best) for score, null, doc_id in top.rows]
        if some:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*some, strict=True)], names=["item", "doc_id", "score"])

    return found.mapInArrow(run, "item long, doc_id long, score long")


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score: the k documents of the highest score above 0 for each item; equal scores by id, null ids last.

    A document's postings of the items' terms are written once; counts of documents, terms and postings over all of them
    give the weights. Each task then builds the treaps of its own blocks of documents, searches all items in them, and
    returns its k best of each; the last ranking is over those. Blocks by document need no shuffle of postings, so a
    term of any frequency spreads over all tasks. Items are answered in groups of about PAIRS terms, a reading each.

    Null and empty texts have no terms, and neither documents nor items without terms are in the result. Rows of one item id
    (null too) are one item with the terms of all; repeated documents rank each by itself; very long texts are cut in slices,
    whole; empty tables give no rows; columns other than ids and texts are ignored, whatever their names.
    """
    spark = docs.sparkSession

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.select(["number", "text"]).to_pylist():
                terms = pa.array(sorted(set(terms_of(row["text"] or b""))), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([row["number"]] * len(terms), pa.int64()), terms], names=["number", "term"])

    # A number in place of the id, whatever its type; rows of one id have one number.
    named = items.select("item_id").distinct().withColumn("number", F.monotonically_increasing_id())
    named = materialise(named)
    texts = items.select("item_id", F.col("text").cast("binary").alias("text")).join(named.withColumnRenamed("item_id", "id"), F.col("item_id").eqNullSafe(F.col("id"))).select("number", "text")
    pairs = materialise(texts.mapInArrow(cut, "number long, term binary").distinct())
    groups = -(-pairs.count() // PAIRS)
    out = None
    for g in range(groups):
        mine: dict[int, list[bytes]] = {}
        for r in pairs.filter(F.pmod(F.xxhash64("number"), F.lit(groups)) == g).collect():
            mine.setdefault(r["number"], []).append(bytes(r["term"]))
        if not mine:
            continue
        vocabulary = {t: i for i, t in enumerate(sorted(set().union(*mine.values())))}
        found = materialise(postings(docs, vocabulary))
        n_docs, n_terms = found.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = dict(found.select(F.explode("terms").alias("term")).groupBy("term").count().collect())
        weights = np.array([weight(n_docs, df.get(i, 0)) for i in range(len(vocabulary))], np.int64)
        numbers = sorted(mine)
        wanted = [np.array(sorted(vocabulary[t] for t in mine[i]), np.int64) for i in numbers]
        if not n_docs:
            continue
        top = _best(found, [(t, weights[t]) for t in wanted], n_docs, n_terms, len(vocabulary), k)
        known = spark.createDataFrame(list(enumerate(numbers)), "item long, number long")
        top = top.join(known, "item").select("number", "doc_id", "score")
        rank = F.row_number().over(Window.partitionBy("number").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
        top = materialise(top.withColumn("rank", rank).filter(F.col("rank") <= k))
        discard(found)
        out = top if out is None else out.unionByName(top)
    if out is None:
        return items.select("item_id", F.lit(1).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).limit(0)
    return out.join(named, "number").select("item_id", "rank", "doc_id", "score")
