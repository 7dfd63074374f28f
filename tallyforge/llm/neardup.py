"""Near-duplicates by bottom-k sketches of one hash function, confirmed on full shingle sets."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise, slices, unused, with_uid
from .components import connected_components, roots

#: Values of a sketch, the least hashes of a set's shingles.
SKETCH = 64
#: Chance at most that sketches of two similar sets share fewer values than they must. Sets of SKETCH at most are exact.
MISS = 1e-15
#: Words whose hashes a task remembers before it begins anew, and characters of texts that are cut into words at once; a
#: longer text stays whole. Both bound what a worker holds: a word takes some 200 bytes, a remembered one as many.
REMEMBERED, SLICE = 50_000, 500_000
#: Rows of two or three numbers up to which a side is broadcast (some 30 MB); beyond, Spark shuffles both.
BROADCAST_ROWS = 1_000_000
#: Rounds in which lists of several components first compare all members with one pivot.
PIVOT_ROUNDS = 1
#: Members of a list outside its largest component, above which it is split by the next values that a pair must share,
#: and the most values of a key.
HOT, LEVELS = 256, 3


def least_overlap(similarity: float, size: int = SKETCH) -> int:
    """Values that sketches of `size` share but for a chance of MISS, the shared ones being at least binomial."""
    total = 0.0
    for t in range(size + 1):
        total += math.comb(size, t) * similarity**t * (1 - similarity) ** (size - t)
        if total > MISS:
            return t
    return size


class Shingler:
    """Sorted distinct 64-bit hashes of the word shingles of texts. Words: bytes between ASCII white space, A-Z lowered."""

    def __init__(self, width: int):
        self.width, self.known = width, {}

    def _hashes(self, words: list[bytes]) -> np.ndarray:
        if len(self.known) > REMEMBERED:
            self.known = {}
        known = self.known
        for w in {w for w in words if w not in known}:
            known[w] = xxhash.xxh3_64_intdigest(w)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))

    def sets(self, texts: list[str | None]) -> list[np.ndarray]:
        words = [t.encode("utf-8").lower().split() if t else [] for t in texts]
        hashes = self._hashes([w for ws in words for w in ws])
        sets, at = [], 0
        spread = self._mix(hashes, self.width)
        for ws in words:
            n = len(ws)
            if n >= self.width:
                sets.append(np.unique(spread[at : at + n - self.width + 1]))
            elif n:
                sets.append(self._mix(hashes[at : at + n], n))
            else:
                sets.append(np.zeros(0, np.int64))
            at += n
        return sets

    @staticmethod
    def _mix(hashes: np.ndarray, width: int) -> np.ndarray:
        """A hash of each run of `width` neighbours, which depends on their order and number."""
        n = len(hashes) - width + 1
        if n <= 0:
            return np.zeros(0, np.int64)
        x = np.full(n, width, np.uint64)
        for j in range(width):
            x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + hashes[j : j + n]
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return (x ^ (x >> np.uint64(31))).view(np.int64)


def _sketch_rows(batches: Iterator[pd.DataFrame], width: int) -> Iterator[pd.DataFrame]:
    """The rows of _sketches(), from rows of doc_id, mark and text."""
    shingler = Shingler(width)
    for part in slices(batches, "text", SLICE):
        sets = shingler.sets(part["text"].tolist())
        digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
        yield pd.DataFrame({"doc_id": part["doc_id"], "mark": part["mark"], "n_shingles": [len(s) for s in sets], "digest": digests, "sketch": [s[:SKETCH] for s in sets]})


def _sketches(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, mark, n_shingles, digest of the set (null if empty), sketch, for each row."""

    named = docs.select(F.col("doc_id").cast("string").alias("doc_id"), _mark().alias("mark"), "text")
    out = named.mapInPandas(lambda batches: _sketch_rows(batches, width), "doc_id string, mark string, n_shingles long, digest binary, sketch array<long>")
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def _mark() -> Column:
    """With the id, the key of a row, but for repeated ones: 128 bits of its text."""
    return F.md5(F.col("text").cast("binary"))


def _full_sets(docs: DataFrame, width: int, wanted: DataFrame) -> DataFrame:
    """node, shingles (sorted) of the wanted classes (node, digest, least_id)."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler = Shingler(width)
        for part in slices(batches, "text", SLICE):
            sets = [s for s in shingler.sets(part["text"].tolist()) if len(s)]
            yield pd.DataFrame({"digest": [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], "shingles": sets})

    texts = docs.select("doc_id", "text").join(_small(wanted.select(F.col("least_id").alias("doc_id")).distinct()), "doc_id", "left_semi")
    sets = texts.select("text").mapInPandas(make, "digest binary, shingles array<long>")
    return sets.join(_small(wanted.select("digest", "node")), "digest").select("node", "shingles").dropDuplicates(["node"])


def _small(df: DataFrame) -> DataFrame:
    """df, of two or three numbers a row, marked for broadcasting if it has BROADCAST_ROWS at most."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _met(spread: DataFrame) -> DataFrame:
    """node, n and met (often, value), rarest first, from node, n, value: the values that others have too.

    Counts are written, so that the join is between plain exchanges, which AQE splits at a hot value.
    """
    often = materialise(spread.groupBy("value").agg(F.count("*").alias("often")).filter("often > 1"))
    return spread.join(often, "value").groupBy("node", "n").agg(F.array_sort(F.collect_list(F.struct("often", "value"))).alias("met"))


def _likely(classes: DataFrame, percent: int) -> DataFrame:
    """node of the classes whose sketches share enough with others, together, for one similar class.

    Sketches of at most SKETCH are whole sets, of which a similar one shares its part surely.
    """
    met = _met(classes.select("node", "n", F.explode("sketch").alias("value")))
    needed = F.when(F.col("n") <= SKETCH, _sure(F.col("n"), percent)).otherwise(least_overlap(percent / 100))
    return met.filter(F.size("met") >= needed).select("node")


def _sure(n: Column, percent: int) -> Column:
    """Values that a sketch of a set of at most SKETCH shares with that of any similar set.

    The set shares percent of itself; of the other set, others can push at most (1 / similarity - 1) * n out of the sketch.
    """
    similarity = percent / 100
    return F.least(F.ceil(n * F.lit(similarity) - 1e-9), F.floor(F.lit(SKETCH) - n * F.lit(1 / similarity - 1)))


def _prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """node, n, shared, spare, prefix: each class's values that others have, rarest first; written.

    A similar class shares percent of a set, so the two meet in the first `spare` values, and share c values in the
    first spare + c - 1. Ranking by frequency leaves common passages out of these. Classes that share too little go.
    """
    met = _met(sets.select("node", F.size("shingles").alias("n"), F.explode("shingles").alias("value")))
    spare = (F.size("met") - F.ceil(F.col("n") * percent / 100 - 1e-9) + 1).cast("int")
    kept = met.withColumn("spare", spare).filter("spare > 0")
    return materialise(kept.select("node", "n", F.size("met").alias("shared"), "spare", F.slice(F.col("met.value"), F.lit(1), F.col("spare") + LEVELS - 1).alias("prefix")))


def _inverted(prefixes: DataFrame) -> DataFrame:
    """value, node, n, shared, at, left: the lists under which similar classes meet; left: values from here on."""
    each = prefixes.select("node", "n", "shared", F.posexplode(F.slice("prefix", F.lit(1), F.col("spare"))).alias("at", "value"))
    return each.select("value", "node", "n", "shared", "at", (F.col("shared") - F.col("at")).alias("left"))


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose union sketch may reach the similarity, and whose full sets do; written."""
    least = least_overlap(percent / 100)
    first = F.slice("shingles", 1, SKETCH)
    left = sets.select(F.col("node").alias("a"), first.alias("x"), F.size("shingles").alias("n"))
    right = sets.select(F.col("node").alias("b"), first.alias("y"), F.size("shingles").alias("m"))
    near = left.join(_small(pairs), "a").join(right, "b")
    union = F.slice(F.array_sort(F.array_union("x", "y")), 1, SKETCH)
    agreed = F.size(F.array_intersect(F.array_intersect(union, F.col("x")), F.col("y")))
    of = F.least(F.lit(SKETCH), F.size(F.array_union("x", "y")))
    # Two sketches that are whole sets decide exactly; their union may be longer than a sketch, so it is not cut.
    small = (F.col("n") <= SKETCH) & (F.col("m") <= SKETCH)
    exact = F.size(F.array_intersect("x", "y")) * 100 >= F.size(F.array_union("x", "y")) * percent
    near = materialise(near.filter(F.when(small, exact).otherwise(agreed >= F.least(F.lit(least), of))).select("a", "b"))
    full = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")).join(_small(near), "b")
    full = full.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a")
    common = F.size(F.array_intersect("x", "y"))
    full = full.withColumn("common", common).filter(F.col("common") * 100 >= (F.size("x") + F.size("y") - F.col("common")) * percent)
    found = materialise(full.select("a", "b"))
    discard(near)
    return found


def _components(docs: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, mark, n_shingles, digest) and, for each digest of a row with an id, its component's least id."""
    drafts = materialise(with_uid(_sketches(docs, width)))
    linked = drafts.filter(F.col("digest").isNotNull() & F.col("doc_id").isNotNull())
    sketched = linked.groupBy("digest").agg(F.min("uid").alias("node"), F.min("doc_id").alias("least_id"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"))
    sketched = materialise(sketched)
    rows, classes = materialise(drafts.drop("sketch", "uid")), materialise(sketched.select("digest", "node", "least_id"))
    discard(drafts)
    wanted = materialise(_likely(sketched, percent).join(classes, "node"))
    discard(sketched)
    sets = materialise(_full_sets(docs, width, wanted))
    prefixes = _prefixes(sets, percent)
    lists = materialise(_inverted(prefixes))

    # The first pairs lead from each class to one of a smaller rank, so the confirmed ones are trees.
    first, shared = _first_pairs(lists, percent)
    labels = roots(_confirmed(first, sets, percent).select(F.col("b").alias("node"), F.col("a").alias("parent")))
    for turn in range(1, PIVOT_ROUNDS + 2):
        # Lists of one component are done with: each turn goes on with fewer.
        many = lists if turn > 1 else lists.join(shared, "value", "left_semi")
        labelled = many.select("value", "node", "n", "shared", "at", "left").join(_small(labels.select("node", F.col("root").alias("component"))), "node", "left")
        labelled = materialise(labelled.withColumn("component", F.coalesce("component", "node")))
        mixed = materialise(_mixed(labelled))
        discard(lists)
        lists = materialise(labelled.join(mixed, "value"))
        discard(labelled)
        if lists.isEmpty():
            break
        last = turn > PIVOT_ROUNDS
        pairs = materialise(_all_pairs(lists, prefixes, percent) if last else _pivot_pairs(lists, turn, percent))
        found = _confirmed(pairs, sets, percent)
        root = lambda side: _small(labels.select(F.col("node").alias(side), F.col("root").alias(f"{side}_root")))  # noqa: B023, E731
        between = found.join(root("a"), "a", "left").join(root("b"), "b", "left").select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b"))
        between = materialise(between.filter("a <> b").distinct())
        if not between.isEmpty():
            merged = materialise(connected_components(between))
            known = labels.union(merged.select("node", F.col("node").alias("root")).join(labels, "node", "left_anti"))
            labels = materialise(known.join(merged.select(F.col("node").alias("root"), "component"), "root", "left").select("node", F.coalesce("component", "root").alias("root")))
        if last:
            break
    for t in (lists, sets, prefixes):
        discard(t)
    joined = classes.join(_small(labels), "node", "left").withColumn("root", F.coalesce("root", "node"))
    joined = materialise(joined.select("digest", "least_id", "root"))
    least = joined.groupBy("root").agg(F.min("least_id").alias("component_id"), F.count("*").alias("k"))
    # Only components of several classes have another least id than their one class's.
    several = materialise(least.filter("k > 1").drop("k"))
    named = joined.join(_small(several), "root", "left").select("digest", F.coalesce("component_id", "least_id").alias("component_id"))
    return rows, materialise(named)


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, for every row of docs.

    Sets are distinct shingles of `width` words (all words, if fewer). Equal sets make a class; classes that
    share `percent` of their union are linked, and a component is what links reach. component_id is its smallest
    doc_id; kept marks that document. Empty and null texts, and null ids, are components of their own (with a
    null component_id for a null id, which is kept); repeated rows share a component; an empty table gives no rows;
    a very long text is one set, however large; other columns are ignored, whatever their names.

    Classes that share enough of their sketches with others go on with their full sets. Candidates meet in inverted
    lists of their rarest shared values; a pair must be able to share enough from its first shared value on. A list
    does not yield all its pairs: first each class is compared with one pivot, the most shared class of its lists,
    which joins groups of copies. Then only pairs of different components count: a few more pivots are tried, and
    what remains is compared with all outside a list's largest component, so that no link between components is
    lost. Lists that are still long are split by the next value that a pair must share.
    """
    rows, named = _components(docs, width, percent)
    out = rows.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("digest")).alias("digest")).join(named, "digest", "left")
    out = out.withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _fits(percent: int, c: int = 1) -> Column:
    """Sizes n and m, and what both can still share from the c-th value that they share on, allow the similarity."""
    similarity = percent / 100
    sizes = (F.col("n") * 100 >= F.col("m") * percent) & (F.col("m") * 100 >= F.col("n") * percent)
    need = F.ceil((F.col("n") + F.col("m")) * F.lit(similarity / (1 + similarity)) - 1e-9)
    return sizes & (F.least("left", "right") + (c - 1) >= need)


def _first_pairs(lists: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """One pair (pivot a, member b) for each class: of its lists' most shared classes, the one of least rank; written.

    And the values of lists with more than one class.
    """
    rank = F.struct((-F.col("shared")).alias("rank"), "node", "n", "left")
    best = materialise(lists.groupBy("value").agg(F.min(rank).alias("p"), F.count("*").alias("k")).filter("k > 1").drop("k"))
    met = lists.join(best, "value").filter("p.node <> node").withColumn("m", F.col("p.n")).withColumn("right", F.col("p.left")).filter(_fits(percent))
    return materialise(met.groupBy("node").agg(F.min("p").alias("p")).select(F.col("p.node").alias("a"), F.col("node").alias("b"))), best.select("value")


def _mixed(lists: DataFrame) -> DataFrame:
    """value, largest (component) and others (rows outside it) of the lists of several components."""
    sizes = lists.groupBy("value", "component").agg(F.count("*").alias("k"))
    each = sizes.groupBy("value").agg(F.max(F.struct("k", "component")).alias("x"), F.sum("k").alias("total"))
    return each.select("value", F.col("x.component").alias("largest"), (F.col("total") - F.col("x.k")).alias("others")).filter("others > 0")


def _other(rows: DataFrame) -> DataFrame:
    """One side of a pair, with names of its own."""
    return rows.select("value", F.col("node").alias("a"), F.col("n").alias("m"), F.col("component").alias("d"), F.col("left").alias("right"))


def _between(lists: DataFrame, others: DataFrame, percent: int, c: int = 1) -> DataFrame:
    """Pairs (a, b) of different components and fitting sizes that meet in a list."""
    met = lists.select("value", F.col("node").alias("b"), "n", "component", "left").join(others, "value").filter(_fits(percent, c) & (F.col("component") != F.col("d")))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _pivot_pairs(lists: DataFrame, turn: int, percent: int) -> DataFrame:
    """Each member of a list with the list's pivot, chosen by a hash of the turn outside the largest component."""
    rank = F.struct(F.xxhash64("node", F.lit(turn)).alias("rank"), "node", "n", "component", "left")
    best = materialise(lists.filter("component <> largest").groupBy("value").agg(F.min(rank).alias("p")).select("value", "p.*"))
    return _between(lists, _other(best), percent)


def _all_pairs(lists: DataFrame, prefixes: DataFrame, percent: int) -> DataFrame:
    """All pairs of a list between components: one of the two is outside the list's largest component.

    So a list makes at most HOT pairs a row. One with more outside is split: its pairs also share a next value, and
    meet under the hash of both.
    """
    pairs = None
    for c in range(1, LEVELS + 1):
        cool = lists if c == LEVELS else lists.filter(F.col("others") <= HOT)
        some = _between(cool, _other(cool.filter("component <> largest")), percent, c)
        pairs = some if pairs is None else pairs.union(some)
        hot = lists.filter(F.col("others") > HOT)
        if c == LEVELS or hot.isEmpty():
            break
        # The next value is behind this one, and in the first spare + c values.
        behind = hot.join(prefixes.select("node", "spare", "prefix"), "node").withColumn("from", F.col("at") + 1)
        room = F.least(F.size("prefix"), F.col("spare") + c) - F.col("from")
        each = behind.filter(room > 0).select("value", "node", "n", "shared", "component", "from", F.posexplode(F.slice("prefix", F.col("from") + 1, room)).alias("k", "next"))
        each = each.select(F.xxhash64("value", "next").alias("value"), "node", "n", "shared", (F.col("from") + F.col("k")).alias("at"), "component")
        each = materialise(each.withColumn("left", F.col("shared") - F.col("at")))
        lists = materialise(each.join(materialise(_mixed(each)), "value"))
        discard(each)
    return pairs.distinct()


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, with all their columns, of which one of each component of near_duplicates() stays.

    It is that of the smallest id and, among texts of one id, of the least hash; of repeated rows, one stays. Rows
    without words, and with a null id, all stay. A document is known by its id and text, not by its id alone.
    """
    rows, named = _components(docs, width, percent)
    linked = rows.filter(F.col("digest").isNotNull() & F.col("doc_id").isNotNull())
    keys = materialise(linked.groupBy("doc_id", "mark", "digest").agg(F.count("*").alias("k")).join(named, "digest").drop("digest"))
    kept = keys.groupBy("component_id").agg(F.min(F.struct("doc_id", "mark")).alias("m")).select("m.*", F.lit(True).alias("stays"))
    marked = materialise(keys.join(kept, ["doc_id", "mark"], "left"))
    id_, mark = unused(docs, "__id", "__mark")
    keyed = lambda test: marked.filter(test).select(F.col("doc_id").alias(id_), F.col("mark").alias(mark))
    dropped, again = keyed("stays is null"), keyed("stays and k > 1")
    same = (F.col("doc_id") == F.col(id_)) & (_mark() == F.col(mark))
    out = docs.join(_small(dropped), same, "left_anti")
    if again.isEmpty():
        return out
    repeated = docs.join(_small(again), same).dropDuplicates([id_, mark]).select(docs.columns)
    return out.join(_small(again), same, "left_anti").unionByName(repeated)
