"""Sharding by a k-d tree over metadata, cut at distributed weighted medians."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, with_uid

#: Bins of one refinement pass. A pass sends at most shards x BINS rows to the driver, whatever the input.
BINS = 1024
#: A cut may miss its weighted median by this share of a leaf's target; nearer only if one row spans the median.
TOLERANCE = 0.0005


@dataclass
class _Node:
    """A cell of the tree: shards first .. first + count - 1. Once cut, left and right are set."""

    first: int
    count: int
    dim: str = ""
    value: int = 0
    uid: int | None = None  # None: ties on value all go left
    left: _Node | None = None
    right: _Node | None = None
    # search state
    low: int = 0
    high: int = 0
    below: float = 0
    target: float = 0
    tied: bool = field(default=False)

    def cut(self, value: int, uid: int | None) -> None:
        self.value, self.uid = value, uid
        half = self.count // 2
        self.left, self.right = _Node(self.first, half), _Node(self.first + half, self.count - half)


def _descend(node: _Node, leaf) -> Column:
    """The tree as one nested conditional; leaf(node) is the value in a cell that is not cut."""
    if node.left is None:
        return leaf(node)
    goes_left = F.col(node.dim) <= node.value
    if node.uid is not None:
        goes_left = (F.col(node.dim) < node.value) | ((F.col(node.dim) == node.value) & (F.col("uid") <= node.uid))
    return F.when(goes_left, _descend(node.left, leaf)).otherwise(_descend(node.right, leaf))


def _leaves(node: _Node) -> list[_Node]:
    return [node] if node.left is None else _leaves(node.left) + _leaves(node.right)


def _bin_of(node: _Node) -> Column:
    """(cell, bin, coordinate) of a row that is inside the cell's search interval, else null."""
    at = F.col("uid") if node.tied else F.col(node.dim)
    inside = at.between(node.low, node.high)
    if node.tied:
        inside = inside & (F.col(node.dim) == node.value)
    width = (node.high - node.low) // BINS + 1
    spot = F.struct(F.lit(node.first).alias("cell"), F.floor((at - node.low) / width).alias("bin"), at.alias("at"))
    return F.when(inside, spot)


def _settle(node: _Node, bins: list, slack: float) -> bool:
    """Move the search interval into the bin that holds the median, or cut; True once the cell is cut."""
    below, last = node.below, None
    for b in sorted(bins, key=lambda b: b["bin"]):
        above = below + b["w"]
        if above < node.target and b is not max(bins, key=lambda b: b["bin"]):
            below, last = above, b
            continue
        single = b["n"] == 1
        if single or min(node.target - below, abs(above - node.target)) <= slack:
            edge = b["hi"] if abs(above - node.target) <= node.target - below else b["lo"] - 1
            if node.tied:
                node.cut(node.value, edge)
            else:
                node.cut(edge, None)
            return True
        node.below = below
        if b["lo"] == b["hi"]:  # many rows at one coordinate: cut among them by uid
            node.tied, node.value = True, b["lo"]
            node.low, node.high = b["u0"], b["u1"]
        else:
            node.low, node.high = b["lo"], b["hi"]
        return False
    node.cut(node.high if last is None else last["hi"], None)
    return True


def kd_tree_shards(rows: DataFrame, dimensions: list[str], weight: str, shards: int) -> DataFrame:
    """Adds `shard` (0 .. shards - 1) and `slot` (gapless from 0 within a shard) to written rows.

    rows: a written table with a unique long `uid`, long `dimensions` without nulls and a positive `weight`.
    A cell of k shards is cut at the weighted floor(k/2)/k quantile along its widest dimension (in shares of
    that dimension's whole range), until each leaf is one shard and so holds the target weight. The quantile
    comes from histograms that Spark sums, narrowed until one bin settles it; rows at one coordinate are cut
    by uid, so a hot value is split like any other. An empty table gives no rows.
    """
    root = _Node(0, shards)
    total = rows.agg(F.sum(weight).alias("w"), *[f(d).alias(f"{f.__name__}_{d}") for d in dimensions for f in (F.min, F.max)]).first()
    whole = float(total["w"] or 0)
    span = {d: max(1, (total[f"max_{d}"] or 0) - (total[f"min_{d}"] or 0)) for d in dimensions}
    while whole and (open_cells := [n for n in _leaves(root) if n.count > 1]):
        cell = _descend(root, lambda n: F.lit(n.first))
        ranges = [F.min(d).alias(f"min_{d}") for d in dimensions] + [F.max(d).alias(f"max_{d}") for d in dimensions]
        stats = rows.groupBy(cell.alias("cell")).agg(F.sum(weight).alias("w"), F.min("uid").alias("u0"), F.max("uid").alias("u1"), *ranges)
        seen = {r["cell"]: r for r in stats.collect()}
        for n in open_cells:
            if (r := seen.get(n.first)) is None:  # more shards than rows: an empty cell
                n.dim = dimensions[0]
                n.cut(0, None)
                continue
            n.dim = max(dimensions, key=lambda d: (r[f"max_{d}"] - r[f"min_{d}"]) / span[d])
            n.low, n.high, n.target = r[f"min_{n.dim}"], r[f"max_{n.dim}"], float(r["w"]) * (n.count // 2) / n.count
            if n.low == n.high:
                n.tied, n.value, n.low, n.high = True, n.low, r["u0"], r["u1"]
        while searching := [n for n in open_cells if n.left is None]:
            wanted = {n.first for n in searching}
            spot = _descend(root, lambda n: _bin_of(n) if n.first in wanted and n.count > 1 else F.lit(None))
            found = rows.select(spot.alias("s"), F.col(weight).alias("w"), "uid").filter("s is not null")
            found = found.groupBy("s.cell", "s.bin").agg(
                F.sum("w").cast("double").alias("w"), F.count("*").alias("n"), F.min("s.at").alias("lo"), F.max("s.at").alias("hi"), F.min("uid").alias("u0"), F.max("uid").alias("u1")
            )
            bins: dict[int, list] = {}
            for r in found.collect():
                bins.setdefault(r["cell"], []).append(r)
            for n in searching:
                _settle(n, bins[n.first], TOLERANCE * whole / shards)
    placed = rows.withColumn("shard", _descend(root, lambda n: F.lit(n.first))).withColumn("__part", F.shiftright("uid", 33))
    # Slots: rows before a (shard, scan partition) plus the place in it, so that no shard is one task.
    counts = placed.groupBy("shard", "__part").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy("shard").orderBy("__part")) - F.col("__n")
    place = F.row_number().over(Window.partitionBy("shard", "__part").orderBy("uid")) - 1
    placed = placed.withColumn("__place", place).join(counts.withColumn("__before", before).drop("__n"), ["shard", "__part"])
    return placed.withColumn("slot", F.col("__before") + F.col("__place")).drop("__part", "__place", "__before")


def shard_documents(docs: DataFrame, shards: int = 40) -> DataFrame:
    """All documents in shards of near equal bytes: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Dimensions: doc_id, size and a code of source and of language: a CRC, which has no order that means anything, but
    keeps equal values together and cuts between values. Null texts have 16 bytes and the CRC of no bytes; null ids
    and codes count as 0; repeated rows are separate rows, and so are equal texts, which may go to several shards:
    the law is near-equal bytes, and rows at one coordinate are cut by their place in the table. A very long text
    makes a shard of its own larger by at most its size. An empty table gives no rows; other columns are ignored.
    """
    known = set(docs.columns)
    code = lambda c: F.coalesce(F.crc32(F.col(c).cast("string").cast("binary")), F.lit(0)) if c in known else F.lit(0)
    meta = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.shiftright(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), 1).alias("at_id"),  # halved, so that differences are longs
        code("source").cast("long").alias("at_source"),
        code("lang").cast("long").alias("at_lang"),
    )
    meta = materialise(with_uid(meta))
    placed = kd_tree_shards(meta, ["at_id", "size", "at_source", "at_lang"], "size", shards)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
