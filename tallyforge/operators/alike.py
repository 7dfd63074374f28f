"""Texts that are alike by the ratio of their matching blocks: counts of characters rule pairs out before they are compared."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Texts on the one side that are sent to the tasks at once, and their characters at most.
BLOCK, CHARACTERS = 20_000, 4_000_000
#: Characters are counted in so many classes by code point.
CLASSES = 64
#: Pairs of texts whose counts are compared at once.
PAIRS = 1_000_000


def counts(texts: list[str]) -> np.ndarray:
    """How many characters of each class every text has."""
    out = np.zeros((len(texts), CLASSES), np.int32)
    for i, t in enumerate(texts):
        codes = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) % CLASSES
        out[i] = np.bincount(codes, minlength=CLASSES)
    return out


def possible(a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """For each pair of rows, whether twice the characters that the two may share reaches `least` of their lengths.

    Matching blocks share no more characters than the counts do, and classes only make counts meet that would not.
    """
    size_a, size_b = a.sum(axis=1), b.sum(axis=1)
    shared = np.zeros((len(a), len(b)), np.int32)
    for k in np.flatnonzero(a.any(axis=0) & b.any(axis=0)):
        shared += np.minimum(a[:, k, None], b[None, :, k])
    return 2 * shared >= least * (size_a[:, None] + size_b[None, :]) - 1e-6


def pairs(ours: list[str], theirs: list[str], least: float) -> Iterator[tuple[int, int, float]]:
    """Places in ours and theirs of texts with a ratio of at least `least`, and the ratio: ours are first in the comparison."""
    a, step = counts(ours), max(1, PAIRS // max(1, len(ours)))
    for start in range(0, len(theirs), step):
        part = theirs[start : start + step]
        found = possible(a, counts(part), least)
        for j in np.flatnonzero(found.any(axis=0)):
            matcher = SequenceMatcher(None, "", part[j])  # it prepares its second text once
            for i in np.flatnonzero(found[:, j]):
                matcher.set_seq1(ours[i])
                if matcher.quick_ratio() >= least and (ratio := matcher.ratio()) >= least:
                    yield int(i), start + int(j), ratio


def alike(ours: DataFrame, theirs: DataFrame, least: float) -> DataFrame:
    """statement_id, ours, theirs, ratio: pairs of different texts of a statement that are alike in lower case, trimmed.

    ours and theirs: statement_id, text. Ours come to the driver in blocks of BLOCK texts and CHARACTERS, in as many
    turns as it takes, and are sent to the tasks that read theirs; blank texts are like none.
    """
    clean = lambda df: df.select("statement_id", "text", F.trim(F.lower("text")).alias("low")).filter("low <> '' and statement_id is not null").distinct()
    mine, yours = clean(ours), clean(theirs)
    kind = "statement_id string, ours string, theirs string, ratio double"
    spark, out = ours.sparkSession, None

    def against(block: list[tuple[str, str, str]]) -> DataFrame:
        groups: dict[str, list[tuple[str, str]]] = {}
        for statement, text, low in block:
            groups.setdefault(statement, []).append((text, low))
        shared = spark.sparkContext.broadcast(groups)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows: dict[str, list[tuple[str, str]]] = {}
                for statement, text, low in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if statement in shared.value:
                        rows.setdefault(statement, []).append((text, low))
                for statement, theirs_ in rows.items():
                    ours_ = shared.value[statement]
                    found = [(statement, ours_[i][0], theirs_[j][0], r) for i, j, r in pairs([x[1] for x in ours_], [x[1] for x in theirs_], least)]
                    if found:
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found, strict=True)], names=["statement_id", "ours", "theirs", "ratio"])

        return yours.mapInArrow(run, kind)

    block, size = [], 0
    for row in mine.toLocalIterator():
        block.append(tuple(row))
        size += len(row["text"])
        if len(block) >= BLOCK or size >= CHARACTERS:
            out, block, size = against(block) if out is None else out.unionByName(against(block)), [], 0
    if block:
        out = against(block) if out is None else out.unionByName(against(block))
    return spark.createDataFrame([], kind) if out is None else out
