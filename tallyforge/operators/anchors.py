"""Which of many patterns each text contains, without meeting all of them: patterns wait under their rarest gram."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of a gram. Shorter patterns wait under all of themselves.
GRAM = 3
#: Patterns, and bytes of them, up to which they are broadcast; beyond, texts are shuffled by gram.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 16_000_000
#: Regular expressions that meet the texts in one pass; more take more passes.
EXPRESSIONS = 1000


def _spread(rows: DataFrame, column: str, size: int) -> DataFrame:
    """rows once for each of the different runs of `size` characters in the column (`__gram`).

    The characters are a column that is named more than once, so that Spark computes them once a row, not once a run.
    """
    if size == 0:
        return rows.withColumn("__gram", F.lit(""))
    cut = rows.filter(F.length(column) >= size).withColumn("__chars", F.regexp_extract_all(column, F.lit("(?s)."), F.lit(0)))
    run = lambda i: F.concat(*[F.col("__chars")[i + j] for j in range(size)])
    runs = F.array_distinct(F.transform(F.sequence(F.lit(0), F.size("__chars") - size), run))
    return cut.withColumn("__gram", F.explode(runs)).drop("__chars")


def contained(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """text and pattern, once each, where the one holds the other in either case. texts: text; patterns: pattern.

    A pattern that is contained has all its grams in the text, so it may wait under any one of them: the one that fewest
    texts have, which is counted. Texts meet the patterns under their own grams on equal keys, and each pair that met is
    then compared. A pattern with a gram that no text has is gone after the count. An empty pattern is in every text; nulls
    are in none and hold none. Grams of frequent patterns are as many rows as there are answers, which AQE splits.
    """
    texts = texts.select("text").filter("text is not null").distinct().withColumn("__low", F.lower("text"))
    patterns = patterns.select("pattern").filter("pattern is not null").distinct().withColumn("__part", F.lower("pattern"))
    patterns = patterns.withColumn("__size", F.least(F.length("__part"), F.lit(GRAM)))
    known = patterns.groupBy("__size").agg(F.count("*").alias("n"), F.sum(F.octet_length("pattern") + F.octet_length("__part")).alias("bytes")).collect()  # four rows at most
    if not known:
        return texts.join(patterns, F.lit(False)).select("text", "pattern")
    offered = found = None
    for size in sorted(r["__size"] for r in known):
        mine, theirs = _spread(patterns.filter(F.col("__size") == size), "__part", size), _spread(texts, "__low", size)
        offered = mine if offered is None else offered.unionByName(mine)
        found = theirs if found is None else found.unionByName(theirs)
    counts = found.groupBy("__gram").agg(F.count("*").alias("__n"))
    # A left join: grams without a text come first, and take their patterns with them.
    rarest = offered.join(counts, "__gram", "left").groupBy("pattern", "__part").agg(F.min(F.struct(F.coalesce("__n", F.lit(0)).alias("n"), "__gram")).alias("__least"))
    anchored = rarest.filter("__least.n > 0").select("pattern", "__part", F.col("__least.__gram").alias("__gram"))
    if sum(r["n"] for r in known) <= BROADCAST_ROWS and sum(r["bytes"] for r in known) <= BROADCAST_BYTES:
        anchored = F.broadcast(anchored)  # texts then need no shuffle by gram
    return found.join(anchored, "__gram").filter(F.contains("__low", "__part")).select("text", "pattern")


def _expression(pattern: str) -> str | None:
    """A `re:` pattern as Spark takes it, or null if it is not sound."""
    try:
        re.compile(pattern[3:])
    except re.error:
        return None
    return "(?i)" + pattern[3:].replace("(?P<", "(?<")


def _sound(patterns: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pairs = [(p, e) for p in b.column(0).to_pylist() if (e := _expression(p)) is not None]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in pairs], pa.string()) for i in range(2)], names=["pattern", "__expression"])

    return patterns.select("pattern").mapInArrow(run, "pattern string, __expression string")


def occurrences(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """text and pattern, once each, where the pattern occurs: `re:` begins a regular expression, anything else is contained.

    Expressions have no gram to wait under. They meet the different texts in passes of EXPRESSIONS, each a broadcast of
    that many; a pattern that is no expression matches nothing.
    """
    whole = F.col("pattern").startswith("re:")
    out = contained(texts, patterns.filter(~whole))
    listed = _sound(patterns.filter(whole).distinct()).collect() if not patterns.filter(whole).isEmpty() else []
    every = texts.select("text").filter("text is not null").distinct()
    for at in range(0, len(listed), EXPRESSIONS):
        some = texts.sparkSession.createDataFrame([tuple(r) for r in listed[at : at + EXPRESSIONS]], "pattern string, __expression string")
        out = out.unionByName(every.join(F.broadcast(some), F.expr("text rlike __expression")).select("text", "pattern"))
    return out
