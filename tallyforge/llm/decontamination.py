"""Benchmark decontamination by winnowed fingerprints, in DataFrame operations alone."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, unused

#: Words of a window: a document and an item share a passage if they share so many words in a row.
WINDOW = 10
#: Words of a fingerprint. WINDOW - GRAM + 1 consecutive fingerprints make a window, of which the least is kept.
GRAM = 6
#: Rows and bytes up to which a side is broadcast; beyond, Spark shuffles both.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 64_000_000


def words_of(text: str) -> Column:
    """Lower-case A-Z, then the runs of ASCII letters and digits and of other characters beyond ASCII."""
    lower = F.translate(F.coalesce(F.col(text), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.regexp_extract_all(lower, F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0))


def _each(array: str, length: int, make) -> Column:
    """make(i) for each start of `length` neighbours in the array; empty where there are fewer.

    The bodies name the array more than once, which keeps Spark from pasting the array's own expression in.
    """
    n = F.size(array)
    return F.when(n >= length, F.transform(F.sequence(F.lit(0), n - length), make))


def _grams(hashes: str, length: int) -> Column:
    return _each(hashes, length, lambda i: F.xxhash64(F.lit(length), *[F.col(hashes)[i + j] for j in range(length)]))


def fingerprints(df: DataFrame, short: list[int]) -> DataFrame:
    """Adds `fingerprints`, a set for each row of `words`: the least gram of each window, and all grams of `short` lengths."""
    span = WINDOW - GRAM + 1
    df = df.withColumn("__hashes", F.transform("words", lambda w: F.xxhash64(w))).withColumn("__grams", _grams("__hashes", GRAM))
    least = _each("__grams", span, lambda i: F.least(*[F.col("__grams")[i + j] for j in range(span)]))
    none = F.array().cast("array<bigint>")
    sets = [F.coalesce(least, none), *(F.coalesce(_grams("__hashes", n), none) for n in short)]
    return df.withColumn("fingerprints", F.array_distinct(F.concat(*sets) if short else sets[0])).drop("__hashes", "__grams")


def _small(df: DataFrame) -> DataFrame:
    """df, marked for broadcasting if it has BROADCAST_ROWS and BROADCAST_BYTES at most."""
    size = df.limit(BROADCAST_ROWS + 1).agg(F.count("*").alias("n"), F.sum(F.octet_length(F.concat_ws(",", *[F.col(c).cast("string") for c in df.columns]))).alias("bytes")).first()
    return F.broadcast(df) if size["n"] <= BROADCAST_ROWS and (size["bytes"] or 0) <= BROADCAST_BYTES else df


def _key() -> Column:
    """128 bits of an id and a text, under which rows are told apart."""
    return F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("\n"), F.coalesce("text", F.lit(""))).cast("binary"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """key (128 bits of doc_id and text), doc_id, n_words, n_hit, items (array of ids), for every row of docs.

    A window is WINDOW consecutive words of an item, or all of a shorter one. A document word in any occurrence of
    a window is hit. Winnowing keeps the least gram of each document window, so a document that shares a window
    with an item shares a fingerprint; hits are then extended by comparing all windows of such documents, word by
    word. Null and empty texts have no words; items without words have no windows; items with a null id count under
    the id "null"; repeated rows are separate rows; ties of a window's least gram are one gram; very long texts are
    taken whole; an empty table gives no rows; columns other than the ids and texts are ignored, whatever their names.
    """
    items = materialise(benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), words_of("text").alias("words")).filter("size(words) > 0"))
    short = [r["n"] for r in items.filter(F.size("words") < WINDOW).select(F.size("words").alias("n")).distinct().collect()]
    lengths = sorted({WINDOW, *short})
    # In items only whole short ones are windows, so their shorter grams are dropped.
    long_marks = fingerprints(items.filter(F.size("words") >= WINDOW), [])
    marks = long_marks.select(F.explode("fingerprints").alias("mark"))
    for n in short:
        marks = marks.union(fingerprints(items.filter(F.size("words") == n), [n]).select(F.explode("fingerprints")))
    marks = materialise(marks.distinct().withColumn("shared", F.lit(True)))

    keyed = docs.select("doc_id", "text", _key().alias("key"), F.monotonically_increasing_id().alias("uid"))
    marked = fingerprints(keyed.select("doc_id", "key", "uid", words_of("text").alias("words")), short)
    marked = marked.select("doc_id", "key", "uid", F.size("words").cast("long").alias("n_words"), F.explode_outer("fingerprints").alias("mark"))
    seen = marked.join(_small(marks), "mark", "left").groupBy("uid", "key", "doc_id", "n_words").agg(F.coalesce(F.max("shared"), F.lit(False)).alias("shared"))
    seen = materialise(seen.drop("uid"))

    suspects = materialise(seen.filter("shared").select("key").distinct())
    texts = docs.select("text", _key().alias("key")).join(_small(suspects), "key").select("key", words_of("text").alias("words"))
    found = offered = None
    for n in lengths:
        ours = texts.select("key", *_windows(n))
        theirs = items.filter(F.size("words") >= n if n == WINDOW else F.size("words") == n).select("item_id", *_windows(n)).select("item_id", "window").distinct()
        offered = theirs if offered is None else offered.union(theirs)
        # Items join after positions: a passage that many items hold is one window here.
        hits = ours.join(_small(theirs.select("window").distinct()), "window").select("key", "start", "window", F.lit(n).alias("n"))
        found = hits if found is None else found.union(hits)
    found = materialise(found)
    covered = found.select("key", F.explode(F.sequence("start", F.col("start") + F.col("n") - 1)).alias("at")).distinct().groupBy("key").agg(F.count("*").alias("n_hit"))
    named = found.select("key", "window").distinct().join(_small(offered), "window").groupBy("key").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    out = seen.join(covered.join(named, "key"), "key", "left")
    return out.select("key", "doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def _windows(n: int) -> list[Column]:
    """Start and text of each window of n words, as rows."""
    starts = _each("words", n, lambda i: F.struct(i.alias("start"), F.concat_ws(" ", *[F.col("words")[i + j] for j in range(n)]).alias("window")))
    return [F.inline(starts)]


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that hold no window of an item."""
    (name,) = unused(docs, "__hit")
    hit = decontaminate(docs, benchmark).filter("n_hit > 0").select(F.col("key").alias(name)).distinct()
    return docs.join(hit, _key() == F.col(name), "left_anti")
