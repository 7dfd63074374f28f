"""Fill-in-middle samples by escaped marker injection, in DataFrame operations alone."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ends each unit while parts are cut, and begins an escape; both are escaped in texts first, so texts may hold them.
DELIMITER, ESCAPE = "\x1f", "\x1e"
#: Units of a text after escaping: an escape of two characters belongs to one unit.
UNITS = {
    "character": r"\x1e[01]|[^\x1e]",
    "word": r"[ \t-\r]*[^ \t-\r]+|[ \t-\r]+",
    "line": r"[^\n]*\n|[^\n]+",
}
#: Markers before prefix, suffix and middle.
MARKERS = ("<P>", "<S>", "<M>")


def _escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(ESCAPE), F.lit(f"{ESCAPE}0")), F.lit(DELIMITER), F.lit(f"{ESCAPE}1"))


def _unescaped(marked: Column) -> Column:
    bare = F.replace(marked, F.lit(DELIMITER), F.lit(""))
    return F.replace(F.replace(bare, F.lit(f"{ESCAPE}1"), F.lit(DELIMITER)), F.lit(f"{ESCAPE}0"), F.lit(ESCAPE))


def _ranked(marked: Column, count: Column) -> Column:
    """The first `count` units, or the last -count; substring_index takes its count as a column in SQL only."""
    return F.call_function("substring_index", marked, F.lit(DELIMITER), count.cast("int"))


def _draw(i: int) -> Column:
    """The i-th group of eight digits of the hash, as a number."""
    return F.conv(F.substring("hash", 8 * i + 1, 8), 16, 10).cast("long")


def checked(markers: tuple[str, str, str]) -> tuple[str, str, str]:
    """The markers, if none can begin within another: else an output could be read in two ways."""
    for (i, a), (j, b) in product(enumerate(markers), repeat=2):
        if not a or (i != j and a in b) or any(a.endswith(b[:k]) for k in range(1, len(b) + (i != j))):
            raise ValueError(f"markers {a!r} and {b!r} can overlap")
    return markers


def infill(docs: DataFrame, unit: str = "character", markers: tuple[str, str, str] = MARKERS, plain_percent: int = 10, spm_percent: int = 20, seed: int = 1) -> DataFrame:
    """doc_id, text, n (units), form (plain, psm, spm), prefix, middle, suffix and output, for every row of docs.

    The text is escaped, a delimiter is put after each unit, delimiters are counted, and the parts are the first and last
    so many units. Where the text is cut, and its form, depend on the seed and the id alone. A null text counts as empty; empty
    texts and texts that hold a marker stay plain, where output is the text and the parts are null. A null id is hashed as
    an empty one. Repeated rows give the same sample each; equal cuts give an empty middle; very long texts are cut whole;
    an empty table gives no rows; columns other than the id and text are ignored, whatever their names.
    """
    p, s, m = map(F.lit, checked(markers))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256).alias("hash"))
    rows = rows.withColumn("marked", F.regexp_replace(_escaped(F.col("text")), f"(?:{UNITS[unit]})", f"$0{DELIMITER}"))
    rows = rows.withColumn("n", (F.length("marked") - F.length(F.replace("marked", F.lit(DELIMITER), F.lit("")))).cast("long"))
    a, b = _draw(0) % (F.col("n") + 1), _draw(1) % (F.col("n") + 1)
    held = F.lit(False)
    for marker in (p, s, m):
        held = held | F.contains("text", marker)
    plain = (F.col("text") == "") | held | (_draw(2) % 100 >= 100 - plain_percent)
    form = F.when(plain, "plain").when(_draw(3) % 100 < spm_percent, "spm").otherwise("psm")
    rows = rows.select("doc_id", "text", "marked", "n", F.least(a, b).alias("one"), F.greatest(a, b).alias("two"), form.alias("form"))
    cut = F.col("form") != "plain"
    parts = {
        "prefix": _ranked(F.col("marked"), F.col("one")),
        "middle": _ranked(_ranked(F.col("marked"), F.col("two")), F.col("one") - F.col("two")),
        "suffix": _ranked(F.col("marked"), F.col("two") - F.col("n") - 1),
    }
    rows = rows.select("doc_id", "text", "n", "form", *[F.when(cut, _unescaped(part)).alias(name) for name, part in parts.items()])
    psm, spm = F.concat(p, "prefix", s, "suffix", m, "middle"), F.concat(s, "suffix", p, "prefix", m, "middle")
    return rows.withColumn("output", F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("text")))


def restored(output: Column, form: Column, markers: tuple[str, str, str] = MARKERS) -> Column:
    """The text that an output of that form was made of."""
    p, s, m = markers

    def between(first: str, last: str | None) -> Column:
        after = F.substring(output, F.locate(first, output) + F.lit(len(first)), F.length(output))
        return after if last is None else F.substring_index(after, last, 1)

    psm = F.concat(between(p, s), between(m, None), between(s, m))
    return F.when(form == "psm", psm).when(form == "spm", F.concat(between(p, m), between(m, None), between(s, p))).otherwise(output)
