"""Check crops: geometry, de-duplication, caches, pages and their summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.coerce import blank, pages_of
from ..functions.predicates import page_kind

# The aspect under which a crop is a deposit slip, the distance under which two are one, a page's price.
SLIP_ASPECT, LEAST_DISTANCE, PAGE_PRICE = 2.1, 80, 0.01


def mark_slips(crops: DataFrame) -> DataFrame:
    return crops.withColumn("likely_deposit_slip", F.col("aspect_ratio") < SLIP_ASPECT)


def plausible(crops: DataFrame, width: int = 300, height: int = 100, low: float = 1.2, high: float = 4.0, variance: float = 50.0) -> DataFrame:
    """Crops of sufficient size, likely aspect and some contrast."""
    return crops.filter((F.col("width") >= width) & (F.col("height") >= height) & F.col("aspect_ratio").between(low, high) & (F.col("variance") >= variance))


def rejections(crops: DataFrame, width: int = 300, height: int = 100, low: float = 1.2, high: float = 4.0, variance: float = 50.0) -> DataFrame:
    """One row: crops that fail by size, aspect and contrast, each by its first reason."""
    small = (F.col("width") < width) | (F.col("height") < height)
    odd = ~small & ~F.col("aspect_ratio").between(low, high)
    return crops.agg(F.count_if(small).alias("size"), F.count_if(odd).alias("aspect"), F.count_if(~small & ~odd & (F.col("variance") < variance)).alias("variance"))


def suppress(crops: DataFrame, least: int = LEAST_DISTANCE) -> DataFrame:
    """One crop of each hash, the first by ord, then of a page those whose centre is not near a better one's.

    Better: a larger product of variance and area, then the earlier. A page's crops are few, so they are folded in
    one array.
    """
    first = F.row_number().over(Window.partitionBy("page", "hash").orderBy("ord"))
    unique = crops.withColumn("__n", first).filter("__n = 1").drop("__n")
    item = F.struct((-F.col("variance") * F.col("width") * F.col("height")).alias("rank"), F.col("ord").alias("ord"), (F.col("x") + F.floor(F.col("width") / 2)).cast("long").alias("cx"), (F.col("y") + F.floor(F.col("height") / 2)).cast("long").alias("cy"))
    lists = unique.groupBy("page").agg(F.array_sort(F.collect_list(item)).alias("items"))
    none = F.expr("cast(array() as array<struct<ord:bigint,cx:bigint,cy:bigint>>)")

    def keep(kept: Column, c: Column) -> Column:
        near = F.exists(kept, lambda k: F.abs(k["cx"] - c["cx"]) + F.abs(k["cy"] - c["cy"]) < least)
        return F.when(near, kept).otherwise(F.concat(kept, F.array(F.struct(c["ord"].cast("long").alias("ord"), c["cx"].alias("cx"), c["cy"].alias("cy")))))

    kept = lists.select("page", F.explode(F.aggregate("items", none, keep)["ord"]).alias("ord"))
    return unique.join(kept, ["page", "ord"], "left_semi")


def from_cache(crops: DataFrame, cache: DataFrame) -> DataFrame:
    """Crops with their cached text: by crop id, else by page and row number."""
    by_id = cache.select("crop_id", F.col("text").alias("__a")).dropDuplicates(["crop_id"])
    by_slot = cache.groupBy("page", "row_number").agg(F.min_by("text", "crop_id").alias("__b"))
    both = crops.join(by_id, "crop_id", "left").join(by_slot, ["page", "row_number"], "left")
    return both.withColumn("text", F.coalesce("__a", "__b")).drop("__a", "__b")


def prefer_enriched(rows: DataFrame, prefix: str = "hybrid") -> DataFrame:
    """payee and check_no of the enriched leg where its note says so and they are not blank."""
    given = F.lower(blank(F.col("notes"))).startswith(prefix)
    pick = lambda new, old: F.when(given & (blank(F.col(new)) != ""), F.col(new)).otherwise(F.col(old))
    return rows.withColumn("payee", pick("enriched_payee", "payee")).withColumn("check_no", pick("enriched_check_no", "check_no"))


def page_summary(pages: DataFrame) -> DataFrame:
    """One row: pages kept, skipped, and skipped by kind."""
    kind = page_kind(F.col("text"))
    return pages.select(kind.alias("k")).agg(F.count_if(F.col("k") == "keep").alias("kept"), F.count_if(F.col("k") != "keep").alias("skipped"), F.count_if(F.col("k") == "blank").alias("blank"), F.count_if(F.col("k") == "reconciliation").alias("reconciliation"), F.count_if(F.col("k") == "low_information").alias("other"))


def cost(ranges: Column, price: float = PAGE_PRICE) -> Column:
    return F.round(F.size(pages_of(ranges)) * price, 4)


def classes_by_page(crops: DataFrame, classes: list[str]) -> DataFrame:
    """Crops of each page by class; with a column `clean`, also its count and percentage."""
    wide = crops.groupBy("page").pivot("class", classes).count().na.fill(0)
    if "clean" not in crops.columns:
        return wide
    n = crops.groupBy("page").agg(F.count_if("clean").alias("clean"), F.bround(100.0 * F.count_if("clean") / F.count("*"), 1).alias("clean_pct"))
    return wide.join(n, "page")


def cohorts(crops: DataFrame, clean: Column) -> DataFrame:
    """Crops by quality (deposit, empty, real, polluted) and reason."""
    kind = F.when(F.col("class") == "deposit_slip", "deposit").when(blank(F.col("payee")) == "", "empty").when(clean, "real").otherwise("polluted")
    return crops.groupBy(kind.alias("cohort"), "reason").agg(F.count("*").alias("n"))


def ungraded(crops: DataFrame, page: int | None = None, kind: str | None = None) -> DataFrame:
    out = crops.filter(blank(F.col("grade")) == "")
    out = out if page is None else out.filter(F.col("page") == page)
    return out if kind is None else out.filter(F.col("class") == kind)


def payee_samples(rows: DataFrame, k: int) -> DataFrame:
    """The first k different payees that are not blank, in order."""
    return rows.filter(blank(F.col("payee")) != "").groupBy("payee").agg(F.min("ord").alias("ord")).orderBy("ord").limit(k)


def snippets(lines: DataFrame, pattern: str, after: int = 3) -> DataFrame:
    """Text from two lines before each key's first match to `after` lines behind it."""
    texts = lines.groupBy("crop_id").agg(F.array_sort(F.collect_list(F.struct("idx", "text"))).alias("l"))
    at = F.array_position(F.transform("l", lambda s: s["text"].rlike(pattern)), True).cast("int")
    start = F.greatest(at - 2, F.lit(1))
    return texts.withColumn("at", at).filter("at > 0").select("crop_id", F.array_join(F.slice(F.transform("l", lambda s: s["text"]), start, at - start + 1 + after), " | ").alias("snippet"))


def human_truth(crops: DataFrame) -> DataFrame:
    """Adds truth: the note of a crop that was graded wrong (a grade that begins with w), else its candidate, else its payee."""
    wrong = F.lower(blank(F.col("grade"))).startswith("w") & (blank(F.col("notes")) != "")
    read = F.coalesce(F.nullif(blank(F.col("candidate")), F.lit("")), blank(F.col("payee")))
    return crops.withColumn("truth", F.when(wrong, blank(F.col("notes"))).otherwise(read))
