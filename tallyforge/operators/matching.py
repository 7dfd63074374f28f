"""One-to-one matching of check crops to transactions, in three tiers; order of crops decides."""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Iterator
from difflib import SequenceMatcher
from itertools import groupby
from operator import itemgetter

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.coerce import blank, cents, check_number
from ..functions.predicates import is_clean_payee
from .alike import alike
from .pieces import LARGE
from .rounds import in_turn
from .sequence import by_size, settled, walked

# The least ratio that matches by name, the ratio below which a payee is replaced, and outdated notes.
LEAST_RATIO, SAME_NAME = 0.60, 0.85
#: Crops of one ord at most.
TURNS = 1024
STALE_STARTS, STALE = ("OCR fallback path", "OCR fallback \u2014"), ("Missing payee", "Missing date")


def sequence_ratio(a: str | None, b: str | None) -> float:
    a, b = (a or "").lower().strip(), (b or "").lower().strip()
    return SequenceMatcher(None, a, b).ratio() if a and b else 0.0


@F.pandas_udf(DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([sequence_ratio(x, y) for x, y in zip(a, b, strict=True)])


class _Free:
    """Transactions that no crop has taken yet, in order, under their numbers, amounts and descriptions."""

    def __init__(self):
        self.numbers, self.sizes, self.names = defaultdict(deque), defaultdict(deque), {}
        self.taken: set[int] = set()

    def add(self, ord_: int, number: str, size: int | None, name: str) -> None:
        if number:
            self.numbers[number].append(ord_)
        if size is not None:
            self.sizes[size].append(ord_)
        if name:
            if name not in self.names:  # the matcher prepares its second text once
                self.names[name] = (SequenceMatcher(None, "", name.lower()), deque())
            self.names[name][1].append(ord_)

    def first(self, line: deque | None) -> int | None:
        while line and line[0] in self.taken:
            line.popleft()
        return line[0] if line else None

    def by_size(self, size: int) -> int | None:
        found = [f for c in (size - 1, size, size + 1) if (f := self.first(self.sizes.get(c))) is not None]
        return min(found, default=None)

    def by_name(self, payee: str) -> tuple[int | None, float]:
        """The first of the most alike; texts are compared in full only if their lengths and letters allow more."""
        best, at = 0.0, None
        for name, (matcher, line) in list(self.names.items()):
            ord_ = self.first(line)
            if ord_ is None:
                del self.names[name]
                continue
            least = max(best, LEAST_RATIO)
            matcher.set_seq1(payee.lower())
            if matcher.real_quick_ratio() < least or matcher.quick_ratio() < least:
                continue
            alike = matcher.ratio()
            if alike > best or (alike == best and at is not None and ord_ < at):
                best, at = alike, ord_
        return (at, best) if best >= LEAST_RATIO else (None, best)


def match_checks(transactions: DataFrame, crops: DataFrame) -> DataFrame:
    """statement_id, crop_ord, ord, tier (check_number, amount, name) and alike of matched crops; each transaction serves one.

    By number, then by amounts within a cent, then by the crop's payee and the transaction's description. Statements of
    LARGE rows and more are matched in rounds (rounds.in_turn), which give the same; of the others, a task walks through
    many: a statement's transactions come before its crops, so a crop costs a few looks, and comparisons with different
    descriptions only if it has neither number nor amount in common. Equal ords of a statement are one transaction.
    """

    def match(rows: Iterator[tuple]) -> Iterator[tuple]:
        for statement, group in groupby(rows, key=itemgetter(0)):
            free = _Free()
            for _, is_crop, ord_, number, size, name in group:
                if not is_crop:
                    free.add(ord_, number, size, name)
                    continue
                tier, hit, alike = "check_number", free.first(free.numbers.get(number)) if number else None, None
                if hit is None and size is not None:
                    tier, hit = "amount", free.by_size(size)
                if hit is None and name:
                    tier, (hit, alike) = "name", free.by_name(name)
                if hit is not None:
                    free.taken.add(hit)
                    yield statement, ord_, hit, tier, alike

    def side(df: DataFrame, is_crop: int, name: str) -> DataFrame:
        text = blank(F.col(name)) if name in df.columns else F.lit("")
        return df.select("statement_id", F.lit(is_crop).alias("is_crop"), F.col("ord").cast("long").alias("ord"), check_number(F.col("check_no")).alias("number"), cents(F.col("amount")).alias("size"), text.alias("name"))

    both = side(transactions, 0, "description").unionByName(side(crops, 1, "payee"))
    small, large = by_size(both, LARGE)
    found = walked(small, ["statement_id"], ["is_crop", "ord"], match, "statement_id string, crop_ord long, ord long, tier string, alike double")
    return found if large is None else found.unionByName(_in_rounds(large.filter("is_crop = 0"), large.filter("is_crop = 1"))[0])


def _in_rounds(free: DataFrame, crops: DataFrame) -> tuple[DataFrame, int]:
    """match_checks() for statements of any size, and the rounds it took: lists by number, by amount and by name, in turn."""
    free, crops = settled(free), settled(crops)
    place = F.col("ord").cast("decimal(38,0)").alias("preference")
    listed = lambda rows, kind, value: rows.select("statement_id", F.concat(F.lit(f"{kind}:"), value.cast("string")).alias("key"), F.col("ord").alias("slot"), place)
    numbers = listed(free.filter("number <> ''"), "number", F.col("number"))
    sizes = listed(free.filter("size is not null").withColumn("size", F.explode(F.array(F.col("size") - 1, F.col("size"), F.col("size") + 1))), "amount", F.col("size"))
    nth = F.row_number().over(Window.partitionBy("statement_id", "ord").orderBy("number", "size", "name")) - 1
    keys = F.array_compact(F.array(
        F.when(F.col("number") != "", F.concat(F.lit("number:"), "number")), F.when(F.col("size").isNotNull(), F.concat(F.lit("amount:"), F.col("size").cast("string"))),
        F.when(F.col("name") != "", F.concat(F.lit("name:"), "name")),
    ))
    # Crops of one ord take turns.
    seekers = settled(crops.select("statement_id", "ord", (F.col("ord") * TURNS + nth).alias("turn"), keys.alias("keys")))
    asked = crops.select("statement_id", F.explode(keys).alias("key")).join(numbers.union(sizes).select("statement_id", "key").distinct(), ["statement_id", "key"], "left_semi").distinct()
    lists = numbers.union(sizes).join(asked, ["statement_id", "key"], "left_semi").distinct()
    ratios: list[DataFrame] = []

    def by_name(keys: DataFrame) -> DataFrame:
        names = keys.filter(F.col("key").startswith("name:")).select("statement_id", F.substring("key", 6, 2**31 - 1).alias("text"))
        if names.isEmpty():
            return lists.limit(0)
        pairs = settled(alike(names, free.select("statement_id", F.col("name").alias("text")), LEAST_RATIO))
        ratios.append(pairs)
        rows = pairs.join(free.select("statement_id", F.col("name").alias("theirs"), "ord"), ["statement_id", "theirs"])
        # The most alike first; ratios of texts differ by more than the twelfth digit.
        worse = F.round((1 - F.col("ratio")) * 1e12).cast("decimal(38,0)") * F.lit(2**62).cast("decimal(19,0)")
        return rows.groupBy("statement_id", F.concat(F.lit("name:"), "ours").alias("key"), F.col("ord").alias("slot")).agg(F.min((worse + F.col("ord")).cast("decimal(38,0)")).alias("preference"))

    choice = in_turn(seekers, lists, by_name)
    out = choice.chosen.select("statement_id", F.floor(F.col("turn") / TURNS).alias("crop_ord"), F.col("slot").alias("ord"), F.substring_index("key", ":", 1).alias("tier"), F.substring("key", 6, 2**31 - 1).alias("ours"))
    out = out.withColumn("tier", F.when(F.col("tier") == "number", "check_number").otherwise(F.col("tier")))
    told = None
    for p in ratios:
        told = p if told is None else told.unionByName(p)
    if told is None:
        return out.withColumn("alike", F.lit(None).cast("double")).drop("ours"), choice.rounds
    best = told.join(free.select("statement_id", F.col("name").alias("theirs"), "ord"), ["statement_id", "theirs"]).groupBy("statement_id", "ours", "ord").agg(F.max("ratio").alias("alike"))
    named = out.join(best, ["statement_id", "ours", "ord"], "left")
    return named.select("statement_id", "crop_ord", "ord", "tier", F.when(F.col("tier") == "name", F.col("alike")).alias("alike")), choice.rounds


def _numbered(rows: DataFrame, key: list[str], order: list[Column | str], name: str) -> DataFrame:
    """rows with the place of each among those of its key, from 1."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*key).orderBy(*order)))


def apply_matches(transactions: DataFrame, crops: DataFrame, matches: DataFrame) -> DataFrame:
    """Transactions with the payees of their crops: swapped if clean and the old one is blank, uncategorised or unlike.

    Swapped rows are High and need no review; other matched ones are Low, unless High already, and do. review_reason
    says how a row was matched, and loses notes that are outdated by that. Every transaction comes out once: where an
    ord is repeated in a statement, its rows pair off with the matches of that ord, and matches of a repeated crop with its
    rows, the first with the first, by amount, number and payee; rows beyond those have no match.
    """
    text = lambda c: blank(F.col(c))
    names = crops.select("statement_id", F.col("ord").alias("crop_ord"), text("payee").alias("__new"), check_number(F.col("check_no")).alias("__no"), F.abs("amount").alias("__size"))
    names = _numbered(names, ["statement_id", "crop_ord"], ["__size", "__no", "__new"], "__k")
    # Equal matches get equal places on both sides: the second place is counted in the order of the first.
    paired = _numbered(matches, ["statement_id", "crop_ord"], ["ord", "tier", "alike"], "__k")
    paired = _numbered(paired.join(names, ["statement_id", "crop_ord", "__k"]), ["statement_id", "ord"], ["crop_ord", "__k"], "__n").drop("__k")
    numbered = _numbered(transactions, ["statement_id", "ord"], [F.abs("amount"), check_number(F.col("check_no")), text("payee")], "__n")
    key = ["statement_id", "ord", "__n"]
    # Names are compared in Python, for matched rows alone.
    told = paired.join(numbered.select(*key, F.col("payee").alias("__old")), key).withColumn("__alike", ratio("__old", "__new")).drop("__old")
    linked = numbered.join(told, key, "left")
    unlike = F.lower(text("payee")).isin("", "uncategorized") | (F.col("__alike") < SAME_NAME)
    swap = F.coalesce(F.col("__new").isNotNull() & is_clean_payee(F.col("__new")) & unlike, F.lit(False))
    hit, high = F.col("crop_ord").isNotNull(), F.lower(blank(F.col("confidence"))) == "high"
    by = (
        F.when(F.col("tier") == "check_number", F.concat(F.lit("check# "), "__no"))
        .when(F.col("tier") == "amount", F.concat(F.lit("amount $"), F.format_string("%.2f", "__size")))
        .otherwise(F.concat(F.lit("fuzzy desc match ("), F.format_string("%.2f", "alike"), F.lit(")")))
    )
    note = F.when(swap, F.concat(F.lit("Payee from check image ("), by, F.lit(")"))).when(hit, F.concat(F.lit("Linked via "), by, F.lit(" (no clean payee from image)")))
    old = F.filter(F.transform(F.split(blank(F.col("review_reason")) if "review_reason" in transactions.columns else F.lit(""), ";"), lambda n: F.trim(n)), lambda n: n != "")
    for start in STALE_STARTS:
        old = _not_starting(old, start)
    old = F.filter(old, lambda n: ~n.isin(*STALE))
    columns = {
        "payee": F.when(swap, F.col("__new")).otherwise(F.col("payee")),
        "confidence": F.when(swap, "High").when(hit & ~high, "Low").otherwise(F.col("confidence")),
        "needs_review": F.when(swap, "No").when(hit & ~high, "Yes").otherwise(F.col("needs_review")),
        "linked_check_id": F.col("crop_ord"),
    }
    if "review_reason" in transactions.columns:
        columns["review_reason"] = F.when(hit, F.array_join(F.concat(old, F.array(note)), "; ")).otherwise(F.col("review_reason"))
    return linked.select(*[c for c in transactions.columns if c not in columns], *[v.alias(k) for k, v in columns.items()])


def _not_starting(notes, start: str):
    return F.filter(notes, lambda n: ~n.startswith(start))
