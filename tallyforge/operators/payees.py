"""Payees of check crops: candidates by anchors, one arithmetic score, the best of each crop, then rules."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields
from pathlib import Path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import predicates
from ..functions.coerce import blank
from ..functions.predicates import any_of
from .rules import best_check_rule
from .sequence import settled

# The header that precedes a payee on its line, banks below which no bank is named, amounts on checks.
ANCHOR_HEADER = r"(?i)(pay\s*to\s*(the\s*)?order\s*of[: ]*|pay\s*to[: ]*|order\s*of[: ]*)"
LEAST_SURE = 0.55
CHECK_AMOUNT = r"\$\s*(\d{1,3}(?:,\d{3})*\.\d{2})"


@dataclass(frozen=True)
class Profile:
    """What a bank's crops look like and how its lines are scored. Heights are shares of the crop's."""

    bank: str = "generic"
    legacy: bool = False
    anchors: tuple[str, ...] = ("order of", "pay to")
    after: int = 3
    whole_crop: bool = True
    first_in_order: bool = False
    spatial: bool = False
    y_min: float = 0.13
    y_max: float = 0.38
    y_penalty_below: float = 0.12
    y_penalty_above: float = 0.55
    signatures: tuple[str, ...] = ("authorized sign",)
    signature_pairs: tuple[tuple[str, str], ...] = (("authorized", "sionature"), ("authorized", "signatur"))
    after_signature: float = 0.0
    # Never reached where after_signature is set: that is tested first.
    next_to_signature: float = 0.0
    business_words: tuple[str, ...] = ()
    business_penalty: float = 0.0
    business_names: tuple[str, ...] = ()
    business_name_penalty: float = 0.0
    payer_words: tuple[str, ...] = ()
    payer_penalty: float = -18.0
    payer_by_form: bool = False
    payer_form_penalty: float = -12.0
    payer_top: float = 0.22
    payer_top_penalty: float = -6.0

    @classmethod
    def of(cls, values: dict) -> Profile:
        """From a mapping with some of the fields; lists become tuples, unknown names are refused."""
        known = {f.name for f in fields(cls)}
        if unknown := set(values) - known:
            raise ValueError(f"no fields of a profile: {sorted(unknown)}")
        frozen = lambda v: tuple(map(frozen, v)) if isinstance(v, (list, tuple)) else v
        return cls(**{k: frozen(v) for k, v in values.items()})

    @classmethod
    def load(cls, folder: str, bank: str) -> Profile:
        """The bank's JSON file in the folder, else the one named generic, else the defaults."""
        for name in (bank.strip().lower(), "generic"):
            path = Path(folder) / f"{name}.json"
            if path.is_file():
                return cls.of(json.loads(path.read_text(encoding="utf-8")))
        return cls()

    @property
    def denied_bank(self) -> str | None:
        return None if self.bank == "generic" else self.bank


def is_clean(text: Column, profile: Profile | None = None) -> Column:
    clean = predicates.is_clean_payee(text)
    return clean if profile is None else clean & ~predicates.is_boilerplate(text, profile.denied_bank) & ~predicates.is_rejected_payee(text)


def is_anchor(text: Column, profile: Profile) -> Column:
    return F.lower(text).rlike(any_of(profile.anchors))


def is_signature(text: Column, profile: Profile) -> Column:
    low = F.lower(text)
    out = low.rlike(any_of(w.lower() for w in profile.signatures)) if profile.signatures else F.lit(False)
    for first, second in profile.signature_pairs:
        out = out | (low.contains(first.lower()) & low.contains(second.lower()))
    return out


def behind_anchor(text: Column) -> Column:
    """What an anchor's line holds beside the header."""
    bare = F.regexp_replace(text, ANCHOR_HEADER, "")
    return F.regexp_replace(F.regexp_replace(bare, r"^[ \-*:_$]+", ""), r"[ \-*:_$]+$", "")


def with_heights(lines: DataFrame, default: float = 329.0) -> DataFrame:
    """Adds y: a line's top as a share of its crop's height, the largest of its lines' y; from bbox (x, y, x, y, ...)."""
    ys = F.filter("bbox", lambda v, i: i % 2 == 1)
    height = F.max(F.array_max(ys)).over(Window.partitionBy("crop_id"))
    return lines.withColumn("__h", F.coalesce(F.when(height > 0, height), F.lit(default))).withColumn("y", F.array_min(ys) / F.col("__h")).drop("__h")


def candidates(lines: DataFrame, profile: Profile) -> DataFrame:
    """Candidates of crops' lines (crop_id, idx, text, confidence, y), with anchor, signature, reason and place.

    What follows the header on the first anchor's line; lines after it; then, if the whole crop is scanned, any other.
    None holds a dollar sign, an amount or a printed line of checks, and each is a clean name.
    """
    crop = Window.partitionBy("crop_id")
    text = blank(F.col("text"))
    marked = lines.withColumn("text", text).withColumn("anchor", F.min(F.when((F.col("text") != "") & is_anchor(F.col("text"), profile), F.col("idx"))).over(crop))
    marked = marked.withColumn("signature", F.min(F.when(is_signature(F.col("text"), profile), F.col("idx"))).over(crop))
    at, t = F.col("idx") == F.col("anchor"), F.col("text")
    usable = lambda x: is_clean(x, profile) & ~predicates.is_amount_line(x)
    accepted = (t != "") & ~t.contains("$") & ~(F.lower(t).contains("order") & is_anchor(t, profile)) & usable(t)
    near = F.coalesce(F.col("idx").between(F.col("anchor") + 1, F.col("anchor") + profile.after), F.lit(False))
    scanned = F.when(F.col("anchor").isNull(), "first_clean").otherwise("scan")
    sure = lambda default: F.coalesce(F.nullif(F.col("confidence").cast("double"), F.lit(0.0)), F.lit(default))
    found = lambda x, c, reason, place: F.struct(x.alias("candidate"), c.alias("confidence"), reason.alias("reason"), F.lit(place).alias("place"))
    rest = behind_anchor(t)
    own = F.when(F.coalesce(at, F.lit(False)) & usable(rest), found(rest, sure(0.9), F.lit("same_line"), 0))
    line = F.when(accepted & near, found(t, sure(0.9), F.lit("next_line"), 1))
    if profile.whole_crop:  # a line is one candidate, under the first reason that it has
        line = F.coalesce(line, F.when(accepted & ~F.coalesce(at & (rest == t) & usable(rest), F.lit(False)), found(t, sure(0.85), scanned, 2)))
    offered = marked.select("crop_id", "idx", "y", "anchor", "signature", F.explode(F.array_compact(F.array(own, line))).alias("c"))
    return offered.select("crop_id", "idx", "y", "anchor", "signature", "c.*")


def score(profile: Profile) -> Column:
    """Of a candidate: length, words, confidence, distance from the anchor, symbols, height, boilerplate and roles."""
    t, low, y, add = F.col("candidate"), F.lower("candidate"), F.col("y"), lambda test, value: F.when(test, value).otherwise(0.0)
    total = F.least(F.length(t), F.lit(40)) * 0.15 + add(t.contains(" "), 4.0) + F.col("confidence") * 2
    total = total + F.coalesce(F.greatest(F.lit(0.0), 6.0 - F.abs(F.col("idx") - F.col("anchor")) * 1.5), F.lit(0.0))
    total = total + add(t.rlike(r'[@!"\\|]'), -8.0) + add((F.regexp_count(t, F.lit(" ")) >= 2) & (F.length(t) >= 12), 2.0)
    if profile.spatial:
        total = total + F.when(y.between(profile.y_min, profile.y_max), 8.0).when(y < profile.y_penalty_below, -12.0).when(y > profile.y_penalty_above, -6.0).otherwise(0.0)
    total = total + add(predicates.is_boilerplate(t, profile.denied_bank), -100.0)
    if profile.business_words:
        total = total + add(low.rlike(any_of(profile.business_words)), profile.business_penalty)
    if profile.business_names:
        total = total + add(low.isin(*profile.business_names), profile.business_name_penalty)
    payer = low.rlike(any_of(profile.payer_words)) if profile.payer_words else F.lit(False)
    formed = F.lit(profile.payer_by_form) & predicates.is_payer_header(t)
    top = F.when(F.coalesce(y <= profile.payer_top, F.lit(False)), profile.payer_top_penalty).otherwise(0.0)
    total = total + F.when(payer, profile.payer_penalty).when(formed, profile.payer_form_penalty + top).otherwise(0.0)
    behind, next_ = F.col("idx") > F.col("signature"), F.col("idx") == F.col("signature") + 1
    signed = F.when(behind & F.lit(profile.after_signature != 0), profile.after_signature).when(next_, profile.next_to_signature).otherwise(0.0)
    return total + add(predicates.is_person_name(t), signed)


def extract(lines: DataFrame, profile: Profile | None = None) -> DataFrame:
    """crop_id, payee, confidence, score, reason of every crop: the highest score, the earliest line of equals.

    Without a candidate, the first clean line if the profile says so; else none, and the reason tells whether there was an anchor.
    """
    profile = profile or Profile()
    if profile.legacy:
        return legacy(lines)
    ranked = candidates(lines, profile).withColumn("score", score(profile))
    best = ranked.groupBy("crop_id").agg(F.max_by(F.struct("candidate", "confidence", "score", "reason"), F.struct("score", -F.col("idx"), -F.col("place"))).alias("b"))
    t = blank(F.col("text"))
    fallback = F.when(F.lit(profile.first_in_order) & is_clean(t, profile) & ~t.contains("$") & ~predicates.is_amount_line(t), F.struct(F.col("idx"), t.alias("text"), F.coalesce(F.nullif(F.col("confidence").cast("double"), F.lit(0.0)), F.lit(0.85)).alias("confidence")))
    crops = lines.groupBy("crop_id").agg(F.max(is_anchor(t, profile)).alias("anchored"), F.min(fallback).alias("f")).join(best, "crop_id", "left")
    reason = F.coalesce("b.reason", F.when(F.col("f").isNotNull(), "first_clean"), F.when(F.col("anchored"), "anchor_no_clean_candidate"), F.lit("no_clean_candidate"))
    return crops.select("crop_id", F.coalesce("b.candidate", "f.text", F.lit("")).alias("payee"), F.coalesce("b.confidence", "f.confidence", F.lit(0.0)).alias("confidence"), F.col("b.score").alias("score"), reason.alias("reason"))


def legacy(lines: DataFrame) -> DataFrame:
    """As extract(), without scores: what follows the first anchor's header, else the first of three lines behind it.

    A crop with an anchor and no such line has no payee; one without an anchor has its first clean line.
    """
    anchors = Profile()
    t = blank(F.col("text"))
    marked = lines.withColumn("text", t).withColumn("anchor", F.min(F.when(is_anchor(F.col("text"), anchors), F.col("idx"))).over(Window.partitionBy("crop_id")))
    usable = lambda x: is_clean(x) & ~predicates.is_amount_line(x)
    at, text, rest = F.col("idx") == F.col("anchor"), F.col("text"), behind_anchor(F.col("text"))
    near = F.col("idx").between(F.col("anchor") + 1, F.col("anchor") + 3) & ~text.contains("$") & ~F.lower(text).contains("order") & usable(text)
    sure = lambda default: F.coalesce(F.nullif(F.col("confidence").cast("double"), F.lit(0.0)), F.lit(default))
    pick = lambda test, x, c, reason: F.min(F.when(test, F.struct("idx", x.alias("payee"), c.alias("confidence"), F.lit(reason).alias("reason"))))
    crops = marked.groupBy("crop_id").agg(
        F.max("anchor").alias("anchor"), pick(at & usable(rest), rest, sure(0.9), "same_line").alias("own"), pick(near, text, sure(0.9), "next_line").alias("near"),
        pick(F.col("anchor").isNull() & ~text.contains("$") & usable(text), text, sure(0.85), "first_clean").alias("any"),
    )
    found = F.coalesce("own", "near", "any")
    reason = F.coalesce(found["reason"], F.when(F.col("anchor").isNotNull(), "anchor_no_clean_candidate").otherwise("no_clean_candidate"))
    return crops.select("crop_id", F.coalesce(found["payee"], F.lit("")).alias("payee"), F.coalesce(found["confidence"], F.lit(0.0)).alias("confidence"), F.lit(None).cast("double").alias("score"), reason.alias("reason"))


def extract_with_rules(lines: DataFrame, rules: DataFrame, profile: Profile | None = None, client: str = "") -> DataFrame:
    """As extract(), with the payee that the best check rule gives; a reason of another one ends with `+check_rule`."""
    profile = profile or Profile()
    found = settled(extract(lines, profile))  # read three times below
    asked = found.filter("payee <> ''").select("crop_id", F.col("payee").alias("text"), F.lit(client).alias("client"), F.lit(profile.denied_bank or "").alias("bank"))
    ruled = best_check_rule(asked, rules, ["crop_id"]).select("crop_id", F.col("payee").alias("__ruled"))
    out = found.join(ruled, "crop_id", "left")
    changed = F.col("__ruled").isNotNull() & (F.col("__ruled") != F.col("payee"))
    return out.withColumn("reason", F.when(changed, F.concat("reason", F.lit("+check_rule"))).otherwise(F.col("reason"))).withColumn("payee", F.coalesce("__ruled", "payee")).drop("__ruled")


def enrich_crops(crops: DataFrame, lines: DataFrame, rules: DataFrame, profile: Profile | None = None, client: str = "", first: int = 1, last: int | None = None) -> DataFrame:
    """crops (crop_id, page) with notes, extracted_payee, extracted_confidence and extracted_check_no.

    Only crops of imaging pages (first to last) whose text is that of a check are enriched; their payee only if it is
    clean. Others keep a null note.
    """
    profile = profile or Profile()
    scope = crops.filter((F.col("page") >= first) & (F.lit(True) if last is None else F.col("page") <= last)).select("crop_id")
    mine = lines.join(scope, "crop_id", "left_semi")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda s: s["text"]), "\n")
    checks = mine.groupBy("crop_id").agg(text.alias("raw")).filter(predicates.keyword_class(F.col("raw"))[0] == "check").select("crop_id")
    read = mine.join(checks, "crop_id", "left_semi")
    found = extract_with_rules(read if "y" in read.columns else with_heights(read), rules, profile, client)
    clean = is_clean(F.col("payee"), profile)
    named = found.select("crop_id", F.when(clean, F.col("payee")).alias("extracted_payee"), F.when(clean, F.round("confidence", 3)).alias("extracted_confidence"), F.lit("hybrid").alias("notes"))
    out = crops.join(named, "crop_id", "left")
    if "bbox" not in lines.columns:
        return out.withColumn("extracted_check_no", F.lit(None).cast("string"))
    return out.join(guess_check_number(read).withColumnRenamed("check_no", "extracted_check_no"), "crop_id", "left")


def detect_bank(statements: DataFrame, clients: dict[str, str], patterns: list[tuple[str, str]]) -> DataFrame:
    """bank and bank_confidence: 0.95 by a client prefix; by the text, the first pattern's bank that fits, at 0.75 and 0.1
    for each pattern that fits, up to 0.98. The surer one counts, the client's of equals; generic under LEAST_SURE.
    """
    client = F.lower(F.trim(F.regexp_replace(F.coalesce("client", F.lit("")), r"\s+", " ")))
    by_client = F.lit(None).cast("string")
    for prefix, bank in reversed(clients.items()):
        by_client = F.when(client.startswith(prefix), bank).otherwise(by_client)
    low, by_text, hits = F.lower(F.coalesce("text", F.lit(""))), F.lit(None).cast("string"), F.lit(0)
    for pattern, bank in reversed(patterns):
        by_text = F.when(low.rlike(pattern), bank).otherwise(by_text)
        hits = hits + low.rlike(pattern).cast("int")
    sure_text = F.when(hits > 0, F.least(0.75 + 0.1 * hits, F.lit(0.98))).otherwise(0.0)
    sure_client = F.when(by_client.isNotNull(), 0.95).otherwise(0.0)
    sure = F.greatest(sure_client, sure_text)
    bank = F.when(sure < LEAST_SURE, "generic").when(sure_client >= sure_text, by_client).otherwise(by_text)
    return statements.withColumn("bank", bank).withColumn("bank_confidence", sure)


def guess_check_number(lines: DataFrame) -> DataFrame:
    """crop_id and the number of the line that lies lowest and furthest left: the largest of least y less least x."""
    number = F.regexp_extract("text", r"\b(\d{3,6})\b", 1)
    odd = lambda start: F.array_min(F.filter("bbox", lambda v, i: i % 2 == start))
    found = lines.withColumn("n", number).filter((F.col("n") != "") & (F.size("bbox") >= 8))
    return found.groupBy("crop_id").agg(F.max_by("n", F.struct(odd(1) - odd(0), -F.col("idx"))).alias("check_no"))


def check_fields(tokens: DataFrame) -> DataFrame:
    """crop_id, check_no and amount from recognised tokens (crop_id, idx, text, xs, ys): by position and by form.

    The number is a token of 3 to 6 digits in the upper 0.4 and the right 0.55 of the tokens' extent, furthest up and
    right; the amount is the first with a dollar sign. Null where there is none.
    """
    middle = lambda c: (F.array_min(c) + F.array_max(c)) / 2
    crop = Window.partitionBy("crop_id")
    t = tokens.withColumn("text", blank(F.col("text"))).filter("text <> ''").withColumn("__x", middle("xs")).withColumn("__y", middle("ys"))
    t = t.withColumn("__right", F.max("__x").over(crop)).withColumn("__low", F.max("__y").over(crop))
    number = F.regexp_extract("text", r"^\*?\s*(\d{3,6})\s*\*?$", 1)
    inside = (number != "") & (F.col("__y") <= 0.4 * F.col("__low")) & (F.col("__x") >= 0.45 * F.col("__right")) & (F.col("__right") != 0) & (F.col("__x") - F.col("__y") > -1)
    amount = F.translate(F.regexp_extract("text", CHECK_AMOUNT, 1), ",", "").try_cast("double")
    return t.groupBy("crop_id").agg(
        F.max_by(F.when(inside, number), F.when(inside, F.struct(F.col("__x") - F.col("__y"), -F.col("idx")))).alias("check_no"),
        F.min_by(amount, F.when(amount.isNotNull(), F.col("idx"))).alias("amount"),
    )
