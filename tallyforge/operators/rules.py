"""Payee and category rules, compiled to one expression each, and check rules, which are joined."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.coerce import blank
from . import anchors
from .sequence import plain_unions

#: Rules that are compiled into one expression; more are joined as a table.
COMPILED = 200


@dataclass(frozen=True)
class Rule:
    pattern: str
    clean_payee: str = ""
    suggested_category: str = ""
    client_override: str = ""
    ord: int = 0


def matches(pattern: str, text: Column) -> Column:
    """`re:` begins a regular expression, anything else is a part of the text; in either case. A bad one never matches."""
    if not pattern.startswith("re:"):
        return F.lower(text).contains(pattern.lower())
    try:
        re.compile(pattern[3:])
    except re.error:
        return F.lit(False)
    return text.rlike("(?i)" + pattern[3:].replace("(?P<", "(?<"))


def in_order(rules: list[Rule], client: str) -> list[Rule]:
    """Those of the client or of all: the client's first, longer patterns first, then file order."""
    mine = [r for r in rules if r.client_override.strip().lower() in ("", client.strip().lower())]
    return sorted(mine, key=lambda r: (not r.client_override.strip(), -len(r.pattern), r.ord))


def apply_rules(rows: DataFrame, rules: list[Rule], client: str = "") -> DataFrame:
    """payee and category from the first matching rules, and `matched`.

    A payee is written if it is blank or the description, by the first rule with another payee than that; a category
    if it is blank or uncategorised, by the first rule with a category. `when` stops at the first match of a row.
    """
    text = F.coalesce(F.col("description"), F.lit(""))
    bare = F.trim(text)
    payee, category, hit = F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(False)
    for r in reversed(in_order(rules, client)):
        test = matches(r.pattern, text)
        if r.clean_payee.strip():
            payee = F.when(test & (bare != r.clean_payee.strip()), r.clean_payee).otherwise(payee)
        if r.suggested_category.strip() and r.suggested_category.strip().lower() != "uncategorized":
            category = F.when(test, r.suggested_category).otherwise(category)
        if r.clean_payee.strip() or r.suggested_category.strip():
            hit = hit | test
    old_payee, old_category = F.trim(F.coalesce("payee", F.lit(""))), F.lower(F.trim(F.coalesce("category", F.lit(""))))
    return rows.select(
        *[c for c in rows.columns if c not in ("payee", "category")],
        F.when((old_payee == "") | (old_payee == bare), F.coalesce(payee, "payee")).otherwise(F.col("payee")).alias("payee"),
        F.when(old_category.isin("", "uncategorized"), F.coalesce(category, "category")).otherwise(F.col("category")).alias("category"),
        hit.alias("matched"),
    )


def apply_rule_table(rows: DataFrame, rules: DataFrame, client: str = "") -> DataFrame:
    """What apply_rules() gives, for rules in a table (pattern, clean_payee, suggested_category, client_override, ord) of any size.

    Each different description meets the patterns that occur in it (anchors.occurrences), and the first of them by
    precedence decide. Rules of equal precedence, one pattern and one ord, are taken by payee and category. Null patterns
    match nothing; null descriptions are empty.
    """
    plain_unions(rows.sparkSession)
    text = F.coalesce("description", F.lit(""))
    known = rules.select("pattern", *[blank(F.col(c)).alias(f"__{c}") if c == "client_override" else F.coalesce(c, F.lit("")).alias(f"__{c}") for c in ("clean_payee", "suggested_category", "client_override")], F.col("ord").alias("__ord"))
    mine = known.filter((F.col("__client_override") == "") | (F.lower("__client_override") == client.strip().lower()))
    named, filed = F.trim("__clean_payee") != "", F.trim("__suggested_category") != ""
    mine = mine.filter(named | filed)
    texts = rows.select(text.alias("text")).distinct()
    hits = anchors.occurrences(texts, mine).join(mine, "pattern")
    rank = F.struct(F.col("__client_override") == "", -F.length("pattern"), "__ord", "__clean_payee", "__suggested_category")
    payee = F.when(named & (F.trim("text") != F.trim("__clean_payee")), rank)
    category = F.when(filed & (F.lower(F.trim("__suggested_category")) != "uncategorized"), rank)
    best = hits.groupBy(F.col("text").alias("__text")).agg(F.min_by("__clean_payee", payee).alias("__payee"), F.min_by("__suggested_category", category).alias("__category"))
    out = rows.join(best, text == F.col("__text"), "left")
    old_payee, old_category = F.trim(F.coalesce("payee", F.lit(""))), F.lower(F.trim(F.coalesce("category", F.lit(""))))
    return out.select(
        *[c for c in rows.columns if c not in ("payee", "category")],
        F.when((old_payee == "") | (old_payee == F.trim(text)), F.coalesce("__payee", "payee")).otherwise(F.col("payee")).alias("payee"),
        F.when(old_category.isin("", "uncategorized"), F.coalesce("__category", "category")).otherwise(F.col("category")).alias("category"),
        F.col("__text").isNotNull().alias("matched"),
    )


def best_check_rule(checks: DataFrame, rules: DataFrame, key: list[str]) -> DataFrame:
    """The longest, then first, check rule whose pattern the text holds; its client must be part of the check's client,
    and banks must agree if both are known. checks: key, text, client, bank; rules: pattern, payee, client_override, bank, ord.

    Each different text meets the patterns that occur in it (anchors.occurrences); clients and banks are compared for
    those. Of rules of one length and ord the least payee and pattern decide.
    """
    plain_unions(checks.sparkSession)
    every = checks.select("text", "client", "bank").distinct()
    r = rules.select("pattern", "payee", F.coalesce("client_override", F.lit("")).alias("__client"), F.coalesce("bank", F.lit("")).alias("__bank"), F.col("ord").alias("__ord"))
    hits = anchors.occurrences(every, r).join(r, "pattern").join(every, "text")
    client = (F.col("__client") == "") | F.lower("client").contains(F.lower("__client"))
    bank = (F.col("__bank") == "") | (F.coalesce("bank", F.lit("")) == "") | (F.col("bank") == F.col("__bank"))
    rank = F.struct(F.length("pattern"), -F.col("__ord"), "payee", "pattern")
    best = hits.filter(client & bank).groupBy("text", "client", "bank").agg(F.max_by(F.struct("payee", "pattern"), rank).alias("__best"))
    same = [F.col(f"c.{c}").eqNullSafe(F.col(f"h.{c}")) for c in ("text", "client", "bank")]
    return checks.alias("c").join(best.alias("h"), same).select("c.*", "h.__best.payee", "h.__best.pattern")


def library(rules: DataFrame, sort: str = "recent", scope: str | None = None, limit: int = 25) -> DataFrame:
    """Rules by last use, by length of pattern or by alphabet; scope: a client, or `` for rules of all."""
    if scope is not None:
        rules = rules.filter(F.lower(F.coalesce("client_override", F.lit(""))) == scope.lower())
    orders = {"recent": [F.desc_nulls_last("last_used"), "pattern"], "longest": [F.desc(F.length("pattern")), "pattern"], "alpha": ["pattern"]}
    return rules.orderBy(*orders[sort]).limit(limit)


def usage(rules: DataFrame, as_of: Column) -> DataFrame:
    recent = F.datediff(as_of, F.try_to_date("last_used")) <= 30
    return rules.agg(F.count("*").alias("total"), F.count_if(F.coalesce("client_override", F.lit("")) != "").alias("client_specific"), F.count_if(F.coalesce(recent, F.lit(False))).alias("recent"))


def touch(rules: DataFrame, fired: DataFrame, day: str) -> DataFrame:
    """last_used set to the day on rules whose pattern is in fired."""
    marked = rules.join(fired.select("pattern").distinct().withColumn("__hit", F.lit(True)), "pattern", "left")
    return marked.withColumn("last_used", F.when(F.col("__hit"), F.lit(day)).otherwise(F.col("last_used"))).select(rules.columns)


def fired(rows: DataFrame, rules: list[Rule], client: str = "") -> tuple[DataFrame, int, int]:
    """(patterns that matched, rows_changed, rules_used): rows that any rule with a payee or category matches, and
    different patterns among those. One pass; each rule is counted in a column of its own.
    """
    text = F.coalesce(F.col("description"), F.lit(""))
    mine = [r for r in in_order(rules, client) if r.clean_payee.strip() or r.suggested_category.strip()]
    tests = [matches(r.pattern, text) for r in mine]
    hit = F.lit(False)
    for t in tests:
        hit = hit | t
    row = rows.agg(F.count_if(hit), *[F.max(t) for t in tests]).first()
    used = sorted({r.pattern for r, on in zip(mine, row[1:], strict=True) if on})
    spark = rows.sparkSession
    return spark.createDataFrame([(p,) for p in used], "pattern string"), row[0], len(used)


def match_count(rows: DataFrame, pattern: str) -> int:
    """Rows whose description the pattern matches; none of a blank one."""
    return rows.filter(matches(pattern, F.coalesce("description", F.lit("")))).count() if pattern.strip() else 0


def bootstrap(rules: DataFrame | None, seed: DataFrame) -> DataFrame:
    """The rules with a pattern, or the seed where there are none."""
    if rules is None:
        return seed
    kept = rules.filter(F.trim(F.coalesce("pattern", F.lit(""))) != "")
    return seed if kept.isEmpty() else kept


def fired_table(rows: DataFrame, rules: DataFrame, client: str = "") -> DataFrame:
    """pattern: those of the client's rules with a payee or a category that occur in a description."""
    owner = F.lower(blank(F.col("client_override")))
    mine = rules.filter(owner.isin("", client.strip().lower()) & ((F.trim(F.coalesce("clean_payee", F.lit(""))) != "") | (F.trim(F.coalesce("suggested_category", F.lit(""))) != "")))
    return anchors.occurrences(rows.select(F.coalesce("description", F.lit("")).alias("text")), mine).select("pattern").distinct()


def post_process(rows: DataFrame, rules: DataFrame | None, seed: DataFrame, client: str = "", day: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(ledger, rules): payees and categories by the rules, or the seed's where there are none; with a day, the rules that
    matched carry it. Up to COMPILED rules are compiled on the driver, in the order they come; more stay a table, in
    the order of `ord`, which such a table must have.
    """
    known = bootstrap(rules, seed)
    listed = known.limit(COMPILED + 1).collect()
    if len(listed) > COMPILED:
        columns = ("clean_payee", "suggested_category", "client_override")
        full = known.withColumns({c: F.lit("") for c in columns if c not in known.columns})
        return apply_rule_table(rows, full, client), known if day is None else touch(known, fired_table(rows, full, client), day)
    text = lambda r, c: (r[c] if c in known.columns else "") or ""
    compiled = [Rule(r["pattern"], text(r, "clean_payee"), text(r, "suggested_category"), text(r, "client_override"), i) for i, r in enumerate(listed)]
    out = apply_rules(rows, compiled, client)
    return out, known if day is None else touch(known, fired(rows, compiled, client)[0], day)
