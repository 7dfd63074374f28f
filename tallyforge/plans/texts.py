"""Operators on texts of the tables: lines of conversations as descriptions, words of benchmark items as patterns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import rules
from ..sources import fields
from .queries import QUERIES, SQL, query, table

__all__ = ["QUERIES", "SQL"]


def lines_of(spark, sf):
    """Each line of each conversation's turn: conv_id, turn, idx, description."""
    return table(spark, sf, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("idx", "description"))


def word_rules(spark, sf):
    """Words of five letters and more of the items as rules, in the order in which they first come up."""
    words = table(spark, sf, "benchmark").select("item_id", F.posexplode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("place", "pattern"))
    known = words.filter(F.length("pattern") >= 5).groupBy("pattern").agg(F.min(F.col("item_id") * 1000 + F.col("place")).alias("ord"))
    return known.select(
        "pattern", "ord", F.when(F.col("ord") % 4 == 0, "").otherwise(F.upper("pattern")).alias("clean_payee"), F.when(F.length("pattern") >= 8, "Long").otherwise("").alias("suggested_category"),
        F.when(F.col("ord") % 5 == 0, "Acme").when(F.col("ord") % 5 == 1, "Other").otherwise("").alias("client_override"), F.when(F.col("ord") % 3 == 0, "north").otherwise("").alias("bank"),
    )


_LINES = "SELECT conv_id, turn, CAST(generate_subscripts(parts, 1) - 1 AS INTEGER) AS idx, unnest(parts) AS description FROM (SELECT conv_id, turn, string_split(text, chr(10)) AS parts FROM conversations)"
_WORDS = "SELECT item_id, generate_subscripts(w, 1) - 1 AS place, unnest(w) AS pattern FROM (SELECT item_id, regexp_extract_all(text, '[A-Za-z]+') AS w FROM benchmark)"
_RULES = """SELECT *, CASE WHEN ord % 4 = 0 THEN '' ELSE upper(pattern) END AS clean_payee, CASE WHEN length(pattern) >= 8 THEN 'Long' ELSE '' END AS category,
    CASE ord % 5 WHEN 0 THEN 'Acme' WHEN 1 THEN 'Other' ELSE '' END AS owner, CASE WHEN ord % 3 = 0 THEN 'north' ELSE '' END AS bank
    FROM (SELECT pattern, min(item_id * 1000 + place) AS ord FROM words WHERE length(pattern) >= 5 GROUP BY pattern)"""
_TEXTS = f"WITH lines AS ({_LINES}), words AS ({_WORDS}), rules AS ({_RULES}), "


@query(_TEXTS + """hits AS (SELECT DISTINCT description, r.* FROM (SELECT DISTINCT description FROM lines), rules r
        WHERE contains(lower(description), lower(pattern)) AND owner IN ('', 'Acme') AND (clean_payee <> '' OR category <> '')),
    named AS (SELECT description, clean_payee AS payee FROM hits WHERE clean_payee <> '' AND trim(description) <> clean_payee
        QUALIFY row_number() OVER (PARTITION BY description ORDER BY owner = '', length(pattern) DESC, ord) = 1),
    filed AS (SELECT description, category FROM hits WHERE category <> ''
        QUALIFY row_number() OVER (PARTITION BY description ORDER BY owner = '', length(pattern) DESC, ord) = 1)
    SELECT conv_id, turn, idx, coalesce(payee, '') AS payee, coalesce(category, '') AS category, description IN (SELECT description FROM hits) AS matched
    FROM lines LEFT JOIN named USING (description) LEFT JOIN filed USING (description)""")  # fmt: skip
def rule_table_payees(spark, sf):
    """Every line by a table of rules, through the anchor index."""
    rows = lines_of(spark, sf).withColumns({"payee": F.lit(""), "category": F.lit("")})
    return rules.apply_rule_table(rows, word_rules(spark, sf), "acme").select("conv_id", "turn", "idx", "payee", "category", "matched")


@query(_TEXTS + """checks AS (SELECT *, CASE WHEN conv_id % 2 = 0 THEN 'The Acme Co' ELSE 'Harbor' END AS client, CASE WHEN turn % 2 = 0 THEN 'north' ELSE 'south' END AS branch FROM lines)
    SELECT conv_id, turn, idx, coalesce(nullif(clean_payee, ''), 'None') AS payee, pattern FROM checks JOIN rules ON contains(lower(description), lower(pattern))
        AND (owner = '' OR contains(lower(client), lower(owner))) AND (bank = '' OR bank = branch)
    QUALIFY row_number() OVER (PARTITION BY conv_id, turn, idx ORDER BY length(pattern) DESC, ord) = 1""")  # fmt: skip
def check_rule_payees(spark, sf):
    """Every line as a check's text, by the longest check rule of its client and bank."""
    checks = lines_of(spark, sf).select(
        "conv_id", "turn", "idx", F.col("description").alias("text"), F.when(F.col("conv_id") % 2 == 0, "The Acme Co").otherwise("Harbor").alias("client"), F.when(F.col("turn") % 2 == 0, "north").otherwise("south").alias("bank")
    )
    known = word_rules(spark, sf).withColumn("payee", F.coalesce(F.nullif("clean_payee", F.lit("")), F.lit("None")))
    return rules.best_check_rule(checks, known, ["conv_id", "turn", "idx"]).select("conv_id", "turn", "idx", "payee", "pattern")


@query(_TEXTS + """hits AS (SELECT pattern, count(DISTINCT description) AS texts FROM lines JOIN rules ON contains(lower(description), lower(pattern)) GROUP BY pattern)
    SELECT pattern, coalesce(texts, 0) AS texts FROM rules LEFT JOIN hits USING (pattern)""")  # fmt: skip
def pattern_texts(spark, sf):
    """Of every pattern, how many different lines hold it."""
    from ..operators import anchors

    known = word_rules(spark, sf).select("pattern")
    found = anchors.contained(lines_of(spark, sf).select(F.col("description").alias("text")), known).groupBy("pattern").agg(F.count("*").alias("texts"))
    return known.join(found, "pattern", "left").na.fill(0, ["texts"])


@query("""WITH o AS (SELECT CAST(o_orderkey AS VARCHAR) AS statement_id, * FROM orders),
    l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS i FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders))
    SELECT statement_id, 'Status' AS path, o_orderstatus AS value FROM o
    UNION ALL SELECT statement_id, 'Placed.Day', strftime(o_orderdate, '%Y-%m-%d') FROM o
    UNION ALL SELECT statement_id, 'Placed.By.Client', CAST(o_custkey AS VARCHAR) FROM o
    UNION ALL SELECT CAST(l_orderkey AS VARCHAR), 'Lines[' || i || '].Cents', CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS VARCHAR) FROM l
    UNION ALL SELECT CAST(l_orderkey AS VARCHAR), 'Lines[' || i || '].Marks[' || k || ']', CASE k WHEN 0 THEN l_returnflag ELSE l_linestatus END FROM l, (VALUES (0), (1)) AS v(k)""")  # fmt: skip
def field_leaves(spark, sf):
    """Orders and their lines as nested responses, unwrapped to leaves of three depths."""
    leaf = lambda name, value: F.struct(value.alias(name))
    inside = lambda **fields_: F.struct(F.struct(*[v.alias(k) for k, v in fields_.items()]).alias("valueObject"))
    mark = lambda flag, status: F.struct(flag.alias("valueString"), status.alias("content"))
    none = F.lit(None).cast("string")  # nulls are left out of the JSON

    def line(x):
        marks = F.array(mark(x["l_returnflag"], none), mark(none, x["l_linestatus"]))
        return inside(Cents=leaf("valueCurrency", leaf("amount", F.round(x["l_extendedprice"] * 100).cast("long"))), Marks=leaf("valueArray", marks))

    ordered = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag", "l_linestatus")))
    listed = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(ordered.alias("lines"))
    o = table(spark, sf, "orders").join(listed, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    lines = F.when(F.col("lines").isNotNull(), leaf("valueArray", F.transform("lines", line)))
    placed = inside(Day=leaf("valueDate", F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")), By=inside(Client=leaf("valueInteger", F.col("o_custkey"))))
    whole = F.to_json(inside(Lines=lines, Status=leaf("valueString", F.col("o_orderstatus")), Placed=placed))
    return fields.unwrapped(o.select(F.col("o_orderkey").cast("string").alias("statement_id"), whole.alias("json"))).select("statement_id", "path", "value")
