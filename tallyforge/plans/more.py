"""More operators as queries over the test tables; those without SQL are greedy or iterative."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import coerce, predicates
from ..operators import assembly, lines, matching, merging, payees, receivables, reports, rules
from ..sources import tables
from . import walks
from .queries import _ALL, _RECURSIVE, AS_OF, QUERIES, RULES, SQL, clients, legs, query, requests, table, transactions

__all__ = ["QUERIES", "SQL"]


@query("SELECT o_orderkey, CASE WHEN o_orderkey = 0 THEN repeat('0', 12) ELSE CAST(o_orderkey AS VARCHAR) END AS check_no FROM orders")
def check_number_normal(spark, sf):
    padded = F.concat(F.lit("No. "), F.lpad(F.col("o_orderkey").cast("string"), 12, "0"))
    return table(spark, sf, "orders").select("o_orderkey", coerce.check_number(padded).alias("check_no"))


@query("SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 0.0 ELSE round(o_totalprice, 2) END AS amount FROM orders")
def money_coercion(spark, sf):
    text = F.when(F.col("o_orderpriority") == "1-URGENT", "n/a").otherwise(F.concat(F.lit(" $"), F.format_number(F.round("o_totalprice", 2), 2)))
    return table(spark, sf, "orders").select("o_orderkey", coerce.money(text).alias("amount"))


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders")
def date_formats(spark, sf):
    d = F.col("o_orderdate")
    text = F.when(F.col("o_orderkey") % 2 == 0, F.date_format(d, "M/d/yyyy")).otherwise(F.date_format(d, "yyyy-MM-dd"))
    return table(spark, sf, "orders").select("o_orderkey", coerce.parse_date(text).alias("day"))


@query("SELECT event_type AS smoke_key, arg_max(event_id, event_id) AS rows, max(event_id) AS line_no FROM events GROUP BY 1")
def evidence_latest(spark, sf):
    line = F.concat(F.lit('SMOKE_EVIDENCE pdf="x" json={"smoke_key": "'), "event_type", F.lit('", "rows": '), F.col("event_id").cast("string"), F.lit("}"))
    log = table(spark, sf, "events").select(F.col("event_id").alias("line_no"), line.alias("value"))
    return tables.latest_evidence(log).select("smoke_key", "rows", "line_no")


@query("SELECT count(*) AS total, count(*) FILTER (WHERE o_orderstatus <> 'F') AS open FROM orders")
def feedback_open(spark, sf):
    status = F.when(F.col("o_orderstatus") == "F", "Closed").otherwise("new")
    return tables.feedback_counts(table(spark, sf, "orders").select(status.alias("status")))


@query(_ALL + "SELECT statement_id, ord FROM (SELECT *, row_number() OVER (PARTITION BY statement_id, check_no, lower(description), round(abs(amount) * 100) ORDER BY ord) AS k FROM legs) WHERE k = 1")
def dedupe_checks(spark, sf):
    return assembly.dedupe_checks(legs(spark, sf)).select("statement_id", "ord")


@query("SELECT min(CAST(o_orderdate AS DATE)) AS first_due, max(CAST(o_orderdate AS DATE)) AS last_due, count(DISTINCT o_orderpriority) AS types FROM orders")
def picker_bounds(spark, sf):
    return requests(spark, sf).agg(F.min("due_date").alias("first_due"), F.max("due_date").alias("last_due"), F.countDistinct("request_type").alias("types"))


@query("SELECT DISTINCT o_orderpriority AS request_type FROM orders UNION SELECT unnest(['Payroll', '2-HIGH'])")
def request_types(spark, sf):
    fixed = spark.createDataFrame([("Payroll",), ("2-HIGH",)], "request_type string")
    return requests(spark, sf).select("request_type").union(fixed).distinct()


def _library(spark):
    return spark.createDataFrame([(r.pattern, r.clean_payee, r.suggested_category, r.client_override, "2000-06-0" + str(r.ord)) for r in RULES], "pattern string, clean_payee string, suggested_category string, client_override string, last_used string")


_VALUES = "(VALUES ('purchase', 'Card Shop', '', '2000-06-01'), ('re:^(click|view)', 'Web Traffic', '', '2000-06-02'), ('error', '', '', '2000-06-03'), ('purch', 'Shadowed', '', '2000-06-04'), ('signup', 'Sign-up Desk', 'acme', '2000-06-05')) AS r(pattern, clean_payee, client_override, last_used)"


@query(f"SELECT pattern, last_used FROM {_VALUES} WHERE client_override = '' ORDER BY last_used DESC LIMIT 3")
def rules_library_top(spark, sf):
    return rules.library(_library(spark), "recent", "", 3).select("pattern", "last_used")


@query(f"SELECT count(*) AS total, count(*) FILTER (WHERE client_override <> '') AS client_specific, count(*) AS recent FROM {_VALUES}")
def rules_usage(spark, sf):
    return rules.usage(_library(spark), F.lit(AS_OF[:10]).cast("date"))


@query("SELECT event_id, CASE WHEN event_type = 'purchase' THEN 'Card Shop' WHEN event_type IN ('click', 'view') THEN 'Web Traffic' ELSE 'Sign-up Desk' END AS payee FROM events WHERE event_type <> 'error'")
def best_check_rule(spark, sf):
    checks = table(spark, sf, "events").select("event_id", F.col("event_type").alias("text"), F.lit("The Acme Co").alias("client"), F.lit("").alias("bank"))
    known = _library(spark).filter("clean_payee <> ''").select("pattern", F.col("clean_payee").alias("payee"), "client_override", F.lit("").alias("bank"), F.monotonically_increasing_id().alias("ord"))
    return rules.best_check_rule(checks, known, ["event_id"]).select("event_id", "payee")


@query("SELECT l_orderkey * 10 + l_linenumber AS crop_id, l_extendedprice AS priority FROM lineitem ORDER BY CASE WHEN l_orderkey * 10 + l_linenumber = 11 THEN 0 ELSE 1 END, l_extendedprice DESC, crop_id LIMIT 16")
def review_sample(spark, sf):
    rows = table(spark, sf, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("crop_id"), F.lit("x").alias("payee"), F.col("l_extendedprice").alias("priority"))
    return reports.review_sample(rows, [11], 16).select("crop_id", "priority")


@query("SELECT c_custkey AS crop_id, c_name AS old_payee, CASE WHEN c_acctbal < 0 THEN 'Changed' ELSE c_name END AS new_payee FROM customer WHERE c_acctbal < 0 OR c_mktsegment = 'BUILDING'")
def run_difference(spark, sf):
    c = table(spark, sf, "customer")
    before = c.select(F.col("c_custkey").alias("crop_id"), F.col("c_name").alias("payee"), F.lit("ranked").alias("reason"))
    after = c.select(F.col("c_custkey").alias("crop_id"), F.when(F.col("c_acctbal") < 0, "Changed").otherwise(F.col("c_name")).alias("payee"), F.when(F.col("c_mktsegment") == "BUILDING", F.lit(None)).otherwise("ranked").alias("reason"))
    return reports.run_difference(before, after, "crop_id").select("crop_id", "old_payee", "new_payee")


@query(_ALL + "SELECT client_id, CASE WHEN industry = 'Vehicles' THEN 'Autos' ELSE industry END AS industry FROM clients")
def edits_update(spark, sf):
    edits = clients(spark, sf).filter("industry = 'Vehicles'").select("client_id", F.lit("Autos").alias("industry"))
    return merging.update(clients(spark, sf), edits, "client_id")[0].select("client_id", "industry")


@query(_ALL + "SELECT CAST(request_id AS VARCHAR) AS request_id, 'Paid' AS status FROM requests WHERE request_type = '1-URGENT' AND status <> 'Paid'")
def dirty_rows(spark, sf):
    before = requests(spark, sf).select("request_id", "status")
    after = requests(spark, sf).select("request_id", F.when(F.col("request_type") == "1-URGENT", "Paid").otherwise(F.col("status")).alias("status"))
    return receivables.changed(before, after)


@query("SELECT page, string_agg(text, ' ' ORDER BY x, text) AS text FROM (SELECT o_custkey AS page, CAST(round_even(o_totalprice / 100000, 0) AS BIGINT) AS row, o_orderkey AS x, CAST(o_orderkey AS VARCHAR) AS text FROM orders) GROUP BY page, row")
def word_lines(spark, sf):
    words = table(spark, sf, "orders").select(F.col("o_custkey").alias("page"), F.col("o_orderkey").alias("x"), F.col("o_totalprice").alias("y"), F.col("o_orderkey").cast("string").alias("text"))
    return lines.assemble_words(words, 100000.0).select("page", "text")


@query(_ALL + "SELECT kind, count(*) AS n FROM (SELECT CASE WHEN description = 'error' THEN 'eft' ELSE 'other' END AS kind FROM ledger WHERE amount < 0 AND check_no = '') GROUP BY 1")
def eft_debits(spark, sf):
    rows = transactions(spark, sf).withColumn("description", F.when(F.col("description") == "error", "ACH payment").otherwise(F.col("description")))
    hit = F.when(predicates.is_eft(F.col("description"), F.col("amount"), F.col("check_no")), "eft").otherwise("other")
    return rows.filter("amount < 0 and check_no = ''").groupBy(hit.alias("kind")).agg(F.count("*").alias("n"))


@query(_RECURSIVE + walks.MATCHES)
def three_tier_match(spark, sf):
    both = legs(spark, sf)
    return matching.match_checks(both.filter("source = 'register'"), both.filter("source <> 'register'"))


@query(_RECURSIVE + walks.PAYEES)
def payee_merge(spark, sf):
    both = legs(spark, sf)
    checks = both.filter("source <> 'register'").select("statement_id", "ord", "check_no", F.concat(F.lit("Payee "), F.col("ord").cast("string")).alias("pay_to"), F.abs("amount").alias("amount"))
    return assembly.merge_payees(both.filter("source = 'register'"), checks).select("statement_id", "ord", "payee", "source")


@query("""SELECT DISTINCT CAST(user_id AS VARCHAR) AS statement_id, CAST(ts AS DATE) AS date, event_type || ' deposit' AS description, round(abs(value), 2) AS amount, 'credit' AS section
    FROM events WHERE value IS NOT NULL""")  # fmt: skip
def statement_parse(spark, sf):
    """Events as the lines of a statement: a heading, then dated rows."""
    e = table(spark, sf, "events")
    row = F.concat(F.date_format("ts", "MM/dd/yyyy"), F.lit(" "), "event_type", F.lit(" deposit "), F.format_string("%.2f", F.round(F.abs("value"), 2)))
    head = e.groupBy("user_id").agg(F.lit(-1).cast("long").alias("line_no")).select(F.col("user_id").cast("string").alias("statement_id"), "line_no", F.lit("DEPOSITS").alias("text"))
    body = e.filter("value is not null").select(F.col("user_id").cast("string").alias("statement_id"), F.col("event_id").alias("line_no"), row.alias("text"))
    return lines.parse_lines(head.unionByName(body), F.lit(2024)).select("statement_id", "date", "description", "amount", "section")


@query(None)
def crop_payees(spark, sf):
    """Lines of conversations as those of crops: the best candidate of each."""
    t = table(spark, sf, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("crop_id"), F.posexplode(F.split("text", "\n")).alias("idx", "text"))
    return payees.extract(t.withColumn("confidence", F.lit(0.9)).withColumn("y", F.lit(0.4)))
