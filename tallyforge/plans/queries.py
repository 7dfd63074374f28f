"""The reference operators as queries over the test tables, each with the SQL that it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import coerce, predicates
from ..operators import assembly, merging, receivables, reports, rules
from ..operators.pieces import Ordered
from . import walks

#: The present of every query.
AS_OF = "2000-06-15 12:00:00"
STATES = {"F": "Paid", "O": "Pending", "P": "Received"}
INDUSTRIES = {"Vehicles": ["AUTO"], "Works": ["BUILD", "MACHIN"], "Homes": ["HOUSE", "FURNI"]}
RULES = [rules.Rule("purchase", "Card Shop", "Sales", "", 1), rules.Rule("re:^(click|view)", "Web Traffic", "Marketing", "", 2), rules.Rule("error", "", "Faults", "", 3), rules.Rule("purch", "Shadowed", "Never", "", 4), rules.Rule("signup", "Sign-up Desk", "", "acme", 5)]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def as_of():
    return F.lit(AS_OF).cast("timestamp")


def clients(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as clients. One market segment is left out, so that some requests have no client."""
    c = table(spark, sf, "customer").filter("c_mktsegment <> 'MACHINERY'")
    return c.select(F.col("c_custkey").alias("client_id"), F.col("c_name").alias("business_name"), predicates.in_bucket(F.col("c_mktsegment"), INDUSTRIES).alias("industry"))


def requests(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as requests."""
    o = table(spark, sf, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "Paid").when(F.col("o_orderstatus") == "O", "Pending").otherwise("Received")
    return o.select(F.col("o_orderkey").alias("request_id"), F.col("o_custkey").alias("client_id"), status.alias("status"), F.col("o_totalprice").alias("amount_due"), F.col("o_orderdate").cast("date").alias("due_date"), F.col("o_orderpriority").alias("request_type"), (F.col("o_orderkey") % 3 == 0).alias("bank_statement_received"), (F.col("o_orderkey") % 5 == 0).alias("sales_report_received"), F.col("o_orderkey").alias("ord"))


def transactions(spark: SparkSession, sf: str) -> DataFrame:
    """Events as ledger rows of a user's statement."""
    e = table(spark, sf, "events")
    sign = F.when(F.col("event_type") == "purchase", 1.0).otherwise(-1.0)
    return e.select(
        F.col("user_id").cast("string").alias("statement_id"), F.col("event_id").alias("ord"), F.date_format("ts", "yyyy-MM-dd").alias("date"), F.date_format("ts", "yyyy-MM").alias("year_month"),
        F.col("event_type").alias("description"), F.lit("").alias("payee"), F.round(F.col("value") * sign, 2).alias("amount"), F.lit("").alias("category"),
        F.when(F.col("event_id") % 7 == 0, (F.col("event_id") % 50).cast("string")).otherwise("").alias("check_no"),
        F.when(F.col("event_id") % 4 == 0, "Medium").otherwise("High").alias("confidence"), F.when(F.col("event_id") % 10 == 0, "Yes").otherwise("No").alias("needs_review"),
    )


def legs(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines as a register (not returned) and a check leg (returned) of a supplier's monthly statement."""
    crop = F.col("l_returnflag") == "R"
    return table(spark, sf, "lineitem").select(
        F.concat_ws("-", "l_suppkey", F.date_format("l_shipdate", "yyyy-MM")).alias("statement_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"), F.when(crop, "check_image_crop").otherwise("register").alias("source"),
        F.when(F.col("l_linenumber") % 3 == 0, "").otherwise((F.col("l_orderkey") % 50).cast("string")).alias("check_no"), F.lit("").alias("payee"), F.col("l_returnflag").alias("description"),
        (-F.floor(F.col("l_extendedprice") / 100)).cast("double").alias("amount"),
    )


_CLIENTS = "SELECT c_custkey AS client_id, c_name AS business_name, CASE WHEN c_mktsegment LIKE '%AUTO%' THEN 'Vehicles' WHEN c_mktsegment LIKE '%BUILD%' OR c_mktsegment LIKE '%MACHIN%' THEN 'Works' WHEN c_mktsegment LIKE '%HOUSE%' OR c_mktsegment LIKE '%FURNI%' THEN 'Homes' ELSE 'Other' END AS industry FROM customer WHERE c_mktsegment <> 'MACHINERY'"
_REQUESTS = "SELECT o_orderkey AS request_id, o_custkey AS client_id, CASE o_orderstatus WHEN 'F' THEN 'Paid' WHEN 'O' THEN 'Pending' ELSE 'Received' END AS status, o_totalprice AS amount_due, CAST(o_orderdate AS DATE) AS due_date, o_orderpriority AS request_type, o_orderkey % 3 = 0 AS bank_ok, o_orderkey % 5 = 0 AS sales_ok FROM orders"
_LEDGER = "SELECT CAST(user_id AS VARCHAR) AS statement_id, event_id AS ord, strftime(ts, '%Y-%m-%d') AS date, strftime(ts, '%Y-%m') AS year_month, event_type AS description, round(value * CASE WHEN event_type = 'purchase' THEN 1.0 ELSE -1.0 END, 2) AS amount, CASE WHEN event_id % 7 = 0 THEN CAST(event_id % 50 AS VARCHAR) ELSE '' END AS check_no, CASE WHEN event_id % 4 = 0 THEN 'Medium' ELSE 'High' END AS confidence, CASE WHEN event_id % 10 = 0 THEN 'Yes' ELSE 'No' END AS needs_review FROM events"
_LEGS = "SELECT concat(l_suppkey, '-', strftime(l_shipdate, '%Y-%m')) AS statement_id, l_orderkey * 10 + l_linenumber AS ord, CASE WHEN l_returnflag = 'R' THEN 'check_image_crop' ELSE 'register' END AS source, CASE WHEN l_linenumber % 3 = 0 THEN '' ELSE CAST(l_orderkey % 50 AS VARCHAR) END AS check_no, -floor(l_extendedprice / 100) AS amount, l_returnflag AS description FROM lineitem"


def _with(**views: str) -> str:
    return "WITH " + ", ".join(f"{k} AS ({v})" for k, v in views.items()) + " "


_ALL = _with(clients=_CLIENTS, requests=_REQUESTS, ledger=_LEDGER, legs=_LEGS)
_RECURSIVE = f"WITH RECURSIVE legs AS ({_LEGS}), "


@query(_ALL + """SELECT c.client_id, business_name, industry, round(coalesce(sum(amount_due) FILTER (WHERE status IN ('Pending', 'Received', 'Invoiced')), 0), 2) AS total_due,
    count(request_id) AS n_requests, coalesce(arg_max(status, request_id), '') AS last_status FROM clients c LEFT JOIN requests r USING (client_id) GROUP BY ALL""")  # fmt: skip
def roster_receivables(spark, sf):
    return receivables.roster(clients(spark, sf), requests(spark, sf)).withColumn("total_due", F.round("total_due", 2))


_LATE = f"status IN ('Pending', 'Received') AND CAST(due_date AS TIMESTAMP) < TIMESTAMP '{AS_OF}'"


@query(_ALL + f"""SELECT request_id, status, due_date, greatest(DATE '{AS_OF[:10]}' - due_date, 0) AS days_overdue FROM requests WHERE {_LATE} ORDER BY due_date, days_overdue DESC, request_id LIMIT 10""")
def overdue_priority(spark, sf):
    return receivables.priority(requests(spark, sf), as_of()).select("request_id", "status", "due_date", F.col("days_overdue").cast("long").alias("days_overdue"))


@query(_ALL + "SELECT request_id, status, due_date FROM requests ORDER BY CAST(due_date AS VARCHAR) DESC, request_id LIMIT 8")
def recent_requests(spark, sf):
    return receivables.recent(requests(spark, sf)).select("request_id", "status", "due_date")


@query(_ALL + f"SELECT count(*) AS overdue, round(sum(amount_due), 2) AS amount, max(greatest(DATE '{AS_OF[:10]}' - due_date, 0)) AS max_days FROM requests WHERE {_LATE}")
def overdue_header(spark, sf):
    return receivables.priority_header(requests(spark, sf), as_of()).select("overdue", F.round("amount", 2).alias("amount"), F.col("max_days").cast("long").alias("max_days"))


@query(_ALL + f"SELECT request_id, client_id, status FROM requests WHERE {_LATE}")
def filter_preset_overdue(spark, sf):
    return receivables.apply_filters(requests(spark, sf), receivables.Filters("overdue"), as_of()).select("request_id", "client_id", "status")


@query(_ALL + "SELECT request_id, client_id, status FROM requests WHERE due_date >= DATE '2000-06-01' AND due_date < DATE '2000-07-01'")
def filter_preset_month(spark, sf):
    return receivables.apply_filters(requests(spark, sf), receivables.Filters("month"), as_of()).select("request_id", "client_id", "status")


@query(_ALL + "SELECT request_id, client_id, status FROM requests WHERE status IN ('Pending', 'Received') AND NOT (bank_ok AND sales_ok)")
def filter_preset_missing_docs(spark, sf):
    return receivables.apply_filters(requests(spark, sf), receivables.Filters("missing"), as_of()).select("request_id", "client_id", "status")


@query(_ALL + "SELECT request_id, client_id, status FROM requests WHERE due_date BETWEEN DATE '1999-01-01' AND DATE '1999-12-31' AND status IN ('Pending', 'Paid') AND request_type IN ('1-URGENT', '2-HIGH')")
def filter_fine_tune(spark, sf):
    f = receivables.Filters(start="1999-01-01", end="1999-12-31", statuses=["Pending", "Paid"], types=["1-URGENT", "2-HIGH"])
    return receivables.apply_filters(requests(spark, sf), f, as_of()).select("request_id", "client_id", "status")


@query(_ALL + "SELECT request_id, client_id FROM requests WHERE client_id IN (SELECT client_id FROM clients WHERE industry = 'Vehicles')")
def industry_semi_join(spark, sf):
    return receivables.of_industries(requests(spark, sf), clients(spark, sf), ["Vehicles"]).select("request_id", "client_id")


@query(_ALL + "SELECT request_id, client_id FROM requests WHERE client_id NOT IN (SELECT client_id FROM clients)")
def unknown_client_anti_join(spark, sf):
    return receivables.unknown_clients(requests(spark, sf), clients(spark, sf)).select("request_id", "client_id")


@query(_ALL + "SELECT request_id, business_name FROM requests JOIN clients USING (client_id)")
def requests_with_clients(spark, sf):
    return requests(spark, sf).join(clients(spark, sf), "client_id").select("request_id", "business_name")


@query(_ALL + "SELECT strftime(due_date, '%Y-%m') AS month, status, count(*) AS n, round(sum(amount_due), 2) AS amount FROM requests GROUP BY ALL")
def monthly_status(spark, sf):
    return receivables.monthly(requests(spark, sf)).withColumn("amount", F.round("amount", 2))


@query(_ALL + "SELECT status, count(*) AS n FROM requests GROUP BY ALL")
def status_histogram(spark, sf):
    return requests(spark, sf).groupBy("status").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "status")


@query(_ALL + f"""SELECT (SELECT count(*) FROM clients) AS clients, round(sum(amount_due) FILTER (WHERE status IN ('Pending', 'Received')), 2) AS pending_amount,
    count(*) FILTER (WHERE {_LATE}) AS overdue, round_even(100.0 * count(*) FILTER (WHERE status = 'Paid') / count(*), 1) AS paid_pct FROM requests""")  # fmt: skip
def kpis(spark, sf):
    return receivables.kpis(clients(spark, sf), requests(spark, sf), as_of()).withColumn("pending_amount", F.round("pending_amount", 2))


@query(_ALL + "SELECT count(*) FILTER (WHERE NOT bank_ok) AS bank, count(*) FILTER (WHERE NOT sales_ok) AS sales, count(*) FILTER (WHERE NOT (bank_ok AND sales_ok)) AS either, count(*) FILTER (WHERE NOT bank_ok AND NOT sales_ok) AS \"both\" FROM requests WHERE status IN ('Pending', 'Received')")
def missing_docs(spark, sf):
    return receivables.missing_counts(requests(spark, sf))


@query(_ALL + "SELECT client_id, business_name FROM clients WHERE regexp_matches(business_name, '(?i)r#0*1[0-4]')")
def roster_search(spark, sf):
    return receivables.search(clients(spark, sf), "R#0*1[0-4]", "business_name").select("client_id", "business_name")


@query(_ALL + """SELECT statement_id, count(*) AS n, round(coalesce(sum(amount) FILTER (WHERE amount > 0), 0), 2) AS deposits, round(coalesce(-sum(amount) FILTER (WHERE amount < 0), 0), 2) AS withdrawals,
    count(*) FILTER (WHERE check_no <> '') AS checks, greatest(count(*) FILTER (WHERE confidence <> 'High'), count(*) FILTER (WHERE needs_review = 'Yes')) AS to_review FROM ledger GROUP BY ALL""")  # fmt: skip
def statement_metrics(spark, sf):
    m = reports.metrics(transactions(spark, sf), ["statement_id"])
    return m.withColumns({"deposits": F.round("deposits", 2), "withdrawals": F.round("withdrawals", 2)})


@query(_ALL + "SELECT CASE WHEN check_no <> '' THEN 'check' WHEN amount > 0 THEN 'credit' WHEN amount < 0 THEN 'debit' ELSE 'other' END AS kind, count(*) AS n, round(sum(abs(amount)), 2) AS total FROM ledger GROUP BY ALL")
def section_totals(spark, sf):
    return reports.section_totals(transactions(spark, sf)).withColumn("total", F.round("total", 2))


def _ruled(spark, sf):
    return rules.apply_rules(transactions(spark, sf), RULES)


_RULED = "SELECT *, CASE WHEN description LIKE '%purchase%' THEN 'Card Shop' WHEN regexp_matches(description, '^(click|view)') THEN 'Web Traffic' ELSE '' END AS payee, CASE WHEN description LIKE '%purchase%' THEN 'Sales' WHEN regexp_matches(description, '^(click|view)') THEN 'Marketing' WHEN description LIKE '%error%' THEN 'Faults' ELSE '' END AS category FROM ledger"


@query(_ALL + f"SELECT ord, payee, category, category <> '' AS matched FROM ({_RULED})")
def rules_payee_category(spark, sf):
    return _ruled(spark, sf).select("ord", "payee", "category", "matched")


@query(_ALL + f"SELECT coalesce(nullif(category, ''), 'Uncategorized') AS category, year_month, round(sum(amount), 2) AS value, round(sum(sum(amount)) OVER (PARTITION BY coalesce(nullif(category, ''), 'Uncategorized')), 2) AS total FROM ({_RULED}) GROUP BY 1, 2")
def pivot_category_month(spark, sf):
    return reports.pivot_long(_ruled(spark, sf), "category").withColumns({"value": F.round("value", 2), "total": F.round("total", 2)})


@query(_ALL + f"SELECT coalesce(nullif(payee, ''), '(no payee)') AS payee, count(*) FILTER (WHERE year_month = '2024-01') AS \"2024-01\", count(*) AS \"Total\" FROM ({_RULED}) GROUP BY 1")
def pivot_payee_wide(spark, sf):
    return reports.pivot_wide(_ruled(spark, sf), "payee", ["2024-01"], "count")


@query(_ALL + f"SELECT payee, round(sum(amount), 2) AS total, count(*) AS n FROM ({_RULED}) GROUP BY 1 ORDER BY abs(sum(amount)) DESC, payee LIMIT 3")
def top_payees(spark, sf):
    return reports.top_payees(_ruled(spark, sf), 3).withColumn("total", F.round("total", 2))


@query(_ALL + """, found AS (SELECT statement_id, coalesce(sum(amount) FILTER (WHERE amount > 0), 0) AS deposits, coalesce(-sum(amount) FILTER (WHERE amount < 0), 0) AS withdrawals, count(*) FILTER (WHERE check_no <> '') AS checks, count(*) AS n FROM ledger GROUP BY 1),
    kinds AS (SELECT *, CAST(statement_id AS BIGINT) % 4 AS k FROM found)
    SELECT statement_id, CASE k WHEN 0 THEN 'no_reference' WHEN 1 THEN 'match' ELSE 'mismatch' END AS status, CASE k WHEN 2 THEN 'deposits' WHEN 3 THEN 'transactions' ELSE '' END AS differences FROM kinds""")  # fmt: skip
def reconcile_totals(spark, sf):
    found = reports.totals(transactions(spark, sf))
    k = F.col("statement_id").cast("long") % 4
    given = lambda c, more: F.when(k != 0, F.col(c) + more)
    reported = found.select("statement_id", given("deposits", F.when(k == 2, 5.0).otherwise(0.0)).alias("deposits"), F.lit(None).cast("double").alias("withdrawals"), given("checks", 0).alias("checks"), given("transactions", F.when(k == 3, 1).otherwise(0)).alias("transactions"))
    return reports.reconcile(found, reported)


@query(_ALL + "SELECT statement_id, date, description, amount, check_no, ord FROM legs_first".replace("legs_first", "(SELECT *, '' AS date, row_number() OVER (PARTITION BY statement_id, description, amount, check_no ORDER BY ord) AS k FROM legs) WHERE k = 1"))
def dedupe_keep_first(spark, sf):
    return assembly.dedupe_transactions(legs(spark, sf).withColumn("date", F.lit(""))).select("statement_id", "date", "description", "amount", "check_no", "ord")


_DEDUPED = """, numbered AS (SELECT ord FROM (SELECT ord, row_number() OVER (PARTITION BY statement_id, CASE WHEN ltrim(check_no, '0') = '' THEN check_no ELSE ltrim(check_no, '0') END, amount ORDER BY ord) AS k FROM legs WHERE check_no <> '') WHERE k = 1),
    crops AS (SELECT *, CAST(round(abs(amount) * 100) AS BIGINT) AS c FROM legs l WHERE check_no = '' AND source = 'check_image_crop' AND NOT EXISTS (SELECT 1 FROM legs r WHERE r.source = 'register' AND r.amount < 0 AND r.statement_id = l.statement_id AND abs(abs(r.amount) - abs(l.amount)) < 0.011)),
    kept AS (SELECT ord FROM (SELECT ord, c, row_number() OVER (PARTITION BY statement_id, c ORDER BY ord) AS k FROM crops) WHERE k = 1 OR c = 0)
    SELECT ord FROM numbered UNION ALL SELECT ord FROM legs WHERE check_no = '' AND source = 'register' UNION ALL SELECT ord FROM kept"""  # fmt: skip


@query(_ALL + _DEDUPED)
def dedupe_register_debit(spark, sf):
    return assembly.assembly_dedupe(legs(spark, sf)).select("ord")


_CHECKS = "SELECT * FROM legs WHERE source = 'check_image_crop'"


@query(_ALL + f""", c AS ({_CHECKS}), ok AS (SELECT *, abs(amount) AS a FROM c WHERE amount <> 0 AND abs(amount) <= 10000), r AS (SELECT statement_id, list_sort(list(a)) AS v, count(*) AS n FROM ok GROUP BY 1),
    p AS (SELECT *, CAST(least(greatest(floor((n + 1) / 4), 1), n - 1) AS BIGINT) AS j1, CAST(least(greatest(floor(3 * (n + 1) / 4), 1), n - 1) AS BIGINT) AS j3 FROM r),
    q AS (SELECT *, (v[j1] * (4 - ((n + 1) - 4 * j1)) + v[j1 + 1] * ((n + 1) - 4 * j1)) / 4 AS q1, (v[j3] * (4 - (3 * (n + 1) - 4 * j3)) + v[j3 + 1] * (3 * (n + 1) - 4 * j3)) / 4 AS q3 FROM p)
    SELECT ok.statement_id, ord, amount FROM ok JOIN q USING (statement_id) WHERE n < 4 OR check_no <> '' OR a <= q3 + greatest(3 * (q3 - q1), 500)""")  # fmt: skip
def outlier_iqr_exclusive(spark, sf):
    return assembly.drop_outliers(legs(spark, sf).filter("source = 'check_image_crop'")).select("statement_id", "ord", "amount")


@query(_ALL + f""", c AS (SELECT *, abs(amount) AS a, median(abs(amount)) OVER (PARTITION BY statement_id) AS m FROM ({_CHECKS})), k AS (SELECT *, row_number() OVER (PARTITION BY statement_id, check_no ORDER BY abs(a - m), ord) AS k FROM c)
    SELECT statement_id, ord, check_no FROM k WHERE check_no = '' OR k = 1""")  # fmt: skip
def dup_check_median_pick(spark, sf):
    checks = legs(spark, sf).filter("source = 'check_image_crop'")
    return assembly.median_pick(checks).select("statement_id", "ord", "check_no")


@query(_ALL + """SELECT statement_id, count(*) FILTER (WHERE source = 'register') AS n_register, count(*) FILTER (WHERE source <> 'register') AS n_checks,
    count(*) FILTER (WHERE source = 'register') < 3 OR (count(*) FILTER (WHERE source <> 'register') > 0 AND count(*) FILTER (WHERE source = 'register') < count(*) FILTER (WHERE source <> 'register')) AS incomplete FROM legs GROUP BY 1""")  # fmt: skip
def register_gate(spark, sf):
    both = legs(spark, sf)
    return assembly.gate(both.filter("source = 'register'"), both.filter("source <> 'register'"))


@query(_ALL + """, c AS (SELECT * FROM legs WHERE source <> 'register'), r AS (SELECT * FROM legs WHERE source = 'register')
    SELECT DISTINCT c.statement_id, c.ord AS check_ord, r.ord AS register_ord, CASE WHEN c.check_no <> '' AND c.check_no = r.check_no THEN 'check_number' ELSE 'amount' END AS reason FROM c JOIN r
    ON c.statement_id = r.statement_id AND ((c.check_no <> '' AND c.check_no = r.check_no) OR (r.amount < 0 AND abs(abs(r.amount) - abs(c.amount)) < 0.011))""")  # fmt: skip
def check_coverage(spark, sf):
    both = legs(spark, sf)
    return assembly.covered(both.filter("source = 'register'"), both.filter("source <> 'register'"))


@query(_RECURSIVE + walks.TRIMMED)
def budget_trim(spark, sf):
    checks = legs(spark, sf).filter("source = 'check_image_crop'")
    budgets = checks.groupBy("statement_id").agg((F.sum(F.abs("amount")) * 0.6).alias("budget"))
    return assembly.budget_trim(checks, budgets).select("statement_id", "ord", "amount")


@query(_RECURSIVE + walks.SUPPLEMENTS)
def supplemental_selection(spark, sf):
    both = legs(spark, sf)
    found = assembly.supplemental(both.filter("source = 'register'"), both.filter("source <> 'register'"))
    return found.withColumn("register_ord", F.coalesce("register_ord", F.lit(-1)))


_TEXT = "SELECT doc_id, CAST(generate_subscripts(string_split(text, chr(10)), 1) AS INTEGER) AS line_no, unnest(string_split(text, chr(10))) AS text FROM documents"


def document_lines(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("statement_id"), F.posexplode(F.split("text", "\n")).alias("p", "text"))
    return d.select("statement_id", (F.col("p") + 1).alias("line_no"), "text")


@query(f"WITH l AS ({_TEXT}), h AS (SELECT *, CASE WHEN text LIKE 'T%' THEN 'debit' WHEN text LIKE 'E%' THEN 'credit' END AS mark FROM l) SELECT CAST(doc_id AS VARCHAR) AS statement_id, line_no, last_value(mark IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS section FROM h")
def line_section_carry(spark, sf):
    mark = F.when(F.col("text").startswith("T"), "debit").when(F.col("text").startswith("E"), "credit")
    marked = document_lines(spark, sf).withColumn("mark", mark)
    return Ordered.of(marked, ["statement_id"], "line_no").carried(last={"section": F.col("mark")}).rows.select("statement_id", "line_no", "section")


@query("SELECT event_id, CAST(round(abs(value) * 100) AS BIGINT) / 100.0 AS first_amount, 2 AS n FROM events")
def amount_extract(spark, sf):
    line = F.concat(F.lit("01/05 deposit "), F.format_string("%.2f", F.abs(F.round("value", 2))), F.lit(" balance 1,000.00"))
    values = coerce.amounts(line)
    return table(spark, sf, "events").select("event_id", F.coalesce(F.element_at(values, 1), F.lit(0.0)).alias("first_amount"), F.size(values).alias("n"))


_PAGES = """WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '^ +| +$', '', 'g') AS t FROM documents),
    k AS (SELECT doc_id, t, len(regexp_extract_all(t, '\\b\\d{1,2}[/-]\\d{1,2}(?:[/-]\\d{2,4})?\\b.*\\d{1,3}(?:,\\d{3})*\\.\\d{2}')) AS rows, len(string_split_regex(t, '\\s+')) AS words,
    contains(lower(t), 'reconciliation')::INT + contains(lower(t), 'daily balance')::INT + contains(lower(t), 'account summary')::INT + contains(lower(t), 'beginning balance')::INT + contains(lower(t), 'ending balance')::INT + contains(lower(t), 'total deposits')::INT + contains(lower(t), 'total withdrawals')::INT + contains(lower(t), 'deposits and credits')::INT + contains(lower(t), 'withdrawals and debits')::INT + contains(lower(t), 'statement period')::INT + contains(lower(t), 'account number')::INT AS hits,
    len(regexp_extract_all(lower(t), 'beginning|ending.*balance')) AS balances FROM d)
    SELECT doc_id, CASE WHEN length(t) < 40 OR words < 8 THEN 'blank' WHEN (hits >= 2 AND rows <= 2) OR (balances >= 2 AND rows <= 1) THEN CASE WHEN rows < 1 THEN 'reconciliation' ELSE 'keep' END
    WHEN rows < 1 AND length(t) < 80 THEN 'low_information' ELSE 'keep' END AS kind FROM k"""


@query(_PAGES)
def page_filter(spark, sf):
    return table(spark, sf, "documents").select("doc_id", predicates.page_kind(F.col("text")).alias("kind"))


@query("SELECT conv_id, turn, CASE WHEN d >= 2 AND d >= c THEN 'deposit_slip' WHEN c >= 1 AND c > d THEN 'check' WHEN d >= 1 THEN 'deposit_slip' ELSE 'unknown' END AS kind, round(CASE WHEN d >= 2 AND d >= c THEN least(0.5 + 0.15 * d, 0.99) WHEN c >= 1 AND c > d THEN least(0.6 + 0.1 * c, 0.98) WHEN d >= 1 THEN 0.55 ELSE 0.25 END, 4) AS confidence FROM (SELECT *, (contains(lower(text), 'the'))::INT + (contains(lower(text), 'and'))::INT AS d, (contains(lower(text), 'que'))::INT + (contains(lower(text), 'der'))::INT AS c FROM conversations)")
def keyword_classify(spark, sf):
    kind, sure = predicates.keyword_class(F.col("text"), ["the", "and"], ["que", "der"])
    return table(spark, sf, "conversations").select("conv_id", "turn", kind.alias("kind"), F.round(sure, 4).alias("confidence"))


@query(_ALL + "SELECT check_no, amount, 'extra' AS side FROM (SELECT DISTINCT check_no, amount FROM legs WHERE source = 'register' EXCEPT SELECT check_no, amount FROM legs WHERE source <> 'register') UNION ALL SELECT check_no, amount, 'missing' FROM (SELECT DISTINCT check_no, amount FROM legs WHERE source <> 'register' EXCEPT SELECT check_no, amount FROM legs WHERE source = 'register')")
def golden_except(spark, sf):
    both = legs(spark, sf)
    return reports.golden_difference(both.filter("source = 'register'"), both.filter("source <> 'register'"), ["check_no", "amount"])


@query(_ALL + "SELECT coalesce(c.client_id, n.client_id) AS client_id, coalesce(n.business_name, c.business_name) AS business_name, coalesce(c.industry, n.industry) AS industry, CASE WHEN c.client_id IS NULL THEN 'created' WHEN n.client_id IS NOT NULL THEN 'updated' ELSE 'kept' END AS change FROM clients c FULL JOIN (SELECT c_custkey AS client_id, concat('New ', c_name) AS business_name, NULL AS industry FROM customer WHERE c_acctbal < 0) n ON c.client_id = n.client_id")
def upsert_merge(spark, sf):
    new = table(spark, sf, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("client_id"), F.concat(F.lit("New "), "c_name").alias("business_name"))
    return merging.upsert(clients(spark, sf), new, ["client_id"])


@query(_ALL + "SELECT request_id, CASE WHEN request_type = '1-URGENT' THEN 'Paid' ELSE status END AS status FROM requests")
def bulk_status_update(spark, sf):
    ids = requests(spark, sf).filter("request_type = '1-URGENT'").select("request_id")
    return merging.set_where(requests(spark, sf), ids, "request_id", "status", "Paid")[0].select("request_id", "status")


@query("SELECT o_orderkey, unnest(generate_series(o_orderkey % 5 + 1, o_orderkey % 5 + o_orderkey % 3 + 1)) AS page FROM orders")
def range_string_pages(spark, sf):
    low = F.col("o_orderkey") % 5 + 1
    text = F.concat(low.cast("string"), F.lit("-"), (low + F.col("o_orderkey") % 3).cast("string"))
    return table(spark, sf, "orders").select("o_orderkey", F.explode(coerce.pages_of(text)).alias("page")).withColumn("page", F.col("page").cast("long"))


@query("SELECT event_id, json_extract_string(props, '$.page') AS page FROM events")
def json_flatten(spark, sf):
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.page").alias("page"))


@query("SELECT event_id, CASE WHEN value IS NULL THEN 'Medium' WHEN value >= 90 THEN 'High' WHEN value >= 75 THEN 'Medium' ELSE 'Low' END AS label FROM events")
def confidence_labels(spark, sf):
    return table(spark, sf, "events").select("event_id", coerce.confidence_label(F.col("value") / 100).alias("label"))


@query("SELECT o_orderkey, CASE WHEN n <= 0 THEN 'today' WHEN n = 1 THEN 'yesterday' WHEN n < 7 THEN n || ' days ago' WHEN n < 30 THEN (n // 7) || CASE WHEN n // 7 = 1 THEN ' week ago' ELSE ' weeks ago' END WHEN n < 365 THEN (n // 30) || CASE WHEN n // 30 = 1 THEN ' month ago' ELSE ' months ago' END ELSE day END AS phrase FROM (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, DATE '2000-06-15' - CAST(o_orderdate AS DATE) AS n FROM orders)")
def relative_dates(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", coerce.relative_phrase(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(AS_OF[:10]).cast("date")).alias("phrase"))


@query(_ALL + "SELECT count(*) AS shared, count(*) FILTER (WHERE category <> '') - count(*) FILTER (WHERE description LIKE '%error%') AS changed, count(*) FILTER (WHERE payee <> '') AS filled FROM (" + _RULED + ")")
def payee_changes(spark, sf):
    return reports.payee_changes(transactions(spark, sf), _ruled(spark, sf), ["statement_id", "ord"])


@query("SELECT min(page) AS first_page, max(page) AS last_page, count(*) AS pages FROM (SELECT o_orderkey % 40 AS page, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1 HAVING count(*) >= 4)")
def imaging_page_vote(spark, sf):
    crops = table(spark, sf, "orders").filter("o_orderstatus = 'F'").select((F.col("o_orderkey") % 40).alias("page"))
    return reports.imaging_pages(crops, 4)
