"""Parsing, assembly, payees and updates as queries over the test tables. The SQL states the rule, on inputs made for it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import coerce, predicates, repair
from ..operators import assembly, crops, lines, matching, merging, payees, receivables, reports, rules
from ..sources import tables
from .queries import _ALL, QUERIES, SQL, clients, legs, query, requests, table, transactions

__all__ = ["QUERIES", "SQL"]


def _each(spark, sf, *texts):
    """The texts as lines, in order, for every order of a customer's statement."""
    o = table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("statement_id"), "o_orderkey", F.posexplode(F.array(*texts)).alias("p", "text"))
    return o.select("statement_id", (F.col("o_orderkey") * 10 + F.col("p")).cast("int").alias("line_no"), "text", "o_orderkey").filter("text is not null")


def _pick(*values):
    """The value at o_orderkey modulo their number."""
    out = F.lit(values[-1]) if isinstance(values[-1], str) or values[-1] is None else values[-1]
    for i, v in enumerate(values[:-1]):
        out = F.when(F.col("o_orderkey") % len(values) == i, v).otherwise(out)
    return out


def _money():
    return F.concat((F.col("o_orderkey") % 90 + 10).cast("string"), F.lit(".25"))


def _day():
    part = lambda n: F.lpad((F.col("o_orderkey") % n + 1).cast("string"), 2, "0")
    return F.concat_ws("/", part(12), part(28))


_SQL = "SELECT CAST(o_custkey AS VARCHAR) AS statement_id, o_orderkey, (o_orderkey % 90 + 10) || '.25' AS money, o_orderkey % 90 + 10.25 AS amount, lpad(CAST(o_orderkey % 12 + 1 AS VARCHAR), 2, '0') || '/' || lpad(CAST(o_orderkey % 28 + 1 AS VARCHAR), 2, '0') AS day, make_date(2026, CAST(o_orderkey % 12 + 1 AS INT), CAST(o_orderkey % 28 + 1 AS INT)) AS date FROM orders"


@query(f"""WITH o AS ({_SQL}) SELECT statement_id, CASE o_orderkey % 4 WHEN 0 THEN day || '/2026 Ach withdrawal ' || money WHEN 1 THEN day || '/2026 Debit Card Transaction ' || money
    WHEN 2 THEN day || '/2026 Paypal payment ' || money ELSE 'corner store' END AS text FROM o UNION ALL SELECT statement_id, 'plain words' FROM o WHERE o_orderkey % 4 = 3""")  # fmt: skip
def split_dates_fused(spark, sf):
    date = F.concat(_day(), F.lit("/2026"))
    first = _pick(F.concat(F.lit("Ach withdrawal "), _money()), date, "Paypal payment", "corner store")
    second = _pick(date, F.concat(F.lit("Debit Card Transaction "), _money()), F.concat_ws(" ", date, _money()), "plain words")
    return lines.fuse_split_dates(_each(spark, sf, first, second).drop("o_orderkey")).select("statement_id", "text")


@query(f"""WITH o AS ({_SQL}) SELECT statement_id, CASE o_orderkey % 3 WHEN 0 THEN day || ' 2488 ' || money WHEN 1 THEN day || ' 2488 ' || money || ' 01/22 2505 340.97' ELSE day || ' ' || money || ' words' END AS text FROM o
    UNION ALL SELECT statement_id, '24888' FROM o WHERE o_orderkey % 3 = 2""")  # fmt: skip
def orphan_numbers_spliced(spark, sf):
    bare = F.concat_ws(" ", _day(), _money())
    first = _pick(bare, F.concat(bare, F.lit(" 01/22 2505 340.97")), F.concat(bare, F.lit(" words")))
    return lines.splice_orphan_numbers(_each(spark, sf, first, _pick("2488", " 2488 ", "24888")).drop("o_orderkey")).select("statement_id", "text")


_HEADINGS = {
    "DEPOSITS": "credit", "Deposits and Other Credits (continued)": "credit", "Deposits/Credits | Amount": "credit", "ATM Withdrawals": "debit", "Checks Paid:": "check", "Fees/Charges": "debit",
    "Summary of Fees for paying": "end", "Daily Account Balances": "end", "Depositslip": None, "Feesible": None, "Account summary": "end", "my checks": None,
}
_HEADING_VALUES = ", ".join(f"({i}, {'NULL' if k is None else repr(k)})" for i, k in enumerate(_HEADINGS.values()))


@query(f"SELECT o_orderkey, kind FROM orders JOIN (VALUES {_HEADING_VALUES}) AS h(i, kind) ON o_orderkey % {len(_HEADINGS)} = i")
def section_headings(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", predicates.section_of(_pick(*_HEADINGS)).alias("kind"))


_NOISE = {
    "Page 1 of 3": True, "Total deposits 12.00": True, "Previous balance on 1": True, "DEPOSITS": True, "Date Description": True, "balance": True, "(205) 555-0100": True, "xy": True, "P.O. Box 12": True, "3 checks and other": True,
    "01/05 coffee shop 3.00": False, "subtle coffee 3.00": False, "Dollar store 3.00": False, "merchant with daily balance inside 3.00": False,
}
_NOISE_VALUES = ", ".join(f"({i}, {k})" for i, k in enumerate(_NOISE.values()))


@query(f"SELECT o_orderkey, skipped FROM orders JOIN (VALUES {_NOISE_VALUES}) AS h(i, skipped) ON o_orderkey % {len(_NOISE)} = i")
def lines_skipped(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", predicates.is_skipped(_pick(*_NOISE)).alias("skipped"))


_BALANCES = {"Ending balance": True, "Balance forward": True, "Total fees": True, "3 Deposits and other": True, "": True, "Shop at balance street": False, "The total shop": False, "daily balance shop": False}
_BALANCE_VALUES = ", ".join(f"({i}, {k})" for i, k in enumerate(_BALANCES.values()))


@query(f"SELECT o_orderkey FROM orders JOIN (VALUES {_BALANCE_VALUES}) AS h(i, bad) ON o_orderkey % {len(_BALANCES)} = i WHERE NOT bad")
def balance_rows_dropped(spark, sf):
    return table(spark, sf, "orders").filter(~predicates.is_balance_row(_pick(*_BALANCES))).select("o_orderkey")


_NAMES = {
    "Blue Sky Books": (True, True, False), "PAY TO THE ORDER OF Blue Sky": (True, False, False), "Wuulu": (False, False, False), "Slon8if4 Works": (False, False, False), "Target": (True, False, False),
    "ORDER OF 77": (False, False, False), "BRIGHT HARBOR TRADING LLC": (True, False, True), "Bright Harbor Trading llc": (True, False, False), "Ann O'Neil": (True, True, False), "First Bank Teller": (True, False, False), "12 Main": (False, False, False),
}
_NAME_VALUES = ", ".join(f"({i}, {c}, {p}, {h})" for i, (c, p, h) in enumerate(_NAMES.values()))


@query(f"SELECT o_orderkey, clean, person, header FROM orders JOIN (VALUES {_NAME_VALUES}) AS h(i, clean, person, header) ON o_orderkey % {len(_NAMES)} = i")
def payee_names(spark, sf):
    name = _pick(*_NAMES)
    return table(spark, sf, "orders").select("o_orderkey", predicates.is_clean_payee(name).alias("clean"), predicates.is_person_name(name).alias("person"), predicates.is_payer_header(name).alias("header"))


_PRINTED = {"Void after 90 days": True, "AUTHORIZED SIGNATURE": True, "Regions Bank": True, "cash >": True, "of": True, "": True, "Blue Sky Books": False, "Harbor Cafe": False}
_PRINTED_VALUES = ", ".join(f"({i}, {k})" for i, k in enumerate(_PRINTED.values()))


@query(f"SELECT o_orderkey, printed FROM orders JOIN (VALUES {_PRINTED_VALUES}) AS h(i, printed) ON o_orderkey % {len(_PRINTED)} = i")
def printed_lines(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", predicates.is_boilerplate(_pick(*_PRINTED)).alias("printed"))


_INDUSTRY = {"Joe's Grill": "Restaurant/Bar", "Barn Owl Works": "Restaurant/Bar", "Acme Roofing": "Construction/Trades", "Dry Dock": "Construction/Trades", "Paint Bar": "Restaurant/Bar", "Harbor Books": "Other"}
_INDUSTRY_VALUES = ", ".join(f"({i}, '{k}')" for i, k in enumerate(_INDUSTRY.values()))


@query(f"SELECT o_orderkey, industry FROM orders JOIN (VALUES {_INDUSTRY_VALUES}) AS h(i, industry) ON o_orderkey % {len(_INDUSTRY)} = i")
def industries(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", predicates.in_bucket(_pick(*_INDUSTRY)).alias("industry"))


_DESCRIPTIONS = {
    "POS PURCHASE CORNER MARKET #12 LOT": ("Corner Market", "CORNER MARKET"), "ZELLE PAYMENT JANE DOE": ("Jane Doe", "ZELLE PAYMENT JANE DOE"), "check #2419": ("", "2419"), "ACH DEBIT power co 01/12": ("power co", "power"),
    "CHECK CARD PURCHASE HP STORE": ("Check Card Purchase Hp Store", "HP STORE"), "LOWE'S 0123 AL": ("Lowe'S 0123 Al", "LOWE'S"), "Wire transfer out": ("out", "out"), "Deposit": ("", "Deposit"),
}
_DESCRIPTION_VALUES = ", ".join("({}, '{}', '{}')".format(i, *(x.replace("'", "''") for x in pair)) for i, pair in enumerate(_DESCRIPTIONS.values()))


@query(f"SELECT o_orderkey, payee, pattern FROM orders JOIN (VALUES {_DESCRIPTION_VALUES}) AS h(i, payee, pattern) ON o_orderkey % {len(_DESCRIPTIONS)} = i")
def payees_of_descriptions(spark, sf):
    text = _pick(*_DESCRIPTIONS)
    return table(spark, sf, "orders").select("o_orderkey", coerce.payee_of(text, F.lit("")).alias("payee"), repair.suggest_pattern(text).alias("pattern"))


@query(f"""WITH o AS ({_SQL}) SELECT statement_id, date, amount, 'Regular deposit ' || money || ' STORE FRONT' AS description, '' AS check_no FROM o WHERE false
    UNION ALL SELECT statement_id, date, amount, 'Regular deposit STORE FRONT', '' FROM o WHERE o_orderkey % 2 = 0
    UNION ALL SELECT statement_id, date, -amount, 'Check #2419', '2419' FROM o WHERE o_orderkey % 2 = 1""")  # fmt: skip
def scan_parse(spark, sf):
    """Each order as the lines of a scan: a deposit with a line that continues it, or a check in a register."""
    heading = _pick("DEPOSITS", "CHECK REGISTER")
    first = _pick(F.concat_ws(" ", F.concat(_day(), F.lit("/2026")), F.lit("Regular deposit"), _money()), F.concat_ws(" ", _day(), F.lit("2419"), _money()))
    found = lines.parse_scan(_each(spark, sf, heading, first, _pick("STORE FRONT", "Denotes missing check")).drop("o_orderkey"), F.lit(2026))
    return found.select("statement_id", "date", "amount", "description", "check_no")


@query(f"""WITH o AS ({_SQL}) SELECT DISTINCT statement_id, date, amount, description, section FROM (SELECT statement_id, date, CASE WHEN o_orderkey % 2 = 0 THEN amount ELSE -amount END AS amount,
    CASE WHEN o_orderkey % 2 = 0 THEN 'Harbor Cafe deposit' ELSE 'Ach withdrawal UTILITY' END AS description, CASE WHEN o_orderkey % 2 = 0 THEN 'credit' ELSE 'debit' END AS section FROM o)""")  # fmt: skip
def line_parse(spark, sf):
    """Each order as the lines of a text statement: a row of cells, or a dated line whose amount is on the next one."""
    first = _pick(F.concat_ws(" | ", F.concat(_day(), F.lit("/2026")), F.lit("Harbor Cafe deposit"), _money()), F.concat_ws(" ", _day(), F.lit("Ach withdrawal")))
    found = lines.parse_lines(_each(spark, sf, _pick("DEPOSITS", "ELECTRONIC DEBITS"), first, _pick(None, F.concat(F.lit("UTILITY "), _money()))).drop("o_orderkey"), F.lit(2026))
    return found.select("statement_id", "date", "amount", "description", "section")


@query(f"""WITH o AS ({_SQL}) SELECT statement_id, date, -amount AS amount, 'Harbor Cafe' AS description, CASE WHEN o_orderkey % 2 = 0 THEN '2419' ELSE '' END AS check_no FROM o""")
def table_parse(spark, sf):
    """Each order as a table of its own: a heading, a header (of two orders) and one row."""
    o = table(spark, sf, "orders")
    heading = F.array(F.lit("Other debits"))
    header = _pick(F.array(*map(F.lit, ("Date", "Check", "Amount", "Description"))), F.array(*map(F.lit, ("", "", "", ""))))
    row = _pick(F.array(_day(), F.lit("2419"), _money(), F.lit("Harbor Cafe")), F.array(F.concat(_day(), F.lit("/2026")), F.lit("Harbor Cafe"), _money(), F.lit("1,000.00")))
    cells = o.select(F.col("o_custkey").cast("string").alias("statement_id"), F.col("o_orderkey").cast("int").alias("table_no"), F.posexplode(F.array(heading, header, row)).alias("row_no", "cells"))
    return lines.parse_tables(cells, F.lit(2026)).select("statement_id", "date", "amount", "description", "check_no")


@query(f"""WITH o AS ({_SQL}) SELECT statement_id, 100.5 AS deposits, CAST(min(o_orderkey) AS DOUBLE) + 0.25 AS withdrawals, CAST(min(o_orderkey) % 50 AS INT) AS withdrawals_count FROM o GROUP BY 1""")
def summary_lines(spark, sf):
    text = F.concat(F.col("o_orderkey") % 50, F.lit(" Withdrawals and Other Debits $ "), F.format_number(F.col("o_orderkey") + 0.25, 2), F.lit(" -"))
    found = lines.statement_summary(_each(spark, sf, F.lit("Total deposits and credits: 100.50 +"), text).drop("o_orderkey"))
    return found.select("statement_id", "deposits", "withdrawals", "withdrawals_count")


@query(f"""WITH o AS ({_SQL}), f AS (SELECT statement_id, arg_min(o_orderkey, o_orderkey) AS k FROM o GROUP BY 1) SELECT statement_id, CAST(CASE k % 3 WHEN 0 THEN 2024 WHEN 1 THEN 2023 ELSE 2021 END AS INT) AS year FROM f""")
def statement_years(spark, sf):
    """Only the first order's lines name a year, so that it decides."""
    o = _each(spark, sf, _pick("printed 2022", "2022-01-01", "ref 1999 and 2021"), _pick("STATEMENT PERIOD of 2024", "On May 3, 2023", "x"))
    first = o.groupBy("statement_id").agg(F.min("o_orderkey").alias("o_orderkey"))
    return lines.statement_year(o.join(first, ["statement_id", "o_orderkey"], "left_semi").drop("o_orderkey"), 1999).select("statement_id", "year")


@query(_ALL + """, c AS (SELECT *, abs(amount) AS a FROM legs WHERE source = 'check_image_crop'), m AS (SELECT statement_id, coalesce(median(a) FILTER (WHERE a > 0 AND a <= 10000), 0) AS med FROM c GROUP BY 1),
    k AS (SELECT ord, row_number() OVER (PARTITION BY statement_id, ord // 20 ORDER BY CASE WHEN a <= 0 OR a > 10000 THEN 2 WHEN check_no = '' THEN 1 ELSE 0 END, CASE WHEN a <= 0 OR a > 10000 THEN 0 ELSE abs(a - med) END, ord) AS n FROM c JOIN m USING (statement_id))
    SELECT ord FROM k WHERE n = 1""")  # fmt: skip
def best_check_per_crop(spark, sf):
    checks = legs(spark, sf).filter("source = 'check_image_crop'").withColumn("crop_file", F.floor(F.col("ord") / 20).cast("string"))
    return assembly.best_per_crop(checks).select("ord")


@query(_ALL + """, c AS (SELECT * FROM legs WHERE source <> 'register'), r AS (SELECT * FROM legs WHERE source = 'register'),
    g AS (SELECT statement_id, count(*) FILTER (WHERE source = 'register') AS n_register, count(*) FILTER (WHERE source <> 'register') AS n FROM legs GROUP BY 1)
    SELECT statement_id, n_register, n AS offered, n_register < 3 AS sparse FROM g""")  # fmt: skip
def assembly_stats(spark, sf):
    both = legs(spark, sf)
    stats = assembly.assemble(both.filter("source = 'register'"), both.filter("source <> 'register'"))[1]
    return stats.select("statement_id", "n_register", "offered", "sparse")


@query(_ALL + "SELECT ord FROM ledger WHERE confidence <> 'High'")
def rows_below_high(spark, sf):
    return reports.by_confidence(transactions(spark, sf), "Medium").select("ord")


@query(_ALL + "SELECT CASE WHEN check_no <> '' THEN 'check' WHEN description = 'signup' THEN 'deposit' WHEN amount > 0 THEN 'ach_credit' WHEN amount < 0 THEN 'debit' ELSE 'other' END AS kind, count(*) AS n FROM ledger GROUP BY 1")
def row_kinds(spark, sf):
    named = F.when(F.col("description") == "signup", "Regular deposit").otherwise(F.col("description"))
    return reports.kinds(transactions(spark, sf).withColumn("description", named))


@query(_ALL + "SELECT count(*) AS transactions, count(*) FILTER (WHERE check_no <> '') AS check_rows, count(*) FILTER (WHERE check_no <> '' AND ord % 2 = 0) AS linked_check_rows, (SELECT count(*) FROM supplier) AS cropped_checks FROM ledger")
def run_counts(spark, sf):
    rows = transactions(spark, sf).withColumn("linked_check_id", F.when(F.col("ord") % 2 == 0, F.col("ord")))
    return reports.run_summary(rows, table(spark, sf, "supplier"))


@query("""SELECT CAST(c_custkey AS VARCHAR) AS statement_id, CASE WHEN c_custkey % 3 = 0 THEN 1.0 ELSE 2.0 END AS deposits, CASE WHEN c_custkey % 3 = 0 THEN -1.0 ELSE 3.0 END AS withdrawals,
    CASE WHEN c_custkey % 3 = 0 THEN -1 ELSE 4 END AS checks FROM customer WHERE c_custkey % 3 <> 2""")  # fmt: skip
def totals_reference(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("statement_id"), (F.col("c_custkey") % 3).alias("k"))
    none = F.lit(None).cast("int")
    reported = c.select("statement_id", F.when(F.col("k") == 0, 1.0).alias("deposits"), F.lit(None).cast("double").alias("withdrawals"), none.alias("checks"), none.alias("transactions"))
    summary = c.filter("k <> 2").select("statement_id", F.lit(2.0).alias("deposits"), F.lit(3.0).alias("withdrawals"), F.lit(9).alias("deposits_count"), F.lit(4).alias("withdrawals_count"))
    return reports.reference_totals(reported, summary).select("statement_id", "deposits", F.coalesce("withdrawals", F.lit(-1.0)).alias("withdrawals"), F.coalesce("checks", F.lit(-1)).alias("checks"))


@query("""WITH p AS (SELECT DISTINCT o_custkey, o_orderkey % 40 AS page FROM orders), r AS (SELECT *, page - row_number() OVER (PARTITION BY o_custkey ORDER BY page) AS run FROM p),
    s AS (SELECT o_custkey, min(page) + 1 AS a, max(page) + 1 AS b FROM r GROUP BY o_custkey, run) SELECT o_custkey, string_agg(CASE WHEN a = b THEN a || '' ELSE a || '-' || b END, ',' ORDER BY a) AS pages FROM s GROUP BY 1""")  # fmt: skip
def page_range_text(spark, sf):
    pages = table(spark, sf, "orders").groupBy("o_custkey").agg(F.collect_list((F.col("o_orderkey") % 40).cast("int")).alias("p"))
    return pages.select("o_custkey", coerce.range_of(F.col("p")).alias("pages"))


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE 'unknown da' END AS day FROM orders")
def service_dates(spark, sf):
    d = F.col("o_orderdate")
    text = _pick(F.date_format(d, "yyyy-MM-dd"), F.date_format(d, "MM/dd/yyyy"), F.date_format(d, "yyyy/MM/dd"), "unknown date")
    return table(spark, sf, "orders").select("o_orderkey", coerce.service_date(text).alias("day"))


@query("SELECT CASE WHEN c_custkey % 5 = 0 THEN 'unknown client' ELSE 'invalid request id' END AS reason, count(*) AS n FROM customer WHERE c_custkey % 5 IN (0, 1) GROUP BY 1")
def skipped_requests(spark, sf):
    c = table(spark, sf, "customer")
    mine = c.filter("c_custkey % 5 <> 0").select(F.col("c_custkey").alias("client_id"), F.col("c_name").alias("business_name"))
    have = mine.limit(0).select(F.lit(0).cast("long").alias("request_id"), "client_id", F.lit("").alias("status"))
    rows = c.select(F.when(F.col("c_custkey") % 5 != 1, F.col("c_custkey")).alias("request_id"), F.col("c_name").alias("business_name"), F.lit("Pending").alias("status"))
    return merging.upsert_requests(have, rows, mine)[1].groupBy("reason").agg(F.count("*").alias("n"))


@query("SELECT (SELECT count(*) FROM customer WHERE c_acctbal < 0) AS created, (SELECT count(*) FROM customer WHERE c_acctbal >= 0 AND c_custkey % 2 = 0) AS updated, (SELECT max(c_custkey) FROM customer WHERE c_acctbal >= 0) + (SELECT count(*) FROM customer WHERE c_acctbal < 0) AS top")
def client_upserts(spark, sf):
    c = table(spark, sf, "customer")
    have = c.filter("c_acctbal >= 0").select(F.col("c_custkey").alias("client_id"), F.col("c_name").alias("business_name"), F.lit("").alias("status"), F.lit(True).alias("is_deleted"))
    rows = c.filter("c_acctbal < 0 or c_custkey % 2 = 0").select(F.col("c_name").alias("business_name"), F.lit("Active").alias("status"))
    merged, n, ids = merging.upsert_clients(have, rows)
    return n.crossJoin(ids.agg(F.max("client_id").alias("top")))  # one row each


@query(_ALL + "SELECT count(*) FILTER (WHERE description <> 'signup') AS rows_changed, CAST(4 AS INT) AS rules_used FROM ledger")
def rules_fired(spark, sf):
    from .queries import RULES

    _, rows, used = rules.fired(transactions(spark, sf), RULES)
    return spark.createDataFrame([(rows, used)], "rows_changed long, rules_used int")


@query("SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'harbor' WHEN 1 THEN 'north' WHEN 2 THEN 'north' ELSE 'generic' END AS bank, CASE c_custkey % 4 WHEN 0 THEN 0.95 WHEN 1 THEN 0.85 WHEN 2 THEN 0.98 ELSE 0.0 END AS sure FROM customer")
def banks_detected(spark, sf):
    k = F.col("c_custkey") % 4
    rows = table(spark, sf, "customer").select("c_custkey", F.when(k == 0, "Acme  Harbor Co").otherwise("").alias("client"), F.when(k == 1, "north bank page").when(k == 2, "North Bank harbor bank routing").otherwise("").alias("text"))
    found = payees.detect_bank(rows, {"acme harbor": "harbor"}, [("north bank", "north"), ("harbor bank", "harbor"), ("routing", "north")])
    return found.select("c_custkey", "bank", F.round("bank_confidence", 2).alias("sure"))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS crop_id, CASE o_orderkey % 4 WHEN 0 THEN 'Blue Sky Books' WHEN 1 THEN 'Harbor Cafe' WHEN 2 THEN '' ELSE 'Corner Market' END AS payee, CASE o_orderkey % 4 WHEN 0 THEN 'same_line' WHEN 1 THEN 'next_line+check_rule' WHEN 2 THEN 'anchor_no_clean_candidate' ELSE 'first_clean' END AS reason FROM orders")
def crop_payees_ruled(spark, sf):
    """Crops of four kinds: a payee behind the header, below it (and ruled), an anchor without one, and no anchor."""
    texts = F.array(_pick("PAY TO THE ORDER OF Blue Sky Books", "Pay to the order of", "pay to", "Corner Market"), _pick("one hundred dollars", "HARBR CAFE", "12.00", "memo: rent"))
    crop = table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("crop_id"), F.posexplode(texts).alias("idx", "text"), F.lit(0.9).alias("confidence"), F.lit(0.3).alias("y"))
    known = spark.createDataFrame([("harbr", "Harbor Cafe", "", "", 1)], "pattern string, payee string, client_override string, bank string, ord int")
    return payees.extract_with_rules(crop, known).select("crop_id", "payee", "reason")


@query(f"""WITH o AS ({_SQL}) SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'deposit_slip' WHEN 1 THEN 'check' ELSE 'unknown' END AS kind, CASE o_orderkey % 3 WHEN 0 THEN 0.95 WHEN 1 THEN 0.98 ELSE 0.0 END AS sure FROM o""")
def crop_classes(spark, sf):
    kind, sure = predicates.keyword_class(_pick("Deposit slip, currency", "PAY TO THE ORDER OF x dollars memo", ""))
    return table(spark, sf, "orders").select("o_orderkey", kind.alias("kind"), F.round(sure, 4).alias("sure"))


@query("SELECT page, count(*) FILTER (WHERE o_orderstatus = 'F') AS \"F\", count(*) FILTER (WHERE o_orderstatus = 'O') AS \"O\", count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS clean, round_even(100.0 * count(*) FILTER (WHERE o_orderpriority = '1-URGENT') / count(*), 1) AS clean_pct FROM (SELECT *, o_orderkey % 9 AS page FROM orders) GROUP BY 1")
def page_classes(spark, sf):
    o = table(spark, sf, "orders").select((F.col("o_orderkey") % 9).alias("page"), F.col("o_orderstatus").alias("class"), (F.col("o_orderpriority") == "1-URGENT").alias("clean"))
    return crops.classes_by_page(o, ["F", "O"])


@query(_ALL + "SELECT ord, CASE WHEN ord % 2 = 0 THEN 'Payee' ELSE '' END AS payee, CASE WHEN ord % 2 = 0 THEN 'Low' ELSE 'Medium' END AS confidence, CASE WHEN ord % 2 = 0 THEN 'note; Linked via amount $' || printf('%.2f', abs(amount)) || ' (no clean payee from image)' ELSE 'note; Missing date' END AS review_reason FROM legs WHERE source = 'register'")
def match_consequences(spark, sf):
    """Every second register row is matched by amount to a crop without a payee; the others are not."""
    rows = legs(spark, sf).filter("source = 'register'").withColumns({"confidence": F.lit("Medium"), "needs_review": F.lit("No"), "review_reason": F.lit("note; Missing date"), "payee": F.when(F.col("ord") % 2 == 0, "Payee").otherwise("")})
    found = rows.filter("ord % 2 = 0").select("statement_id", F.col("ord").alias("crop_ord"), "ord", F.lit("amount").alias("tier"), F.lit(None).cast("double").alias("alike"))
    return matching.apply_matches(rows, rows.withColumn("payee", F.lit("")), found).select("ord", "payee", "confidence", "review_reason")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'Low' ELSE 'Medium' END AS confidence, CASE o_orderkey % 4 WHEN 0 THEN 'old; Date format uncertain' WHEN 1 THEN 'old; Check# may need review: x1' WHEN 2 THEN 'old; Missing amount' ELSE 'old; Invalid Confidence corrected' END AS review_reason FROM orders")
def rows_reviewed(spark, sf):
    rows = table(spark, sf, "orders").select(
        "o_orderkey", _pick("05 May", "2026-05-05", "2026-05-05", "2026-05-05").alias("date"), _pick("1.00", "1.00", "", "1.00").alias("amount"), _pick("", "x1", "", "7").alias("check_no"),
        _pick("2026-05", "2026-05", "2026-05", "2026-05").alias("year_month"), _pick("Low", "High", "Low", "Sure").alias("confidence"), F.lit("No").alias("needs_review"), F.lit("old").alias("review_reason"),
    )
    return lines.review(rows).select("o_orderkey", "confidence", "review_reason")


@query(_ALL + "SELECT count(*) AS n FROM requests JOIN clients USING (client_id) WHERE status IN ('Pending', 'Received') AND NOT bank_ok AND business_name = (SELECT min(business_name) FROM clients)")
def open_requests_of_client(spark, sf):
    named = requests(spark, sf).join(clients(spark, sf), "client_id")
    first = clients(spark, sf).agg(F.min("business_name")).first()[0]
    return receivables.open_for(named, first, "bank_statement_received").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'note [acct] end' ELSE 'short 12345678' END AS text FROM orders")
def digits_redacted(spark, sf):
    text = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("note "), F.lpad(F.col("o_orderkey").cast("string"), 12, "9"), F.lit(" end"))).otherwise(F.lit("short 12345678"))
    return table(spark, sf, "orders").select("o_orderkey", coerce.redact_digits(text).alias("text"))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS request_id, CASE WHEN o_orderkey % 2 = 0 THEN round(o_totalprice, 2) ELSE 0.0 END AS amount_due, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderdate AS DATE) END AS due_date, o_orderkey % 2 = 0 AS bank_statement_received FROM orders")
def requests_coerced(spark, sf):
    """Orders as texts of a CSV: ids with a fraction, amounts with signs, dates of two forms, flags as marks."""
    even = F.col("o_orderkey") % 2 == 0
    raw = table(spark, sf, "orders").select(
        F.concat(F.col("o_orderkey").cast("string"), F.lit(".0")).alias("request_id"), F.when(even, F.concat(F.lit("$"), F.format_number(F.round("o_totalprice", 2), 2))).otherwise("abc").alias("amount_due"),
        F.when(even, F.date_format("o_orderdate", "M/d/yyyy")).otherwise("soon").alias("due_date"), F.lit("").alias("received_date"), F.when(even, "✓").otherwise("").alias("bank_statement_received"), F.lit("y").alias("sales_report_received"),
    )
    return tables.coerce_requests(raw).select("request_id", "amount_due", "due_date", "bank_statement_received")
