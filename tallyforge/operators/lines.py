"""Statement lines and table rows to transactions: prefixes carry sections, dates and groups of lines; no statement is one task."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import replace
from itertools import groupby
from operator import itemgetter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import coerce, predicates, repair
from ..functions.coerce import AMOUNT, DATE_TOKEN, let
from .assembly import dedupe_transactions
from .pieces import PIECE, Ordered
from .sequence import plain_unions, tasks_for, walked

# Dates with a year, alone on a line or at its start; amounts; words of transactions.
DATED = r"\d{1,2}[/-]\d{1,2}[/-]\d{2,4}"
DATE_ONLY, LEADING_DATE, FULL_DATE = rf"^\s*({DATED})\s*$", rf"^\s*({DATED})(?!\d)", rf"^\s*({DATED})(?!\d)(?:\s+(.*))?$"
PLAIN_AMOUNT = r"\d{1,3}(?:,\d{3})*\.\d{2}"
VERB = (
    r"(?i)\b(ach|eft/?ach|eftiach|debit|credit|withdrawal|deposit|transfer|wire|check|payment|pos|merch|paypal|venmo|zelle|card|atm|service|charge|fee|epay)\b"
)
# Rows of check registers; a date and an amount without a number between them, and the number alone.
TRIPLET = rf"(\d{{1,2}}[/-]\d{{1,2}})\s+\*?\s*(\d{{3,6}})\s*\*?\s+({PLAIN_AMOUNT})"
REGISTER_ROW = r"^\s*\*?\s*(\d{3,6})\s*\*?\s+(\d{1,2}[/-]\d{1,2}(?:[/-]\d{2,4})?)\s+(.+?)\s*$"
NO_NUMBER, FOUR_DIGITS = rf"^(\d{{1,2}}[/-]\d{{1,2}})\s+({PLAIN_AMOUNT})(?:\s+|$)", r"^\s*(\d{4})\s*$"
# Summary lines of a statement.
SUMMARY = {
    "deposits": (r"(?i)^\s*(?:deposits?\s+and\s+other\s+(?:credits?|debits?)|total\s+deposits?(?:\s+and\s+credits?)?|total\s+credits?)\s*[_:\-]*\s*\$?\s*(\d{1,3}(?:,\d{3})*\.\d{2})\s*\+?\s*$", "double"),
    "withdrawals": (r"(?i)^\s*(?:\d+\s+)?(?:withdrawals?\s+and\s+other\s+(?:debits?|credits?)|total\s+withdrawals?(?:\s+and\s+debits?)?|total\s+debits?)\s*[_:\-]*\s*\$?\s*(\d{1,3}(?:,\d{3})*\.\d{2})\s*[\-+]?\s*$", "double"),
    "deposits_count": (r"(?i)^\s*(\d+)\s+deposits?\s+and\s+other\s+(?:credits?|debits?)\s+\$?\s*\d{1,3}(?:,\d{3})*\.\d{2}", "int"),
    "withdrawals_count": (r"(?i)^\s*(\d+)\s+withdrawals?\s+and\s+other\s+(?:debits?|credits?)\s+\$?\s*\d{1,3}(?:,\d{3})*\.\d{2}", "int"),
}
# Where a statement's year is looked for, and in how much of its text.
YEARS = (
    r"(?i)statement\s+period[^\d]{0,40}(\d{4})",
    r"(?i)(?:january|february|march|april|may|june|july|august|september|october|november|december)\s+\d{1,2},?\s+(\d{4})",
    r"\b(20\d{2})\b",
)
YEAR_TEXT = 8000
# Lines that continue a row, the longest description that they make, rows of text below which a scan is read.
CONTINUATIONS, LONGEST, FEW_ROWS = 2, 120, 3


def in_order():
    return Window.partitionBy("statement_id").orderBy("line_no")


def _lines(lines: DataFrame) -> Ordered:
    return Ordered.of(lines, ["statement_id"], "line_no")


def _shown(lines: DataFrame) -> DataFrame:
    """Trimmed lines, without blank ones."""
    return lines.withColumn("text", F.trim("text")).filter("text <> ''")


def _dealt(lines: DataFrame) -> Ordered:
    """Lines dealt to tasks by their number, before they are read: few tasks may have read the files."""
    return _lines(lines).spread(tasks_for(lines))


def _sections(lines: Ordered) -> Ordered:
    out = lines.then(lambda rows: rows.withColumn("heading", predicates.section_of(F.col("text")))).carried(last={"section": F.col("heading")})
    suppressed = F.coalesce(F.col("section") == "end", F.lit(False))
    return out.then(lambda rows: rows.withColumn("suppressed", suppressed).withColumn("section", F.when(~F.col("suppressed"), F.col("section"))))


def carry_sections(lines: DataFrame) -> DataFrame:
    """heading: a line's own section; section: that of the last heading; suppressed: after a heading that ends them all."""
    return _sections(_lines(lines)).rows.drop(PIECE)


def _until_end(lines: Ordered) -> Ordered:
    return lines.carried(count={"__ended": F.col("heading") == "end"}).then(lambda rows: rows.filter("__ended = 0").drop("__ended"))


def until_terminator(lines: DataFrame) -> DataFrame:
    """Lines before a statement's first ending heading."""
    headed = lines if "heading" in lines.columns else lines.withColumn("heading", predicates.section_of(F.col("text")))
    return _until_end(_lines(headed)).rows.select(lines.columns)


def _absorb_next(lines: Ordered, fused) -> Ordered:
    """Lines, none of them blank, of which some take the next: fused(text, next) is the new text, or null.

    Lines are taken from the top, so one that was taken takes none itself: in a run of lines that all could, every
    second one does. A line's place in its run is its number less that of the last line before it that could not.
    """
    columns = lines.rows.columns
    marked = lines.followed({"__after": F.col("text")}).then(lambda rows: rows.withColumn("__new", fused(F.col("text"), F.col("__after")))).carried(count={"__at": F.lit(True)})
    marked = marked.carried(last_before={"__stop": F.when(F.col("__new").isNull(), F.col("__at"))})
    odd = (F.col("__at") - F.coalesce("__stop", F.lit(0))) % 2 == 1
    return marked.then(lambda rows: rows.filter(odd).withColumn("text", F.coalesce("__new", "text")).select(columns))


def fuse_split_dates(lines: DataFrame) -> DataFrame:
    """Lines whose date stands on a line of its own: the two become one, the date first.

    In this order: words of a transaction with an amount, then a date alone; a date alone, then words with an amount;
    up to four words without an amount, then a date and an amount without words of a transaction.
    """
    return _fused(_lines(_shown(lines))).rows.drop(PIECE)


def _fused(lines: Ordered) -> Ordered:

    def fused(text: Column, after: Column) -> Column:
        date = lambda x, p: F.regexp_extract(x, p, 1)
        row = lambda x: ~x.rlike(LEADING_DATE) & x.rlike(PLAIN_AMOUNT) & x.rlike(VERB)
        rest = F.trim(F.regexp_replace(after, LEADING_DATE, ""))
        short = after.rlike(LEADING_DATE) & ~text.rlike(LEADING_DATE) & ~text.rlike(PLAIN_AMOUNT) & text.rlike(VERB) & (F.size(F.split(text, r"\s+")) <= 4)
        return (
            F.when(after.rlike(DATE_ONLY) & row(text), F.concat_ws(" ", date(after, DATE_ONLY), text))
            .when(text.rlike(DATE_ONLY) & row(after), F.concat_ws(" ", date(text, DATE_ONLY), after))
            .when(short & after.rlike(PLAIN_AMOUNT) & ~rest.rlike(VERB), F.trim(F.concat_ws(" ", date(after, LEADING_DATE), text, rest)))
        )

    return _absorb_next(lines, fused)


def splice_orphan_numbers(lines: DataFrame) -> DataFrame:
    """A line that begins with a date and an amount takes a number of four digits from the next line between the two."""
    return _spliced(_lines(_shown(lines))).rows.drop(PIECE)


def _spliced(lines: Ordered) -> Ordered:

    def spliced(text: Column, after: Column) -> Column:
        part = lambda i: F.regexp_extract(text, NO_NUMBER, i)
        rest = F.nullif(F.trim(F.regexp_replace(text, NO_NUMBER, "")), F.lit(""))
        whole = F.concat_ws(" ", part(1), F.regexp_extract(after, FOUR_DIGITS, 1), part(2), rest)
        return F.when(text.rlike(NO_NUMBER) & after.rlike(FOUR_DIGITS), whole)

    return _absorb_next(lines, spliced)


def check_triplets(lines: DataFrame) -> DataFrame:
    """One to three (date, check number, amount) of a line, a row each."""
    return _triplets(lines)


def _triplets(lines: DataFrame, *more: str) -> DataFrame:
    get = lambda i: F.regexp_extract_all("text", F.lit(TRIPLET), F.lit(i))
    zipped = F.posexplode(F.arrays_zip(get(1).alias("date"), get(2).alias("check_no"), get(3).alias("amount")))
    out = lines.select("statement_id", "line_no", *more, zipped.alias("place", "t"))
    return out.select("statement_id", "line_no", *more, "place", F.col("t.date").alias("date_text"), F.col("t.check_no").alias("check_no"), F.translate("t.amount", ",", "").cast("double").alias("amount"))


def _checks(text: Column, year: Column) -> Column:
    """The triplets of a line as rows of checks, in order."""
    get = lambda i: F.regexp_extract_all(text, F.lit(TRIPLET), F.lit(i))
    row = lambda t, i: _scan_row(i, coerce.normal_date(t["date"], year), F.concat(F.lit("Check #"), t["check_no"]), F.translate(t["amount"], ",", "").cast("double"), t["check_no"], F.lit("check"))
    return F.transform(F.arrays_zip(get(1).alias("date"), get(2).alias("check_no"), get(3).alias("amount")), row)


def _scan_row(place: Column, date: Column, description: Column, amount: Column, check_no: Column, section: Column) -> Column:
    return F.struct(place.cast("int").alias("place"), date.alias("date"), description.alias("description"), amount.alias("amount"), check_no.alias("check_no"), section.alias("section"))


def statement_year(lines: DataFrame, default: int) -> DataFrame:
    """statement_id and the year that its first YEAR_TEXT characters name: of its period, of a date in words, or any of this century."""
    before = F.coalesce(F.sum(F.length("text") + 1).over(in_order().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    head = lines.withColumn("__before", before).filter(F.col("__before") < YEAR_TEXT)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda s: s["text"]), "\n")
    whole = head.groupBy("statement_id").agg(F.substring(text, 1, YEAR_TEXT).alias("text"))
    found = [F.regexp_extract("text", p, 1).try_cast("int") for p in YEARS]
    year = F.coalesce(*[F.when(y.between(2000, 2099), y) for y in found])
    named = whole.select("statement_id", year.alias("year"))
    return lines.select("statement_id").distinct().join(named, "statement_id", "left").na.fill({"year": default})


def statement_summary(lines: DataFrame) -> DataFrame:
    """deposits, withdrawals and their counts that a statement's summary lines give; the first of each."""
    found = lines.select("statement_id", "line_no", *[F.translate(F.regexp_extract("text", p, 1), ",", "").try_cast(t).alias(k) for k, (p, t) in SUMMARY.items()])
    return found.groupBy("statement_id").agg(*[F.min_by(k, F.when(F.col(k).isNotNull(), F.col("line_no"))).alias(k) for k in SUMMARY])


def _number(x: Column, column: bool = False) -> Column:
    """The check number that a text names; with column, also a number that is all of it."""
    named = F.nullif(F.regexp_extract(x, predicates.CHECK_NUMBER, 1), F.lit(""))
    lone = F.nullif(F.regexp_extract(F.trim(x), predicates.LONE_NUMBER, 1), F.lit(""))
    return F.coalesce(named, lone) if column else named


def _no_amounts(x: Column) -> Column:
    return coerce.strip_amounts(F.trim(F.regexp_replace(x, AMOUNT, "")))


def _in_joined(joined: Column, year: Column) -> tuple[Column, Column]:
    """The date at a text's start, and what follows it."""
    lead = F.regexp_extract(joined, rf"^{DATE_TOKEN}", 0)
    return F.when(lead != "", coerce.normal_date(lead, year)), F.trim(F.substr(joined, F.length(lead) + 1))


def cells_row(cells: Column, section: Column, year: Column, columns: Column | None = None) -> Column:
    """date, description, amount, check_no of a row of cells as a struct, or null if it is no transaction.

    columns: the places (from 1) of date, text, amount and number that a header gave, as a struct d, t, a, c; null where
    none did. Without a place for dates, a row of three cells or more is read by position: a date first, its amount
    last, or before a balance; in check sections a number, a date and an amount, or a date, a number, an amount and a text.
    """
    n, joined = F.size(cells), F.array_join(cells, " ")
    at = lambda i: F.try_element_at(cells, F.lit(i) if isinstance(i, int) else i)
    given = lambda k: at(columns[k]) if columns is not None else F.lit(None).cast("string")
    first = lambda x: coerce.pick_amount(coerce.amounts(x), "first")
    none = F.lit(None).cast("string")
    in_checks, placed = F.coalesce(section == "check", F.lit(False)), columns["d"].isNotNull() if columns is not None else F.lit(False)
    row = lambda d, t, a, c: F.struct(d.alias("date"), t.alias("description"), a.alias("amount"), c.alias("check_no"))
    # What the cells hold, each once: dates of the first two, amounts of the third and of the last two.
    seen = F.struct(
        coerce.normal_date(at(1), year).alias("d1"), coerce.normal_date(at(2), year).alias("d2"), first(at(3)).alias("a3"), first(at(-1)).alias("last"), first(at(-2)).alias("before"),
    )

    def read(x: Column) -> Column:
        positional = ~placed & (n >= 3)
        numbered = positional & in_checks & x["d1"].isNull() & at(1).rlike(predicates.LONE_NUMBER) & x["d2"].isNotNull() & x["a3"].isNotNull()
        listed = positional & x["d1"].isNotNull() & in_checks & (n >= 4)
        dated = positional & x["d1"].isNotNull() & ~listed
        lone = F.regexp_extract(at(1), predicates.LONE_NUMBER, 1)
        middle = lambda cut: F.array_join(F.slice(cells, F.lit(2), F.greatest(n - cut, F.lit(0))), " ")
        base = row(F.when(placed, coerce.normal_date(given("d"), year)), given("t"), first(given("a")), _number(given("c"), True))
        return (
            F.when(numbered, row(x["d2"], F.concat(F.lit("Check #"), lone), x["a3"], lone))
            .when(listed & x["a3"].isNotNull(), row(x["d1"], at(4), x["a3"], _number(at(2), True)))
            .when(dated & (n >= 4) & x["last"].isNotNull() & x["before"].isNotNull(), row(x["d1"], middle(3), x["before"], none))
            .when(dated & x["last"].isNotNull(), row(x["d1"], middle(2), x["last"], none))
            .otherwise(base)
        )

    def whole(x: Column) -> Column:
        own, rest = _in_joined(joined, year)
        any_lone = F.regexp_extract(F.try_element_at(F.filter(cells, lambda c: c.rlike(predicates.LONE_NUMBER)), F.lit(1)), predicates.LONE_NUMBER, 1)
        number = F.coalesce(x["check_no"], F.when(in_checks & x["date"].isNull(), any_lone))
        text = F.coalesce(F.nullif(x["description"], F.lit("")), F.when(x["date"].isNull() & own.isNotNull(), F.nullif(rest, F.lit(""))), joined)
        return F.struct(F.coalesce(x["date"], own).alias("date"), text.alias("description"), x["amount"].alias("amount"), number.alias("check_no"), coerce.pick_amount(coerce.amounts(joined)).alias("any"))

    def priced(x: Column) -> Column:
        bare = _no_amounts(F.regexp_replace(joined, F.date_format(x["date"], "yyyy-MM-dd"), ""))
        text = F.when(x["amount"].isNull() & x["any"].isNotNull() & x["date"].isNotNull(), bare).otherwise(x["description"])
        return row(x["date"], text, F.coalesce(x["amount"], x["any"]), x["check_no"])

    def likely(x: Column) -> Column:
        t = x["description"]
        named = t.rlike(r"^\d{1,2}[/-]\d{1,2}") | t.rlike(predicates.TRANSACTION_HINT) | t.rlike(predicates.CHECK_NUMBER) | F.trim(F.element_at(F.split(t, r"\|"), 1)).rlike(predicates.LONE_NUMBER)
        return F.when(x["amount"].isNotNull() & (x["date"].isNotNull() | F.coalesce(section.isin("credit", "debit", "check"), F.lit(False)) | named), x)

    made = let(let(let(let(seen, read), whole), priced), likely)
    heading = predicates.section_of(joined).isNotNull() | predicates.is_column_header(joined)
    return F.when((n > 0) & ~heading, made)


def finish(rows: DataFrame, source: str, year: Column) -> DataFrame:
    """Rows (statement_id, ord, date, description, amount, check_no, section) with all that a ledger row needs, reviewed.

    Trailing amounts go, sections give signs, a number in the text is the check's, prefixes leave the payee. source: text
    (High) or scan (Medium, always to review). A missing date or amount is Medium and to review.
    """
    description = coerce.strip_amounts(F.trim(F.coalesce("description", F.lit(""))))
    out = rows.withColumn("description", description).withColumn("amount", coerce.section_sign(F.col("amount"), F.col("section")))
    out = out.withColumn("check_no", F.coalesce(F.nullif(coerce.blank(F.col("check_no")), F.lit("")), _number(F.col("description")), F.lit("")))
    no_date, no_amount, scan = F.col("date").isNull(), F.col("amount").isNull(), source == "scan"
    note = F.when(no_date | no_amount, "OCR fallback path — verify amount + payee").otherwise("OCR fallback — verify payee") if scan else F.lit(None).cast("string")
    reasons = F.array_compact(F.array(F.when(no_date, "Missing date"), F.when(no_amount, "Missing amount"), note))
    month = F.coalesce(F.date_format("date", "yyyy-MM"), F.concat(year.cast("string"), F.lit("-01")))
    out = out.withColumns({
        "payee": coerce.payee_of(F.col("description"), F.col("check_no")), "category": F.lit("Uncategorized"), "sub_category": F.lit(""), "year_month": month,
        "confidence": F.when(no_date | no_amount | F.lit(scan), "Medium").otherwise("High"), "needs_review": F.when(F.size(reasons) > 0, "Yes").otherwise("No"),
        "review_reason": F.array_join(reasons, "; "),
    })
    return review(out)


def _stripped(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def _gathered(events: Ordered) -> Ordered:
    """Rows of parse_lines() from its events: event, section, date, body, amount, check_no, named, kept of a line.

    A group of lines ends before a heading, a row of cells or a register, and a dated line, and after a line with an
    amount. Two prefixes number the groups and a third carries the date, so that each group is summed up by itself: its
    waiting lines and its amount line are one row, or its waiting lines are one without an amount. Events `skip` are left out.
    """
    line, priced = F.col("event") == "line", F.col("amount").isNotNull()
    sectioned, dated = coerce.blank(F.col("section")) != "", F.col("__day").isNotNull()
    told = events.carried(last={"__day": F.col("date")}, count={"__a": ~F.col("event").isin("line", "skip") | F.col("date").isNotNull()}, count_before={"__b": line & priced})
    rows = told.rows.filter(F.col("event").isin("cells", "register", "line")).withColumn("__group", F.col("__a") + F.col("__b"))
    waits = line & ~priced & (F.coalesce(F.col("kept"), F.lit(False)) | sectioned)
    day = F.when(F.col("event") == "cells", F.col("date")).otherwise(F.col("__day"))
    end = F.struct("line_no", PIECE, day.alias("date"), "section", "amount", F.col("body").alias("body"), "check_no", F.coalesce("named", F.lit(False)).alias("named"))
    # A row of cells or of a register has the number of the lines that follow it, and is a group of its own.
    groups = rows.groupBy("statement_id", "__group", line.alias("__line")).agg(
        F.array_sort(F.collect_list(F.when(waits, F.struct("line_no", "body")))).alias("waiting"), F.coalesce(F.bool_or(waits & F.col("named")), F.lit(False)).alias("hinted"), F.max_by(end, "line_no").alias("end"),
    )
    # The last line of a group is its amount line if it has one.
    amount, alone = F.col("end.amount").isNotNull(), ~F.col("__line")
    bodies = F.transform("waiting", lambda w: w["body"])
    text = _stripped(F.array_join(F.concat(bodies, F.when(amount, F.array("end.body")).otherwise(F.array().cast("array<string>"))), " "))
    sure = F.col("hinted") | (amount & F.col("end.named")) | F.col("end.date").isNotNull() | (coerce.blank(F.col("end.section")) != "")
    said = F.when(alone, F.col("end.body")).otherwise(text)
    joined = groups.filter(alone | sure).withColumn("description", said).filter(alone | amount | (F.col("description") != "")).select(
        "statement_id", F.col(f"end.{PIECE}").alias(PIECE), _place(F.col("end.line_no"), F.when(alone | amount, 0).otherwise(1)), F.col("end.date").alias("date"),
        "description", F.col("end.amount").alias("amount"), F.when(alone, F.col("end.check_no")).alias("check_no"), F.col("end.section").alias("section"),
    )
    return replace(told, rows=joined, order="__place")


def _place(line_no: Column, within: Column | int) -> Column:
    """The order of rows: by line, and within a line."""
    return (line_no.cast("long") * 2**20 + (F.lit(within) if isinstance(within, int) else within)).alias("__place")


def _in_place(rows: Ordered) -> DataFrame:
    """rows with `ord`, their number within the statement."""
    return rows.carried(count={"ord": F.lit(True)}).rows.withColumn("ord", F.col("ord").cast("int")).drop("__place", PIECE)


def classified(lines: DataFrame, year: Column, *more: str) -> DataFrame:
    """Lines with `heading` and `section` as events: heading, cells, register (of checks) or line, with what they hold.

    date, body, amount and check_no are those of the line itself; named: it has words of a transaction; kept: it may
    wait for an amount. Lines that say nothing are left out. more: columns to keep.
    """
    return _classified(lines, year, *more).filter("event <> 'skip'")


def _classified(lines: DataFrame, year: Column, *more: str) -> DataFrame:
    """As classified(), with the lines that say nothing as events `skip` without a date or an amount.

    A filter on what a line is would be pushed below the columns that say it, which were then computed twice.
    """
    cells = F.transform(F.split("text", r" \| "), lambda c: F.trim(c))
    live = lines.withColumn("__cells", F.when(F.col("heading").isNull() & F.col("text").contains(" | "), cells_row(cells, F.col("section"), year)))
    part = lambda i: F.regexp_extract("text", REGISTER_ROW, i)
    in_checks = F.col("heading").isNull() & (F.col("section") == "check") & F.col("text").rlike(REGISTER_ROW)
    paid = coerce.pick_amount(coerce.amounts(part(3)))
    extra = F.regexp_replace(F.regexp_replace(F.regexp_replace(part(3), AMOUNT, ""), r"^[ .\-]+", ""), r"[ .\-]+$", "")
    extra = F.when((extra == "") | extra.rlike(r"^\d+$"), None).otherwise(extra)
    listed = F.struct(coerce.normal_date(part(2), year).alias("date"), F.concat_ws(" ", F.concat(F.lit("Check #"), part(1)), extra).alias("description"), paid.alias("amount"), part(1).alias("check_no"))
    live = live.withColumn("__listed", F.when(in_checks & paid.isNotNull() & ~predicates.is_column_header(F.col("text")), listed))
    event = F.when(F.col("heading").isNotNull(), "heading").when(F.col("__cells").isNotNull(), "cells").when(F.col("__listed").isNotNull(), "register").otherwise("line")
    live = live.withColumn("event", event).withColumn("event", F.when((F.col("event") == "line") & predicates.is_skipped(F.col("text"), F.col("heading")), "skip").otherwise(F.col("event")))
    own, rest = _in_joined(F.col("text"), year)
    live = live.withColumn("__own", F.when(F.col("event") == "line", own)).withColumn("__body", F.when(F.col("__own").isNotNull(), rest).otherwise(F.col("text")))
    made = F.coalesce("__cells", "__listed")
    line, body = F.col("event") == "line", F.col("__body")
    named = body.rlike(predicates.TRANSACTION_HINT) | body.rlike(predicates.CHECK_NUMBER) | F.trim(F.element_at(F.split(body, r"\|"), 1)).rlike(predicates.LONE_NUMBER)
    kept = body.rlike(predicates.TRANSACTION_HINT) | F.substring(body, 1, 20).rlike(DATE_TOKEN) | body.rlike(predicates.CHECK_NUMBER)
    return live.select(
        "statement_id", *more, F.col("line_no").cast("int").alias("line_no"), "event", "section", F.when(line, F.col("__own")).otherwise(made["date"]).alias("date"),
        F.when(line, body).otherwise(made["description"]).alias("body"), F.when(line, coerce.pick_amount(coerce.amounts(body))).otherwise(made["amount"]).alias("amount"),
        made["check_no"].alias("check_no"), named.alias("named"), kept.alias("kept"),
    )


def parse_lines(lines: DataFrame, year: Column) -> DataFrame:
    """Transactions of a statement's lines (statement_id, line_no, text), as finish() gives them.

    Headings set the section, or end it; a date at a line's start holds until the next. Lines of cells (` | `) and of a
    check register are rows by themselves. Lines without an amount wait for the next amount line and precede its text;
    a date or heading before it makes them a row without an amount. A statement of any length spreads over tasks (pieces).
    """
    held = _sections(_dealt(_shown(lines)))
    live = held.rows.filter(F.col("heading").isNotNull() | ~F.col("suppressed"))
    return dedupe_transactions(finish(_in_place(_gathered(replace(held, rows=_classified(live, year, PIECE)))), "text", year))


def _meaning(text: str) -> bool:
    return len(text) >= 3 and re.search(r"[A-Za-z]{2,}", text) is not None


_TAIL = re.compile(r"(?:\s*(?:-?\$?\d{1,3}(?:,\d{3})*\.\d{2}|\(\d{1,3}(?:,\d{3})*\.\d{2}\)))+\s*$")


def _tidy(text: str) -> str:
    return re.sub(r"(?i)\bEFT[I/]?ACH\b", "EFT/ACH", _TAIL.sub("", text).strip())


_FOUND = "statement_id string, __piece int, line_no int, what string, date int, text string, amount double, section string, taken int"


def _opened(rows: Iterator[tuple]) -> Iterator[tuple]:
    """What each stretch of lines from a heading, a dated line or a row of checks gives: at most one row, the ends of runs of
    rows (`close`, or the `checks` themselves), and lines that may continue an earlier row (`line`).

    A row is open from its date until it has an amount and a meaningful text, and takes two more lines after that.
    """
    for (statement, _), events in groupby(rows, key=itemgetter(0, 1)):
        open_ = done = None  # [piece, line_no, date, text, amount, section, lines taken]
        for _, _, piece, line_no, event, section, date, body, amount in events:
            if event == "checks":
                yield statement, piece, line_no, event, None, body, None, section, None
            elif event == "heading":
                yield statement, piece, line_no, "close", None, None, None, None, None
            elif event == "dated":
                open_ = [piece, line_no, date, body, amount, section, 0] if date is not None else None
            elif amount is not None:
                if open_ is not None and open_[4] is None:
                    open_[4], open_[3] = amount, f"{open_[3]} {body}".strip() if body else open_[3]
            elif open_ is not None:
                open_[3] = _longer(open_[3], body) or open_[3]
            elif done is not None:
                _continue(done, body)
            else:
                yield statement, piece, line_no, "line", None, body, None, None, None
            if open_ is not None and open_[4] is not None and _meaning(_tidy(open_[3])):
                done, open_ = open_, None
                done[3] = _tidy(done[3])
        if done is not None:
            yield statement, done[0], done[1], "row", *done[2:]


def _longer(text: str, body: str, tidy=str) -> str | None:
    joined = tidy(f"{text} {body}".strip())
    return joined if len(joined) <= LONGEST else None


def _continue(row: list, body: str) -> None:
    """A line's text added to a row's, unless it has two or would be too long."""
    if row[6] < CONTINUATIONS and (joined := _longer(row[3], body, _tidy)) is not None:
        row[3], row[6] = joined, row[6] + 1


def _continued(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Rows with the lines that follow them before the next row or end: of each run, the row is first. Checks pass."""
    for (statement, _), found in groupby(rows, key=itemgetter(0, 1)):
        row = None
        for _, _, piece, line_no, what, date, text, amount, section, taken in found:
            if what == "row":
                row = [piece, line_no, date, text, amount, section, taken]
            elif what == "checks":
                yield statement, piece, line_no, what, date, text, amount, section
            elif what == "line" and row is not None:
                _continue(row, text)
        if row is not None:
            yield statement, *row[:2], "row", *row[2:6]


def _both(rows: Iterator[tuple]) -> Iterator[tuple]:
    """_opened(), then _continued(), of whole statements."""

    def numbered(found: Iterator[tuple]) -> Iterator[tuple]:
        run = 0
        for statement, *rest in found:
            run += rest[2] != "line"
            yield statement, run, *rest

    return _continued(numbered(_opened(rows)))


def _strict(events: Ordered) -> Ordered:
    """Rows of parse_scan() from its events, without those of checks."""
    return _read(events).then(lambda rows: rows.filter("what = 'row'").drop("what"))


def _read(events: Ordered) -> Ordered:
    """Rows of parse_scan() from its events: event, section, date, body, amount, junk of a line; `what`: row, or checks, which
    keep their body as description.

    A stretch begins at a heading, a row of checks or a date, and can be read without those before it; a second walk gives
    rows the lines of later stretches that continue them. If a statement is cut, each is a step of its own, over many short
    runs. Else a task walks the statements that the windows left it. Lines that change nothing stay out of the walks.
    """
    marks, line = F.col("event").isin("heading", "checks"), F.col("event") == "line"
    told = events.carried(count={"__stretch": ~line}, last_before={"__before": F.when(marks, F.struct("section"))})
    idle = F.when(line, F.col("junk") & F.col("amount").isNull()).otherwise((F.col("event") == "heading") & F.col("section").eqNullSafe(F.col("__before.section")))
    body = F.when(line & F.col("junk"), "").otherwise(F.col("body"))
    told = told.then(lambda rows: rows.filter(~idle).select("statement_id", "__stretch", PIECE, "line_no", "event", "section", F.unix_date("date").alias("date"), body.alias("body"), "amount"))
    kind = "statement_id string, __piece int, line_no int, what string, date int, description string, amount double, section string"
    if told.cut:
        found = walked(told.rows, ["statement_id", "__stretch"], ["line_no"], _opened, _FOUND)
        runs = replace(told, rows=found).carried(count={"__run": F.col("what") != "line"})
        columns = ["statement_id", "__run", PIECE, "line_no", "what", "date", "text", "amount", "section", "taken"]
        rows = walked(runs.rows.select(*columns), ["statement_id", "__run"], ["line_no"], _continued, kind)
    else:
        rows = walked(told.rows, ["statement_id"], ["line_no"], _both, kind, placed=True)
    return replace(told, rows=rows.withColumn("date", F.date_from_unix_date("date")))


def parse_scan(lines: DataFrame, year: Column) -> DataFrame:
    """Transactions of the lines of a scanned statement, strictly: what cannot be told from noise is left out.

    Amounts are repaired, split dates fused and stray numbers spliced first. Nothing counts after the first ending
    heading. Only a full date begins a row; check sections give a row for each date, number and amount of a line, and
    nothing else; two lines that follow a row continue its text. Rows are to review, as finish() says.
    """
    fixed = _dealt(_shown(lines)).then(lambda rows: rows.withColumn("text", repair.fix_money(F.col("text"))))
    held = _until_end(_sections(_spliced(_fused(fixed))))
    live = held.rows.filter(F.col("heading").isNotNull() | ~predicates.is_skipped(F.col("text"), F.col("heading")))
    plain, in_checks = F.col("heading").isNull(), F.coalesce(F.col("section") == "check", F.lit(False))
    listed = plain & in_checks & F.col("text").rlike(TRIPLET)
    live = live.withColumn("__listed", listed).filter(F.col("heading").isNotNull() | F.col("__listed") | ~in_checks)
    dated = F.col("text").rlike(FULL_DATE)
    event = F.when(F.col("heading").isNotNull(), "heading").when(F.col("__listed"), "checks").when(dated, "dated").otherwise("line")
    live = live.withColumn("event", event)
    rest = F.when(F.col("event") == "dated", F.coalesce(F.regexp_extract("text", FULL_DATE, 2), F.lit(""))).otherwise(F.col("text"))
    told = F.col("event").isin("dated", "line")
    live = live.withColumn("__rest", rest).withColumn("__amounts", F.when(told, coerce.amounts(F.col("__rest"))))
    as_it_is = ~told | ((F.col("event") == "line") & (F.size("__amounts") == 0))
    live = live.withColumn("__body", F.when(as_it_is, F.col("__rest")).otherwise(_no_amounts(F.trim("__rest"))))
    events = live.select(
        "statement_id", PIECE, F.col("line_no").cast("int").alias("line_no"), "event", "section", F.when(F.col("event") == "dated", coerce.normal_date(F.regexp_extract("text", FULL_DATE, 1), year)).alias("date"),
        F.col("__body").alias("body"), coerce.pick_amount(F.col("__amounts")).alias("amount"), F.when(F.col("event") == "line", predicates.is_ocr_junk(F.col("__body"))).otherwise(False).alias("junk"),
    )
    read = _read(replace(held, rows=events))
    own = _scan_row(F.lit(0), F.col("date"), F.col("description"), F.col("amount"), _number(F.col("description")), F.col("section"))
    each = F.when(F.col("what") == "checks", _checks(F.col("description"), year)).otherwise(F.array(own))
    rows = read.rows.select("statement_id", PIECE, "line_no", F.inline(each)).filter("date is not null")
    rows = rows.select("statement_id", PIECE, _place(F.col("line_no"), F.col("place")), "date", "description", "amount", "check_no", "section")
    return finish(_in_place(replace(read, rows=rows, order="__place")), "scan", year)


def assemble_words(words: DataFrame, tolerance: float) -> DataFrame:
    """Lines of words (page, x, y, text): words of one rounded height, from left to right. Halves round to even."""
    height = F.rint(F.col("y") / tolerance).cast("long")
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "text"))), lambda w: w["text"]), " ")
    return words.filter("text <> ''").groupBy("page", height.alias("row")).agg(line.alias("text"))


def header_columns(cells: Column) -> Column:
    """Places (from 1) of date, text, amount and number that a header's cells name; null where none does.

    A header of a number and an amount without a text: the last of the other cells is the text.
    """
    low = F.transform(cells, lambda c: F.lower(F.trim(F.coalesce(c, F.lit("")))))
    place = lambda test: F.nullif(F.array_position(F.transform(low, test), True), F.lit(0)).cast("int")
    d = place(lambda c: c.contains("date"))
    t = place(lambda c: c.rlike("description|detail|memo|payee"))
    c = place(lambda c: c.contains("check") & ~c.contains("date"))
    a = place(lambda c: c.isin("amount", "debit", "credit", "withdrawal", "deposit") | c.contains("amount"))
    other = F.filter(F.sequence(F.lit(1), F.size(cells)), lambda i: ~F.coalesce(i == d, F.lit(False)) & (i != c) & (i != a))
    t = F.coalesce(t, F.when(c.isNotNull() & a.isNotNull(), F.try_element_at(other, F.lit(-1))))
    return F.struct(d.alias("d"), t.alias("t"), a.alias("a"), c.alias("c"))


def parse_tables(cells: DataFrame, year: Column) -> DataFrame:
    """Transactions of table rows (statement_id, table_no, row_no, cells), as finish() gives them.

    Rows that are headings set the section of a table, or end it. A header's places hold from it on until the next
    heading; the first header after a heading also holds for up to seven rows before it. Other rows are read by position.
    """
    table = Window.partitionBy("statement_id", "table_no").orderBy("row_no")
    clean = F.transform("cells", lambda c: F.trim(F.coalesce(c, F.lit(""))))
    tasks = tasks_for(cells)
    rows = cells.repartition(tasks, "statement_id", "table_no").withColumn("cells", clean).withColumn("__joined", F.array_join("cells", " ")).withColumn("heading", predicates.section_of(F.col("__joined")))
    # All prefixes of a table share one sort, all of a run another: each sort holds its task's rows.
    every = (Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumns({"__n": F.count("*").over(table.rowsBetween(*every)), "section": F.last("heading", ignorenulls=True).over(table), "__run": F.count("heading").over(table)})
    rows = rows.filter((F.col("__n") > 1) & (F.size("cells") > 0) & F.col("heading").isNull() & (F.coalesce(F.col("section"), F.lit("")) != "end")).drop("__n", "heading")
    low = F.lower("__joined")
    header, named = predicates.is_column_header(F.col("__joined")), low.contains("date") & low.rlike("amount|debit|credit|check|description")
    rows = rows.withColumn("__header", header).withColumn("__places", F.when(header | named, header_columns(F.col("cells"))))
    run = Window.partitionBy("statement_id", "table_no", "__run").orderBy("row_no")
    first = F.min(F.when(named, F.struct("row_no", "__places"))).over(run.rowsBetween(*every))
    latest = F.last(F.when(F.col("__header"), F.col("__places")), ignorenulls=True).over(run)
    rows = rows.withColumns({"__first": first, "__latest": latest})
    places = F.coalesce("__latest", F.when(F.col("row_no") >= F.col("__first.row_no") - 7, F.col("__first.__places")))
    rows = rows.withColumn("__places", places).filter("not __header")
    made = rows.withColumn("__r", cells_row(F.col("cells"), F.col("section"), year, F.col("__places"))).filter("__r is not null")
    placed = made.select("statement_id", "table_no", "row_no", "__r.*", "section").repartition(tasks, "statement_id")
    return finish(placed.withColumn("ord", F.row_number().over(Window.partitionBy("statement_id").orderBy("table_no", "row_no"))), "text", year)


def choose(fast: DataFrame, scanned: DataFrame, least: int = FEW_ROWS) -> DataFrame:
    """Rows of text and tables (fast); with those of the scan for statements that have fewer than `least` of them.

    Equal rows are kept once, the first by ord, those of the scan after the others; balances and totals are dropped.
    """
    plain_unions(fast.sparkSession)
    clean = lambda rows: dedupe_transactions(rows).filter(~predicates.is_balance_row(F.col("description")))
    columns = [c for c in fast.columns if c in scanned.columns]
    fast, scanned = clean(fast).select(columns), clean(scanned).select(columns)
    full = fast.groupBy("statement_id").agg(F.count("*").alias("__n")).filter(F.col("__n") >= least).select("statement_id")
    last = fast.groupBy("statement_id").agg(F.max("ord").alias("__last"))
    more = scanned.join(full, "statement_id", "left_anti").join(last, "statement_id", "left")
    more = more.withColumn("ord", (F.col("ord") + F.coalesce("__last", F.lit(0))).cast(fast.schema["ord"].dataType)).drop("__last")
    return clean(fast.unionByName(more))


def review(rows: DataFrame) -> DataFrame:
    """Rows checked: a bad or missing date or amount, a number that is none, a bad month or confidence.

    Any fault asks for review, is added to the reasons, and lowers High to Medium; a bad month is taken from the date.
    """
    date, number, month = coerce.blank(F.col("date")), coerce.blank(F.col("check_no")), coerce.blank(F.col("year_month"))
    confidence, amount = coerce.blank(F.col("confidence")), coerce.blank(F.col("amount"))
    bad_month, no_number = (month != "") & ~month.rlike(r"^\d{4}-\d{2}$"), F.translate(amount, ",", "").try_cast("double").isNull()
    faults = F.array_compact(F.array(
        F.when(date == "", "Missing date").when(~date.rlike(r"^\d{4}-\d{2}-\d{2}$"), "Date format uncertain"),
        F.when(amount == "", "Missing amount").when(no_number, F.concat(F.lit("Invalid SignedAmount: "), amount)),
        F.when((number != "") & ~number.rlike(r"^\d+$"), F.concat(F.lit("Check# may need review: "), number)),
        F.when(bad_month & (F.length(date) < 7), "YearMonth adjusted"),
        F.when(~confidence.isin("High", "Medium", "Low", ""), "Invalid Confidence corrected"),
    ))
    bad = F.size(faults) > 0
    known = F.when(confidence.isin("High", "Medium", "Low", ""), confidence).otherwise("Medium")
    reasons = F.concat(F.filter(F.array(coerce.blank(F.col("review_reason"))), lambda r: r != ""), faults)
    return rows.withColumns({
        "year_month": F.when(bad_month & (F.length(date) >= 7), F.substring(date, 1, 7)).otherwise(month), "confidence": F.when(bad & (known == "High"), "Medium").otherwise(known),
        "needs_review": F.when(bad, "Yes").otherwise(F.col("needs_review")), "review_reason": F.array_join(reasons, "; "),
    })
