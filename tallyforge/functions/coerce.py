"""Column functions that turn text into money, dates, flags, numbers and names. None raises on bad input."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that stand for yes and true, and prefixes that are not part of a payee.
YES_WORDS = ("yes", "y", "true", "1", "needs review")
TRUE_WORDS = ("yes", "y", "true", "1", "✔", "✓")
NOISE_PREFIXES = (
    "pos purchase", "pos pur", "pos debit", "debit card purchase", "debit card", "card purchase", "card tran", "ach debit", "ach credit", "ach deposit",
    "ach withdrawal", "electronic debit", "electronic credit", "online banking transfer", "online banking", "mobile deposit", "atm withdrawal", "atm deposit",
    "check #", "check#", "eft/ach", "eft ach", "merch bnkcd", "merch setl", "bnkcd", "inst xfer", "internet transfer", "wire transfer", "wire", "epay",
    "zelle payment", "zelle", "venmo payment", "venmo", "paypal", "regular deposit", "deposit", "withdrawal", "transfer",
)

AMOUNT = r"\(?-?\$?(?:\d{1,3}(?:,\d{3})*|\d+)\.\d{2}\)?"
DATE_TOKEN = r"\b(?:\d{4}-\d{2}-\d{2}|\d{1,2}[/-]\d{1,2}(?:[/-]\d{2,4})?)\b"


def let(value: Column, body) -> Column:
    """body of the value, which is computed once however often the body names it: expressions do not grow into each other."""
    return F.element_at(F.transform(F.array(value), body), 1)


def blank(x: Column) -> Column:
    """Trimmed text, with null as the empty text: the two are one missing value."""
    return F.trim(F.coalesce(x.cast("string"), F.lit("")))


def money(x: Column) -> Column:
    """Double without `$` and `,`; 0.0 if it is not a number."""
    return F.coalesce(F.translate(blank(x), "$,", "").try_cast("double"), F.lit(0.0))


def money_text(x: Column) -> Column:
    """Whole dollars with separators; an empty text for null."""
    return F.coalesce(F.concat(F.lit("$"), F.format_number(F.bround(x, 0), 0)), F.lit(""))


def request_label(number: Column, name: Column) -> Column:
    """A request's number, without a fraction of zero, and its client."""
    return F.concat_ws(" \u2013 ", F.regexp_replace(blank(number), r"^(\d+)\.0$", "$1"), blank(name))


def yes_no(x: Column) -> Column:
    return F.when(F.lower(blank(x)).isin(*YES_WORDS), "Yes").otherwise("No")


def flag(x: Column) -> Column:
    return F.lower(blank(x)).isin(*TRUE_WORDS)


def request_id(x: Column) -> Column:
    """Integer of texts such as `12` and `12.0`; null for others."""
    return blank(x).try_cast("double").try_cast("int")


def parse_date(x: Column) -> Column:
    """ISO, then month/day/year, on the first ten characters; null for anything else."""
    head = F.substring(blank(x), 1, 10)
    return F.coalesce(F.try_to_date(head, "yyyy-MM-dd"), F.try_to_date(head, "M/d/yyyy"))


def service_date(x: Column) -> Column:
    """ISO text of a date written year-month-day, month/day/year (of four or two digits) or year/month/day; else its first ten characters."""
    t = blank(x)
    head = F.substring(t, 1, 10)
    day = F.coalesce(*[F.try_to_date(head, f) for f in ("yyyy-MM-dd", "M/d/yyyy", "M/d/yy", "yyyy/M/d")])
    return F.coalesce(F.date_format(day, "yyyy-MM-dd"), head)


def normal_date(x: Column, year: Column) -> Column:
    """Date of a text that begins with one, or else of the first inside it. Years of two digits turn at 70.

    Years before 2000 and absent ones are `year`.
    """
    found = F.regexp_extract(blank(x), f"^({DATE_TOKEN})|({DATE_TOKEN})", 0)

    def of(text: Column) -> Column:
        part = F.split(text, "[/-]")
        month, day, y = (F.try_element_at(part, F.lit(i)).try_cast("int") for i in (1, 2, 3))
        padded = lambda n, width: F.lpad(n.cast("string"), width, "0")
        full = let(F.when(y < 100, y + F.when(y < 70, 2000).otherwise(1900)).otherwise(y), lambda n: F.when(n.isNull() | (n < 2000), year).otherwise(n))
        iso = F.when(text.rlike(r"^\d{4}-"), F.try_to_date(text, "yyyy-MM-dd"))  # a failed reading costs much more than a look
        return F.coalesce(iso, F.try_to_date(F.concat_ws("-", padded(full, 4), padded(month, 2), padded(day, 2)), "yyyy-MM-dd"))

    return F.when(found != "", let(found, of))


def amounts(line: Column) -> Column:
    """All amounts of a line as doubles. Negative: a parenthesis or minus before, or a minus one space before."""
    tokens = F.regexp_extract_all(line, F.lit(r"(?:-\s?)?" + AMOUNT), F.lit(0))

    def value(token: Column) -> Column:
        size = F.regexp_replace(token, r"[^0-9.]", "").cast("double")
        return F.when(token.startswith("(") | token.startswith("-"), -size).otherwise(size)

    return F.transform(tokens, value)


def pick_amount(values: Column, prefer: str = "first_with_balance") -> Column:
    """One of a line's amounts: the last, or the first other than zero; null of none, the last zero of zeros only."""
    at = F.lit(-1 if prefer == "last" else 1)

    def of(values: Column) -> Column:
        real = F.filter(values, lambda v: F.abs(v) > 0.001)
        return F.coalesce(F.try_element_at(real, at), F.try_element_at(values, F.lit(-1)))

    return let(values, of)


def strip_amounts(text: Column) -> Column:
    """Without the amounts at its end."""
    one = r"(?:-?\$?\d{1,3}(?:,\d{3})*\.\d{2}|\(\d{1,3}(?:,\d{3})*\.\d{2}\))"
    return F.trim(F.when(text.rlike(r"[\d)]\s*$"), F.regexp_replace(text, rf"(?:\s*{one})+\s*$", "")).otherwise(text))


def check_number(x: Column) -> Column:
    """Digits without leading zeros; all zeros stay."""
    digits = F.regexp_replace(blank(x), r"\D", "")
    return F.coalesce(F.nullif(F.ltrim(digits, F.lit("0")), F.lit("")), digits)


def check_number_of(number: Column, description: Column) -> Column:
    """The check number, or one that the description names."""
    named = F.regexp_extract(F.coalesce(description, F.lit("")), r"(?i)\bcheck\s*#?\s*(\d{3,8})\b", 1)
    return F.coalesce(F.nullif(check_number(number), F.lit("")), check_number(named))


def transaction_amount(signed: Column, amount: Column) -> Column:
    number = lambda x: F.translate(blank(x), ",", "").try_cast("double")
    return F.coalesce(number(signed), number(amount))


def cents(amount: Column) -> Column:
    """Whole cents of the absolute amount, the key under which amounts meet."""
    return F.round(F.abs(amount) * 100).cast("long")


def section_sign(amount: Column, section: Column) -> Column:
    return F.when(section.isin("debit", "check"), -F.abs(amount)).when(section == "credit", F.abs(amount)).otherwise(amount)


def payee_of(description: Column, number: Column) -> Column:
    """Merchant of a description: no known prefix, `#n` tail or date at the end; capital texts in title case; 60 characters.

    Of prefixes, the first of the list that fits goes, once.
    """
    d = blank(description)
    prefix = "|".join(rf"\Q{p}\E" for p in NOISE_PREFIXES)
    bare = F.regexp_replace(d, rf"(?i)^(?:{prefix})[ #*:|,.-]*", "")
    bare = F.regexp_replace(bare, r"\s+#\d+\b.*$", "")
    bare = F.regexp_replace(bare, r"\s+\d{1,2}[/-]\d{1,2}(?:[/-]\d{2,4})?\s*$", "")
    bare = F.trim(F.regexp_replace(bare, r"\s{2,}", " "))
    name = let(bare, lambda x: F.substring(F.when((F.upper(x) == x) & x.rlike("[A-Z]") & (F.length(x) > 3), title_case(x)).otherwise(x), 1, 60))
    is_check = (blank(number) != "") | d.rlike(r"(?i)^check\s*#?\s*\d{3,6}\b")
    return F.when((d == "") | is_check, "").otherwise(name)


def title_case(x: Column) -> Column:
    """A capital at the start of each run of letters, small letters behind it: also after an apostrophe."""
    return F.array_join(F.transform(F.regexp_extract_all(F.lower(x), F.lit(r"\p{L}+|\P{L}+"), F.lit(0)), F.initcap), "")


def confidence_label(x: Column) -> Column:
    return F.when(x.isNull(), "Medium").when(x >= 0.9, "High").when(x >= 0.75, "Medium").otherwise("Low")


def relative_phrase(raw: Column, as_of: Column) -> Column:
    """Of an ISO date's text: today, yesterday, and n days, weeks or months ago; from a year on, the text itself. Blank: a dash."""
    text = blank(raw)
    n = F.datediff(as_of, F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd"))
    ago = lambda k, unit: F.concat(k.cast("string"), F.when(k == 1, F.lit(f" {unit} ago")).otherwise(F.lit(f" {unit}s ago")))
    near = F.when(n <= 0, "today").when(n == 1, "yesterday").when(n < 7, ago(n, "day")).when(n < 30, ago(F.floor(n / 7), "week")).when(n < 365, ago(F.floor(n / 30), "month"))
    return F.when(text == "", "\u2014").otherwise(F.coalesce(near, text))


def range_of(pages: Column) -> Column:
    """The text of an array of page numbers from 0, as ranges of numbers from 1: `1-3,5`. The inverse of pages_of()."""
    each = F.array_sort(F.array_distinct(F.filter(pages, lambda p: p.isNotNull())))
    numbered = F.transform(each, lambda p, i: F.struct((p - i).alias("run"), (p + 1).alias("page")))
    runs = F.array_distinct(F.transform(numbered, lambda s: s["run"]))

    def text(run: Column) -> Column:
        mine = F.transform(F.filter(numbered, lambda s: s["run"] == run), lambda s: s["page"].cast("string"))
        return F.when(F.size(mine) == 1, F.element_at(mine, 1)).otherwise(F.concat_ws("-", F.element_at(mine, 1), F.element_at(mine, -1)))

    return F.coalesce(F.array_join(F.transform(runs, text), ","), F.lit(""))


def pages_of(ranges: Column) -> Column:
    """Page numbers of a text such as `1-3,5`, sorted, once each."""
    parts = F.filter(F.transform(F.split(ranges, ","), lambda p: F.trim(p)), lambda p: p.rlike(r"^\d+(-\d+)?$"))

    def span(p: Column) -> Column:
        low = F.element_at(F.split(p, "-"), 1).cast("int")
        high = F.coalesce(F.try_element_at(F.split(p, "-"), F.lit(2)).cast("int"), low)
        return F.when(high >= low, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(parts, span))))


def register_pages(kept: Column, first: Column, last: Column, count: Column) -> Column:
    """Kept page numbers (from 0) without those of the imaging range (from 1), which ends at the document's last page.

    A range that begins behind the last page excludes nothing.
    """
    end = F.when(first > count, F.lit(0)).otherwise(F.least(last, count))
    return F.filter(kept, lambda p: ~(p + 1).between(first, end))


def redact_digits(text: Column) -> Column:
    return F.regexp_replace(text, r"\b\d{9,}\b", "[acct]")
