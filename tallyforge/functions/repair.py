"""Repairs of recognised text, and texts derived from descriptions and notes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .coerce import blank, let

# Amounts whose digits may be read as letters.
MONEY = r"(?<![A-Za-z0-9])\$?(?:[\dOoIl]{1,3}(?:,[\dOoIl]{3})+|[\dOoIl]+)\.[\dOoIl]{2}(?![A-Za-z0-9])"
# What every such amount with a letter holds.
MISREAD = r"[OoIl][\dOoIl,]*\.[\dOoIl]{2}|\.(?:[OoIl][\dOoIl]|\d[OoIl])"

# What a description begins with before its merchant, longer ones first where one begins another, and
# what follows the merchant: numbers, dates, states and the country.
PATTERN_PREFIXES = (
    "DEBIT CARD PURCHASE", "CHECK CARD PURCHASE", "POS DEBIT PURCHASE", "POS PURCHASE", "POS DEBIT", "ACH DEBIT", "ACH CREDIT", "ACH DEPOSIT", "ACH WITHDRAWAL",
    "ACH PAYMENT", "ELECTRONIC DEBIT", "ELECTRONIC CREDIT", "ELECTRONIC WITHDRAWAL", "ELECTRONIC DEPOSIT", "ONLINE BANKING TRANSFER", "ONLINE BANKING",
    "ONLINE PAYMENT", "MOBILE DEPOSIT", "EXTERNAL TRANSFER", "INTERNAL TRANSFER", "ATM WITHDRAWAL", "ATM DEPOSIT", "WIRE TRANSFER", "BILL PAYMENT", "CHECK #",
    "CHECK#", "WITHDRAWAL", "DEPOSIT",
)
STATES = (
    "AL|AK|AZ|AR|CA|CO|CT|DE|FL|GA|HI|ID|IL|IN|IA|KS|KY|LA|ME|MD|MA|MI|MN|MS|MO|MT|NE|NV|NH|NJ|NM|NY|NC|ND|OH|OK|OR|PA|RI|SC|SD|TN|TX|UT|VT|VA|WA|WV|WI|WY"
)
AFTER_MERCHANT = rf"(?:#?\d{{2,}}|\b\d{{1,2}}/\d{{1,2}}(?:/\d{{2,4}})?\b|\b(?:{STATES})\b|\bUS[A]?\b)"


def each_match(text: Column, pattern: str, change) -> Column:
    """text with change() applied to every match of the pattern: what is between matches, and the matches, in turn."""
    between, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.zip_with(between, found, lambda b, m: F.concat(b, F.coalesce(change(m), F.lit(""))))
    return F.array_join(pieces, "")


def fix_money(line: Column) -> Column:
    """Gaps around separators closed, and letters read for 0 and 1 put right, inside amounts alone."""
    closed = F.regexp_replace(line, r"(\d)\s*,\s*([\dOoIl])", "$1,$2")
    closed = F.regexp_replace(closed, r"([\dOoIl])\s*\.\s*([\dOoIl])", "$1.$2")
    fixed = let(closed, lambda x: F.when(x.rlike(MISREAD), each_match(x, MONEY, lambda m: F.translate(m, "OoIl", "0011"))).otherwise(x))
    return fix_transfers(fixed)


def fix_transfers(line: Column) -> Column:
    return F.regexp_replace(line, r"(?i)\bEFT[I/]?ACH\b", "EFT/ACH")


def suggest_pattern(description: Column, longest: int = 32) -> Column:
    """A rule's pattern: the description without a known prefix, up to the first number, date or state unless that is at its start.

    Where nothing is left, the description's first word.
    """
    whole = F.trim(F.regexp_replace(blank(description), r"\s+", " "))
    prefix = "|".join(rf"\Q{p}\E" for p in PATTERN_PREFIXES)
    bare = F.regexp_replace(whole, rf"(?i)^(?:{prefix})[ \-:#*]*", "")

    def cut(bare: Column) -> Column:
        head = F.regexp_extract(bare, rf"(?is)^(.*?){AFTER_MERCHANT}", 1)
        short = lambda x: F.when(F.length(x) > longest, F.regexp_replace(F.substring(x, 1, longest), r"[ \-:#*,]+$", "")).otherwise(x)
        return let(F.when(head == "", bare).otherwise(_stripped(head)), short)

    words = F.filter(F.transform(F.split(whole, " "), _stripped), lambda w: w != "")
    kept = let(F.when(bare == "", whole).otherwise(bare), cut)
    return F.coalesce(F.nullif(kept, F.lit("")), F.substring(F.try_element_at(words, F.lit(1)), 1, longest), F.lit(""))


def _stripped(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(x, r"^[ \-:#*,]+", ""), r"[ \-:#*,]+$", "")


def rewrite_reason(reason: Column, stale: list[str], note: Column) -> Column:
    """Notes joined by `; `, without those that begin with a stale one, and with `note` at the end, once."""
    notes = F.filter(F.split(blank(reason), r";\s*"), lambda n: n != "")
    for s in stale:
        notes = _without(notes, s)
    return F.array_join(F.array_distinct(F.concat(notes, F.filter(F.array(blank(note)), lambda n: n != ""))), "; ")


def _without(notes: Column, stale: str) -> Column:
    return F.filter(notes, lambda n: ~F.lower(n).startswith(stale.lower()))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(blank(text)), "[^a-z0-9]+", "-"), "^-|-$", "")


def expand_grade(code: Column, names: dict[str, str]) -> Column:
    """The name of a grade's code, in either case; null for unknown ones."""
    return F.create_map(*[F.lit(x) for pair in names.items() for x in pair])[F.upper(blank(code))]
