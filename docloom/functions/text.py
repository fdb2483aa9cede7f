"""Scalar text rules as Spark expressions; all are null-safe: null in, null out, unless stated."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The shapes of bank identifier codes and account numbers, and the words that make a question broad.
BIC = r"\b([A-Z]{4}[A-Z]{2}[A-Z0-9]{2}(?:[A-Z0-9]{3})?)\b"
IBAN = r"\b([A-Z]{2}\d{2}[A-Z0-9]{10,30})\b"
BROAD_WORDS = ["all", "every", "full", "complete", "entire", "list all", "download"]

#: Every white-space character, beyond the spaces that trim() takes by itself.
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """Looks at both ends only: an expression for these would be tried at each place of a long text."""
    return F.btrim(c, F.lit(WHITE))


def tokens(c: Column) -> Column:
    """Lower-cased runs between white space."""
    return F.array_remove(F.split(F.lower(c), r"(?U)[\s\x1c-\x1f]+"), "")


def words(c: Column) -> Column:
    return F.array_remove(F.split(c, r"(?U)[\s\x1c-\x1f]+"), "")


def codes(c: Column) -> Column:
    """Identifier codes as they stand, repeats included; lower-case letters never match."""
    return F.regexp_extract_all(c, F.lit(BIC), F.lit(1))


def account_numbers(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(IBAN), F.lit(1))


def scope(row_text: Column) -> Column:
    """The value of a row's first field, upper-cased: what stands after the first colon of its first line; null if nothing."""
    line = F.split_part(row_text, F.lit("\n"), F.lit(1))
    value = strip(F.regexp_extract(line, r"(?s)^[^:]*:(.*)$", 1))
    return F.when(F.contains(line, F.lit(":")) & (value != ""), F.upper(value))


def flatten_row(cells: Column) -> Column:
    """'header: value' lines of array<struct<k,v>>; blank values are left out."""
    held = F.filter(cells, lambda c: strip(c["v"]) != "")
    return F.array_join(F.transform(held, lambda c: F.concat(c["k"], F.lit(": "), strip(c["v"]))), "\n")


def is_broad(question: Column) -> Column:
    """Whether one of the broad words is anywhere in the question, inside other words too."""
    return F.lower(question).rlike("|".join(w for w in BROAD_WORDS if " " not in w))


def prefix(doc_name: Column, heading: Column) -> Column:
    """What stands before a child's text when it is indexed: where it comes from."""
    label = F.translate(F.replace(doc_name, F.lit(".json"), F.lit("")), "_", " ")
    return F.when(heading != "", F.concat(F.lit("["), label, F.lit(" | "), heading, F.lit("] "))).otherwise(F.concat(F.lit("["), label, F.lit("] ")))


def parent_text(heading: Column, preamble: Column, rows: Column, notes: Column) -> Column:
    """Section line, preamble, rows and notes, one under another; empty parts are left out."""
    first = F.when(heading != "", F.concat(F.lit("[Section: "), heading, F.lit("]")))
    return F.array_join(F.concat(F.array_compact(F.array(first, F.when(preamble != "", preamble))), rows, notes), "\n")
