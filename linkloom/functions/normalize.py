"""Text normalisers as Column -> Column. Null is empty.

Character classes are spelled out: Java's ``\\w`` is ASCII only, and its Unicode
variant takes in combining marks that are no word characters here.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from linkloom.functions.unicode import ascii_fold, nfkc

#: Whole words of names and what replaces them, in this order.
NAME_WORDS = (
    ("private limited", "pvt"),
    ("private ltd", "pvt"),
    ("pvt limited", "pvt"),
    ("pvt ltd", "pvt"),
    ("incorporated", "inc"),
    ("corporation", "corp"),
    ("company", "co"),
    ("limited", "ltd"),
)

#: Whole words of addresses and what replaces them, in this order.
ADDRESS_WORDS = (
    ("street", "st"),
    ("road", "rd"),
    ("avenue", "ave"),
    ("boulevard", "blvd"),
    ("highway", "hwy"),
    ("lane", "ln"),
    ("drive", "dr"),
    ("circle", "cir"),
    ("parkway", "pkwy"),
    ("place", "pl"),
    ("suite", "ste"),
    ("floor", "fl"),
)

#: Legal forms that may end a structural name.
TRAILING_FORMS = ("pvt", "ltd", "llc", "llp", "inc", "corp", "co")

#: Legal forms that are left out of a core name wherever they stand.
LEGAL_SUFFIXES = ("inc", "incorporated", "corp", "corporation", "co", "company", "llc", "llp", "ltd", "limited", "plc", "pc", "pvt", "private", "public", "lp")


def text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def strip(c: Column) -> Column:
    """White space of all kinds off both ends; trim() takes spaces only."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def ascii_text(c: Column | str) -> Column:
    """Lower case, runs of anything but a-z and 0-9 to one space."""
    return F.trim(F.regexp_replace(F.lower(text(c)), "[^a-z0-9]+", " "))


def composed(c: Column | str) -> Column:
    """Lower case, stripped, NFKC. Lower case comes first: compatibility capitals stay capitals."""
    return nfkc(strip(F.lower(text(c))))


def unicode_text(c: Column | str) -> Column:
    """Composed; runs of anything but letters, numbers and _ to one space."""
    return F.trim(F.regexp_replace(composed(c), r"[^\p{L}\p{N}_]+", " "))


def punctuated(c: Column | str) -> Column:
    """Composed; runs of white space to one space, punctuation kept."""
    return strip(F.regexp_replace(composed(c), r"(?U)\s+", " "))


def compact(c: Column | str) -> Column:
    """Composed; letters, numbers and _ only."""
    return F.regexp_replace(composed(c), r"[^\p{L}\p{N}_]", "")


def spaced(c: Column | str) -> Column:
    """Punctuated, then each other character to a space of its own: two spaces may follow each other."""
    return F.regexp_replace(punctuated(c), r"(?U)[^\p{L}\p{N}_\s]", " ")


def digit_masked(c: Column | str) -> Column:
    """Punctuation deleted, digit runs to #, white space collapsed."""
    kept = F.regexp_replace(punctuated(c), r"(?U)[^\p{L}\p{N}_\s]", "")
    return strip(F.regexp_replace(F.regexp_replace(kept, r"\p{Nd}+", "#"), r"(?U)\s+", " "))


def folded(c: Column | str) -> Column:
    """unicode_text without diacritics."""
    return ascii_fold(unicode_text(c))


def replace_words(c: Column, words: tuple[tuple[str, str], ...]) -> Column:
    return reduce(lambda x, w: F.regexp_replace(x, rf"\b{w[0]}\b", w[1]), words, c)


def structural_name(c: Column | str) -> Column:
    return replace_words(ascii_text(c), NAME_WORDS)


def name_without_suffix(c: Column | str) -> Column:
    """Structural name without the legal forms at its end; may be empty."""
    forms = "|".join(TRAILING_FORMS)
    return F.regexp_replace(structural_name(c), rf"(^|\s+)({forms})(\s+({forms}))*$", "")


def name_compact(c: Column | str) -> Column:
    return F.regexp_replace(name_without_suffix(c), "[^a-z0-9]", "")


def name_sorted(c: Column | str) -> Column:
    return F.array_join(F.array_sort(F.split(name_without_suffix(c), " ")), " ")


def structural_address(c: Column | str) -> Column:
    return replace_words(ascii_text(c), ADDRESS_WORDS)


def address_compact(c: Column | str) -> Column:
    return F.regexp_replace(structural_address(c), "[^a-z0-9]", "")


def address_number_key(c: Column | str) -> Column:
    """Different digit runs, sorted as text and joined by |; empty with fewer than two runs."""
    n = F.regexp_extract_all(structural_address(c), F.lit("([0-9]+)"), 1)
    return F.when(F.size(n) >= 2, F.array_join(F.array_sort(F.array_distinct(n)), "|")).otherwise("")


def core_name(c: Column | str) -> Column:
    """unicode_text without legal forms anywhere, order kept."""
    return F.array_join(F.filter(F.split(unicode_text(c), " "), lambda x: (x != "") & ~x.isin(*LEGAL_SUFFIXES)), " ")


def sorted_name(c: Column | str) -> Column:
    return F.array_join(F.array_sort(F.split(core_name(c), " ")), " ")
