"""Tokens, numbers and character n-grams as Column -> array Column."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from linkloom.functions import normalize as N

EMPTY = "array<string>"


def words(normalised: Column) -> Column:
    """Words of a normalised text in order; none of an empty one."""
    return F.filter(F.split(normalised, " "), lambda x: x != "")


def tokens(c: Column | str) -> Column:
    return words(N.unicode_text(c))


def long_tokens(c: Column | str, least: int = 4) -> Column:
    return F.filter(tokens(c), lambda x: F.length(x) >= least)


def words_once(normalised: Column) -> Column:
    return F.array_distinct(words(normalised))


def ascii_token_set(c: Column | str) -> Column:
    return words_once(N.ascii_text(c))


def name_tokens(c: Column | str) -> Column:
    """Different words of three or more characters that are no legal forms."""
    return F.array_distinct(F.filter(tokens(c), lambda x: (F.length(x) >= 3) & ~x.isin(*N.LEGAL_SUFFIXES)))


def address_tokens(c: Column | str) -> Column:
    """Different words of four or more characters that are not all digits."""
    return F.array_distinct(F.filter(tokens(c), lambda x: (F.length(x) >= 4) & ~x.rlike(r"^\p{Nd}+$")))


def token_set(c: Column | str) -> Column:
    return F.array_distinct(tokens(c))


def number_runs(c: Column | str) -> Column:
    """Digit runs of the text as it is, in order."""
    return F.regexp_extract_all(N.text(c), F.lit(r"(\p{Nd}+)"), 1)


def number_set(c: Column | str) -> Column:
    return F.array_distinct(number_runs(c))


def sorted_numbers(c: Column | str) -> Column:
    """Different digit runs, sorted as text."""
    return F.array_sort(number_set(c))


def first_run(c: Column | str) -> Column:
    """The first digit run in the text, or null."""
    return F.try_element_at(number_runs(c), F.lit(1))


def least_number(c: Column | str) -> Column:
    """The first digit run in text order of the runs, empty if none."""
    return F.coalesce(F.array_min(number_runs(c)), F.lit(""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value made once.

    What a lambda captures is evaluated for each element, and may not hold a
    Python function; what is bound to its variable is neither.
    """
    return F.transform(F.array(value), lambda x: body(x))[0]


def ngrams(v: Column, n: int) -> Column:
    """Character n-grams in order, with repeats; none of a shorter text. (sequence() would count down.)"""

    def grams(x: Column) -> Column:
        last = F.greatest(F.length(x) - (n - 1), F.lit(1))
        return F.when(F.length(x) >= n, F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(x, i, F.lit(n)))).otherwise(F.array().cast(EMPTY))

    return let(v, grams)


def word_ngrams(words_: Column, n: int) -> Column:
    """Runs of n words joined by a space, in order; none of fewer words."""

    def grams(w: Column) -> Column:
        last = F.greatest(F.size(w) - (n - 1), F.lit(1))
        return F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), last), lambda i: F.array_join(F.slice(w, i, F.lit(n)), " "))).otherwise(F.array().cast(EMPTY))

    return let(words_, grams)


def name_grams(c: Column | str, n: int = 3) -> Column:
    """n-grams of unicode_text without spaces, with repeats."""
    return ngrams(F.replace(N.unicode_text(c), F.lit(" "), F.lit("")), n)


def gram_set(c: Column | str, n: int = 3) -> Column:
    """Different n-grams of ascii_text with its spaces; a shorter text that is not empty is its own gram."""
    return grams_once(N.ascii_text(c), n)


def grams_once(v: Column, n: int = 3) -> Column:
    return F.when(F.length(v) == 0, F.array().cast(EMPTY)).when(F.length(v) < n, F.array(v)).otherwise(F.array_distinct(ngrams(v, n)))


def compact_grams(c: Column | str, n: int = 4) -> Column:
    return F.array_distinct(ngrams(N.compact(c), n))


def spaced_grams(c: Column | str, n: int) -> Column:
    return F.array_distinct(ngrams(N.spaced(c), n))


def sorted_grams(c: Column | str, n: int = 3) -> Column:
    """Compact n-grams with their characters sorted: the same for any order of them."""
    return F.array_distinct(F.transform(ngrams(N.compact(c), n), lambda g: F.array_join(F.array_sort(F.split(g, "")), "")))


def masked_grams(c: Column | str, n: int = 3) -> Column:
    return F.array_distinct(ngrams(N.digit_masked(c), n))


#: Routes by name: the grams that stand for a record on each.
ROUTES: dict[str, Callable[[], Column]] = {
    "NAME_CHAR2": lambda: spaced_grams("business_name", 2),
    "NAME_CHAR3": lambda: spaced_grams("business_name", 3),
    "NAME_CHAR4": lambda: spaced_grams("business_name", 4),
    "NAME_COMPACT_CHAR3": lambda: compact_grams("business_name", 3),
    "NAME_COMPACT_CHAR4": lambda: compact_grams("business_name", 4),
    "NAME_SORTED_CHAR3": lambda: sorted_grams("business_name", 3),
    "ADDRESS_CHAR3": lambda: spaced_grams("business_address", 3),
    "ADDRESS_CHAR4": lambda: spaced_grams("business_address", 4),
    "ADDRESS_COMPACT_CHAR3": lambda: compact_grams("business_address", 3),
    "ADDRESS_COMPACT_CHAR4": lambda: compact_grams("business_address", 4),
    "ADDRESS_SORTED_CHAR3": lambda: sorted_grams("business_address", 3),
    "ADDRESS_DIGIT_CHAR3": lambda: masked_grams("business_address", 3),
}


def route(name: str) -> Column:
    if name not in ROUTES:
        raise ValueError(f"no route {name!r}; there are {', '.join(ROUTES)}")
    return ROUTES[name]()
