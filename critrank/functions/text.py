"""Text column expressions (all JVM-side, no Python UDFs).

Semantics follow the ranking being reproduced:

* ``tokens``      lower-case, every char outside ``[a-z0-9 ]`` becomes a blank,
                  split on blanks, empties dropped.
* ``normalize_ws`` lower-case and collapse each Unicode whitespace run to one
                  blank (no trim).  ``(?U)`` makes Java's ``\\s`` match NBSP etc.
* ``strip``       remove leading/trailing Unicode whitespace (Spark's ``trim``
                  only removes spaces).
* ``contains_any`` / ``count_contained``: substring containment, no word
                  boundaries ("map" is found in "roadmap").
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

_NON_TOKEN = "[^a-z0-9 ]"


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokens(text) -> Column:
    """ARRAY<STRING> of tokens of a text column.

    Replacing every char outside ``[a-z0-9 ]`` by a blank and splitting on
    blanks yields exactly the maximal runs of ``[a-z0-9]``, so one regex split
    on ``[^a-z0-9]+`` does it; ``array_remove`` drops the empty edge strings
    (no lambda, so no per-token interpreted evaluation).
    """
    return F.array_remove(F.split(F.lower(col_(text)), "[^a-z0-9]+"), "")


def py_tokens(text: str) -> list[str]:
    """The same tokeniser for literal catalog text compiled on the driver."""
    return re.sub(_NON_TOKEN, " ", text.lower()).split()


def normalize_ws(text) -> Column:
    return F.regexp_replace(F.lower(col_(text)), r"(?U)\s+", " ")


def strip(text) -> Column:
    return F.regexp_replace(col_(text), r"(?U)^\s+|\s+$", "")


def contains_flags(text: Column, terms: Iterable[str]) -> list[Column]:
    """One boolean per term: term is a substring of ``text``."""
    return [F.contains(text, F.lit(t)) for t in terms]


def count_contained(text: Column, terms: Iterable[str]) -> Column:
    """Number of listed terms contained in ``text`` (each counted once), INT."""
    flags = [F.when(f, 1).otherwise(0) for f in contains_flags(text, terms)]
    if not flags:
        return F.lit(0)
    total = flags[0]
    for f in flags[1:]:
        total = total + f
    return total


def contained_terms(text: Column, terms: Iterable[str]) -> Column:
    """Sorted ARRAY<STRING> of the listed terms contained in ``text``."""
    terms = list(terms)
    if not terms:
        return F.array().cast("array<string>")
    arr = F.array(*[F.lit(t) for t in terms])
    return F.array_sort(F.filter(arr, lambda t: F.contains(text, t)))


# --- JD header fields -------------------------------------------------------
def jd_title(first_paragraph) -> Column:
    """Text after 'Job Description:' in the first paragraph, else the paragraph."""
    p = col_(first_paragraph)
    found = strip(F.regexp_extract(p, r"(?i)Job Description:(?U)\s*([^\n]+)", 1))
    return F.coalesce(F.when(found != "", found), p, F.lit(""))


def jd_field(raw_text, label: str) -> Column:
    """First 'label: value' anywhere in the text (case-insensitive), stripped, else ''.

    ``\\s*`` may cross a newline, so an empty value takes the next line, as a
    regex search over the joined paragraphs does.
    """
    pattern = r"(?i)" + re.escape(label) + r":(?U)\s*([^\n]+)"
    return F.coalesce(strip(F.regexp_extract(col_(raw_text), pattern, 1)), F.lit(""))


def jd_experience(raw_text) -> tuple[Column, Column]:
    """(min, max) years from 'Experience Required: a-b' (hyphen or en dash), else NULL."""
    pattern = r"(?i)Experience Required:(?U:\s*)([0-9]+)(?U:\s*)[–-](?U:\s*)([0-9]+)"
    t = col_(raw_text)
    lo = F.regexp_extract(t, pattern, 1)
    hi = F.regexp_extract(t, pattern, 2)
    return (F.when(lo != "", lo.cast("double")), F.when(hi != "", hi.cast("double")))
