"""String functions: comparable titles and similarity of strings."""

from __future__ import annotations

import re
import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The clauses, editions and brackets that are taken off a title, in this order.
GUEST_CLAUSE = r"\b(feat|ft|featuring|with)\b.*"
EDITION_SUFFIX = r"\s*-\s*(remaster(ed)?|radio edit|single version|album version|live|bonus track|deluxe|explicit|clean)\b.*"
BRACKETED = r"[\(\[].*?[\)\]]"
OTHER_SIGNS = r"[^\w\s]"


def normalize_text(text: str | None) -> str:
    """A title in comparable form, for one Python string."""
    if text is None:
        return ""
    plain = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).lower().strip()
    for pattern in (GUEST_CLAUSE, EDITION_SUFFIX, BRACKETED):
        plain = re.sub(pattern, "", plain)
    return " ".join(re.sub(OTHER_SIGNS, " ", plain).split())


@cache
def _latin_letters() -> tuple[str, str]:
    """Accented Latin letters and their base letters, by Unicode decomposition."""
    pairs = {}
    for code in (*range(0x00A0, 0x0250), *range(0x1E00, 0x1F00)):
        base = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c))
        if len(base) == 1 and base != chr(code):
            pairs[chr(code)] = base
    return "".join(pairs), "".join(pairs.values())


def _normalize_udf(col: Column) -> Column:
    @F.pandas_udf("string")
    def normalized(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else normalize_text(t))

    return normalized(col)


def normalize_title(col: Column | str, any_script: bool = True) -> Column:
    """A title in comparable form; null is empty.

    ASCII and accented Latin stay in the JVM. With ``any_script``, strings with other
    characters go through Python, which alone has Unicode decomposition; the rest pass it as
    nulls.
    """
    col = F.col(col) if isinstance(col, str) else col
    out = F.regexp_replace(F.lower(F.translate(col, *_latin_letters())), r"(?U)^\s+|\s+$", "")
    for pattern in (GUEST_CLAUSE, EDITION_SUFFIX, BRACKETED):
        out = F.regexp_replace(out, f"(?Ud){pattern}", "")
    out = F.trim(F.regexp_replace(F.regexp_replace(out, f"(?U){OTHER_SIGNS}", " "), r"(?U)\s+", " "))
    if any_script:
        other = col.rlike(r"[^\x00-\x7FÀ-ɏḀ-ỿ]") | col.rlike("[ĲĳĿŀŉǄ-ǌǱ-ǳẚ]")
        out = F.when(other, _normalize_udf(F.when(other, col))).otherwise(out)
    return F.coalesce(out, F.lit(""))


def artist_key(col: Column | str) -> Column:
    return F.lower(F.trim(F.col(col) if isinstance(col, str) else col))


def similarity_ratio(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length; two empty strings are alike."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


def levenshtein(a: Column, b: Column, max_distance: int | None = None) -> Column:
    """Edit distance in code points; distances over ``max_distance`` count as one more than it."""
    if max_distance is None:
        return F.levenshtein(a, b)
    found = F.levenshtein(a, b, max_distance)
    return F.when(found < 0, max_distance + 1).otherwise(found)


def token_overlap(a: Column, b: Column) -> Column:
    """Shared distinct words over those of the string with fewer; 0 if either has none."""
    words = lambda c: F.array_remove(F.array_distinct(F.split(c, r"\s+")), "")
    least = F.least(F.size(words(a)), F.size(words(b)))
    return F.when(least > 0, F.size(F.array_intersect(words(a), words(b))) / least).otherwise(0.0)


def match_score(query: Column, title: Column) -> Column:
    """Score of normalised strings: 1 if equal, null where lengths differ too much."""
    near = F.abs(F.length(query) - F.length(title)) <= F.greatest(F.length(query), F.length(title)) * 0.5
    return F.when(query == title, 1.0).when(near, F.greatest(similarity_ratio(query, title), 0.95 * token_overlap(query, title)))
