"""Why two items match: the similarity as a sum over components."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from latora.functions.vectors import TINY, clip, dot, norm

NOTHING_SHARED = "no component speaks for this match"


def similarity_score(query: Column, candidate: Column, width: int) -> Column:
    nq, nr = norm(query, width), norm(candidate, width)
    return F.when((nq < TINY) | (nr < TINY), 0.0).otherwise(clip(F.try_divide(dot(query, candidate, width), nq * nr)))


def contributions(query: Column, candidate: Column, width: int, top_n: int = 3, descriptions: Sequence[str] | None = None) -> Column:
    """The top_n components by size of their share of the cosine; none where a vector vanishes."""
    nq, nr = norm(query, width), norm(candidate, width)
    safe_q, safe_r = F.when(nq < TINY, 1.0).otherwise(nq), F.when(nr < TINY, 1.0).otherwise(nr)
    described = descriptions or [f"component {k + 1}" for k in range(width)]

    def term(k: int) -> Column:
        q, r = query[k] / safe_q, candidate[k] / safe_r
        return F.struct((-F.abs(q * r)).alias("order"), F.lit(k + 1).alias("component"), (q * r).alias("contribution"), q.alias("query_coordinate"), r.alias("candidate_coordinate"), F.lit(described[k]).alias("description"))

    terms = F.slice(F.array_sort(F.array(*(term(k) for k in range(width)))), 1, max(top_n, 0)) if top_n > 0 else F.array()
    picked = F.transform(terms, lambda t: F.struct(t["component"].alias("component"), t["contribution"].alias("contribution"), t["query_coordinate"].alias("query_coordinate"), t["candidate_coordinate"].alias("candidate_coordinate"), t["description"].alias("description")))
    return F.when((nq >= TINY) & (nr >= TINY), picked).otherwise(F.filter(picked, lambda t: F.lit(False)))


def phrase(term: Column) -> Column:
    """One component in words: both items on the same side of zero, or on opposite sides."""
    axis = F.concat(F.lit("component "), term["component"].cast("string"), F.lit(": "), term["description"])
    side = F.when(term["query_coordinate"] >= 0, "above zero").otherwise("below zero")
    return F.concat(axis, F.when(term["contribution"] >= 0, F.concat(F.lit(", both "), side)).otherwise(F.lit(", on opposite sides")))


def summary(terms: Column, top_n: int = 2) -> Column:
    agreeing = F.slice(F.filter(terms, lambda t: t["contribution"] >= 0), 1, top_n)
    return F.when(F.size(agreeing) > 0, F.array_join(F.transform(agreeing, phrase), "; ")).otherwise(NOTHING_SHARED)
