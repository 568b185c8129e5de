"""Connected components of a graph that no single machine has to hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floetrack.llm import store


def _toward_least(edges: DataFrame, larger: bool) -> DataFrame:
    """One star step: every vertex's larger (or other, smaller) neighbours are tied to its least neighbour.

    ``edges`` (u, v) with u > v. Minima are combined before the shuffle; the join back can be split
    where a vertex has very many neighbours.
    """
    both = edges.union(edges.select("v", "u")) if larger else edges
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    tied = both.join(least, "u")
    if larger:
        out = tied.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = tied.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where(F.col("u") > F.col("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every vertex in ``edges`` (a, b); component is the least id.

    Alternates large-star and small-star steps, each round written to the shared folder, until nothing
    changes; the number of rounds grows with the logarithm of the vertices.
    """
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now, before = store.materialise(now, "edges"), None
    while True:
        facts = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if facts["n"] == 0 or (facts["n"], facts["h"]) == before:
            break
        before = (facts["n"], facts["h"])
        now = store.materialise(_toward_least(_toward_least(now, True), False), "edges")
    roots = now.select(F.col("v").alias("id")).distinct()
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots.select("id", F.col("id").alias("component")))
