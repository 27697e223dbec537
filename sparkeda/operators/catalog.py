"""Dataset search over a catalog table.

A catalog is ``(title, description, url, source, type, stars)``; sources may add columns
of their own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkeda.functions.kinds import round_to

# Texts for a hit without a title or description, and the cuts of the listing.
NO_DESCRIPTION = "No description"
DESCRIPTION_CHARS = 200
RANKED_TO = 15


def _has(query: Column) -> Column:
    return F.contains(F.lower("title"), F.lower(query)) | F.contains(
        F.lower(F.coalesce("description", F.lit(""))), F.lower(query))


def keyword_filter(catalog: DataFrame, query: str) -> DataFrame:
    """Entries whose title or description holds the query, ignoring case."""
    return catalog.where(_has(F.lit(query)))


def _short() -> Column:
    text = F.col("description")
    return F.when(text.isNull() | (text == ""), NO_DESCRIPTION).otherwise(
        F.concat(F.substring(text, 1, DESCRIPTION_CHARS), F.lit("...")))


def search_source(catalog: DataFrame, source: str, query: str, most: int = 20) -> DataFrame:
    """Best hits of one source by stars, descriptions shortened; only ``most`` rows per task move."""
    return (
        keyword_filter(catalog.where(F.col("source") == source), query)
        .orderBy(F.desc_nulls_last("stars"), "title", "url").limit(most)
        .withColumn("description", _short())
    )


def normal_query(label: Column) -> Column:
    """A category label as a query: lower case, without the ampersand."""
    return F.replace(F.replace(F.lower(label), F.lit(" & "), F.lit(" ")), F.lit("&"), F.lit(""))


def expand_query(queries: DataFrame, terms: DataFrame, most: int | None = None, run: int | None = None) -> DataFrame:
    """``(query, position, term, runs)``: the query itself, then its related terms, best first.

    ``queries`` is ``(query)``; ``terms`` is ``(term, related, weight)``. ``most`` keeps that many terms a query (a per-task cut
    comes first) and ``run`` marks that many positions to be searched; by default all are kept and all run.
    """
    asked = queries.select(normal_query(F.col("query")).alias("query")).distinct()
    best = W.partitionBy("query").orderBy(F.desc("weight"), "related")
    related = (
        asked.join(terms.withColumn("query", F.lower("term")).select("query", "related", "weight"), "query")
        .where(F.lower("related") != F.col("query"))
        .withColumn("position", F.row_number().over(best).cast("long"))
    )
    if most is not None:
        related = related.where(F.col("position") <= most)
    related = related.select("query", "position", F.col("related").alias("term"))
    runs = F.lit(True) if run is None else F.col("position") < run
    return asked.select("query", F.lit(0).cast("long").alias("position"), F.col("query").alias("term")).unionByName(
        related).withColumn("runs", runs)


def search_all(
    catalog: DataFrame, queries: Sequence[str], per_source: int = 10, list_sources: Sequence[str] = ()
) -> DataFrame:
    """Hits of every source: ``per_source // 2`` for each query, repeats kept.

    ``per_source`` is the page size of a source. ``list_sources`` are searched with the first query only and are not cut; as
    nothing ranks their hits, these have no position. Adds ``position`` within the source and the 0-based
    ``query_no``.
    """
    runs = list(queries)
    matched = F.filter(
        F.array(*[F.when(_has(F.lit(q)), F.lit(i).cast("long")) for i, q in enumerate(runs)]), lambda i: i.isNotNull())
    shown = [_short().alias(c) if c == "description" else F.col(c) for c in catalog.columns]
    hits = catalog.select(*shown, F.explode(matched).alias("query_no"))    # long texts stop here
    listed = F.col("source").isin(list(list_sources))
    order = [F.desc_nulls_last("stars"), F.asc("title"), F.asc("url")]
    each = W.partitionBy("source", "query_no").orderBy(*order)
    capped = (
        hits.where(~listed).withColumn("rank", F.row_number().over(each)).where(F.col("rank") <= per_source // 2)
        .withColumn("position", F.row_number().over(W.partitionBy("source").orderBy("query_no", "rank")).cast("long"))
        .drop("rank")
    )
    if not list_sources:
        return capped
    whole = hits.where(listed & (F.col("query_no") == 0)).withColumn("position", F.lit(None).cast("long"))
    return capped.unionByName(whole)


def _relevance(query: str) -> Column:
    """Two per query word in the title, one per word in the description, log10(1 + stars) / 10, and a half
    for having a description."""
    words = [w for w in query.lower().split() if w]
    score = F.lit(0.0)
    for w in words:
        score = score + F.when(F.contains(F.lower("title"), F.lit(w)), 2.0).otherwise(0.0)
        score = score + F.when(F.contains(F.lower("description"), F.lit(w)), 1.0).otherwise(0.0)
    stars = F.greatest(F.coalesce(F.col("stars"), F.lit(0)), F.lit(0)).cast("double")
    told = F.when(F.col("description") != NO_DESCRIPTION, 0.5).otherwise(0.0)
    return round_to(score + F.log10(stars + 1.0) / 10 + told, 4)


def rank_results(hits: DataFrame, query: str, most: int = RANKED_TO) -> DataFrame:
    """The ``most`` most relevant of all hits, with ``score`` and ``rank``; only that many rows per task move."""
    order = [F.desc("score"), F.asc("source"), F.asc("position"), F.asc("title"), F.asc("url")]
    best = hits.withColumn("score", _relevance(query)).orderBy(*order).limit(most)
    return best.withColumn("rank", F.row_number().over(W.orderBy(*order)).cast("long"))


def source_counts(hits: DataFrame, sources: DataFrame) -> DataFrame:
    """``(source, hits)`` for every listed source, zeros shown, and the total."""
    found = hits.groupBy("source").agg(F.count("*").alias("hits"))
    per = sources.select("source").distinct().join(found, "source", "left").select(
        "source", F.coalesce("hits", F.lit(0)).cast("long").alias("hits"))
    total = hits.agg(F.count("*").alias("hits")).select(F.lit("TOTAL").alias("source"), "hits")
    return per.unionByName(total)
