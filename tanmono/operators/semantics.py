"""Similarity of vectors, decisions between phrase and words, and votes on readings."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tanmono.functions.text import to_katakana
from tanmono.plans.storage import materialize

#: Queries whose vectors go to every task at a time; more are done in rounds.
QUERIES_AT_ONCE = 20_000


def dot(a: Column, b: Column) -> Column:
    """Cosine of unit vectors, added up in double precision."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def nearest(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """(query, id, score, rank): the k most similar rows(id, vector) of each query(id, vector), itself aside.

    A stated query set against all rows, in blocks: the queries' matrix goes to the tasks in rounds of bounded size, each task keeps k
    rows a query for each of its batches, and a last window ranks those. Smaller ids win ties.
    """
    asked = queries.select("id", "vector").filter("id IS NOT NULL AND vector IS NOT NULL")
    n = asked.count()
    out = None
    rounds = max(1, -(-n // QUERIES_AT_ONCE))
    for r in range(rounds):
        block = asked.filter(F.pmod(F.xxhash64("id"), F.lit(rounds)) == r).toPandas()
        ids = block["id"].to_numpy(np.int64)
        matrix = np.array(block["vector"].tolist(), np.float64).reshape(len(ids), -1)

        def best(parts: Iterator[pd.DataFrame], ids: np.ndarray = ids, matrix: np.ndarray = matrix) -> Iterator[pd.DataFrame]:
            for part in parts:
                found = []
                if len(part) and len(ids):
                    have = part["id"].to_numpy(np.int64)
                    scores = np.round(matrix @ np.array(part["vector"].tolist(), np.float64).T, 9)
                    scores[ids[:, None] == have[None, :]] = -np.inf
                    for q in range(len(ids)):
                        top = np.lexsort((have, -scores[q]))[:k]
                        found += [(ids[q], have[i], scores[q, i]) for i in top if scores[q, i] > -np.inf]
                yield pd.DataFrame(found, columns=["query", "id", "score"])

        part = rows.select("id", "vector").filter("id IS NOT NULL AND vector IS NOT NULL").mapInPandas(best, "query long, id long, score double")
        out = part if out is None else out.unionByName(part)
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), "id")
    return out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def decide(phrase: Column, component: Column, likeness: Column, n_components: Column, standalone: Column, with_particle: Column) -> Column:
    """struct(decision, margin, opacity): is a phrase an expression of its own, or the sum of its words?

    phrase and component are the similarities of the translation to the best phrase sense and to the words' glosses; null means that
    there is nothing to compare. likeness is that of the phrase sense to the glosses.
    """
    margin, opacity = phrase - component, F.when(n_components > 1, 1.0 - likeness).otherwise(1.0)
    least_margin = F.when((n_components > 1) & standalone, 0.02).otherwise(0.04)
    least_opacity = F.when(with_particle, 0.14).otherwise(0.16)
    lacking = phrase.isNull() | component.isNull() | (n_components < 1)
    accepted = (phrase >= 0.82) & (margin >= least_margin) & (opacity >= least_opacity)
    decision = F.when(lacking, "insufficient_evidence").when(accepted, "expression").when(component > phrase, "components").otherwise("ambiguous")
    zero = lambda x: F.when(lacking, 0.0).otherwise(F.round(x, 6))
    return F.struct(decision.alias("decision"), zero(margin).alias("margin"), zero(opacity).alias("opacity"))


def cache_misses(texts: DataFrame, cache: DataFrame) -> DataFrame:
    """Distinct (model, role, text, text_hash) of texts(model, role, text) whose vector the cache(model, role, text_hash) lacks."""
    keyed = texts.filter("text IS NOT NULL").distinct().withColumn("text_hash", F.sha2("text", 256))
    return keyed.join(cache.select("model", "role", "text_hash"), ["model", "role", "text_hash"], "left_anti")


def cached_vectors(texts: DataFrame, cache: DataFrame, encode: Callable[[Iterator[pd.Series]], Iterator[pd.Series]]) -> tuple[DataFrame, DataFrame]:
    """(model, role, text, vector) of texts, and the cache(model, role, text_hash, vector) with what it lacked.

    encode turns batches of texts into lists of floats; only distinct texts that the cache lacks reach it, and they are kept as
    a table, so that no later read encodes them again.
    """

    @F.pandas_udf("array<float>")
    def vectors(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from encode(parts)

    missing = materialize(cache_misses(texts, cache).withColumn("vector", vectors("text")), "vectors")
    grown = cache.unionByName(missing.select(cache.columns))
    keyed = texts.filter("text IS NOT NULL").withColumn("text_hash", F.sha2("text", 256))
    return keyed.join(grown, ["model", "role", "text_hash"]).select("model", "role", "text", "vector"), grown


def reading_consensus(expected: Column, votes: Column, has_span: Column) -> Column:
    """agreement, disagreement or unresolved, from an array of readings in katakana, null where a reader has none.

    Two equal votes for another reading are a disagreement; otherwise one vote for the expected reading is an agreement.
    """
    wanted = to_katakana(expected)
    given = F.filter(votes, lambda v: v.isNotNull() & (v != ""))
    others = F.filter(given, lambda v: v != wanted)
    twice = F.size(others) > F.size(F.array_distinct(others))
    agree = F.exists(given, lambda v: v == wanted)
    unasked = ~F.coalesce(has_span, F.lit(False)) | F.coalesce(wanted == "", F.lit(True))
    return F.when(unasked, "unresolved").when(twice, "disagreement").when(agree, "agreement").otherwise("unresolved")
