"""Dictionary lookup over entry, form and sense tables, and multi-word expressions found by it."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tanmono.functions.text import english_words, to_hiragana, to_katakana

#: Words of a sense's part of speech that agree with a lexeme's.
POS_HINTS = {
    "名詞": ["noun", "numeric"],
    "代名詞": ["pronoun", "noun"],
    "動詞": ["verb"],
    "形容詞": ["adjective"],
    "形状詞": ["adjectival noun", "na-adjective"],
    "副詞": ["adverb"],
    "連体詞": ["pre-noun", "prenominal"],
    "感動詞": ["interjection"],
    "表現": ["expressions", "interjection", "adverb"],
}
#: Definitions that stand above lookup: lemma, part of speech, gloss, entry, sense.
OVERRIDES = [
    ("ない", "形容詞", "not; nonexistent; without", 1529520, 3),
    ("いう", "動詞", "to say; to utter; to call", 1587040, 0),
]
#: Priority of an entry by its frequency tags, the best tag first.
PRIORITIES = [(["ichi1"], 0.9), (["spec1", "news1"], 0.65), (["ichi2", "spec2"], 0.4)]


def priority(tags: Column) -> Column:
    out = F.when(F.size(tags) > 0, 0.2).otherwise(0.0)
    for names, value in reversed(PRIORITIES):
        out = F.when(F.arrays_overlap(tags, F.array(*map(F.lit, names))), value).otherwise(out)
    return out


def _hinted(pos: Column, sense_pos: Column) -> Column:
    out = F.lit(False)
    for name, hints in POS_HINTS.items():
        found = F.lit(False)
        for hint in hints:
            found = found | F.contains(sense_pos, F.lit(hint))
        out = F.when(pos == name, found).otherwise(out)
    return F.coalesce(out, F.lit(False))


def resolve(words: DataFrame, entries: DataFrame, forms: DataFrame, senses: DataFrame) -> DataFrame:
    """(id, gloss, entry_id, sense_index, confidence): the best sense of every word(id, lemma, reading, pos, context).

    entries(entry_id, tags, kana_usual), forms(entry_id, kind, text) with kind 'kanji' or 'kana', senses(entry_id, sense_index, pos,
    kana_usual, glosses). A word meets an entry by one equi-join on any of its forms, by lemma or hiragana reading; then
    form, reading, priority, part of speech, context overlap and sense order make the score. Ties go to the smaller entry and sense.
    """
    words = words.select("id", "lemma", to_hiragana("reading").alias("kana"), "pos", english_words(F.coalesce("context", F.lit(""))).alias("context"))
    fixed = F.lit(None).cast("struct<gloss:string,entry_id:bigint,sense_index:int>")
    for lemma, pos, gloss, entry, sense in OVERRIDES:
        value = F.struct(F.lit(gloss).alias("gloss"), F.lit(entry).cast("bigint").alias("entry_id"), F.lit(sense).alias("sense_index"))
        fixed = F.when((F.col("lemma") == lemma) & (F.col("pos") == pos), value).otherwise(fixed)
    words = words.withColumn("fixed", fixed)
    asked = words.filter("fixed IS NULL").select("id", "lemma", "kana", F.explode(F.array_distinct(F.array("lemma", "kana"))).alias("text"))
    met = asked.join(forms, "text").select(
        "id", "entry_id", (F.col("text") == F.col("lemma")).alias("spelt"), ((F.col("text") == F.col("kana")) & (F.col("kind") == "kana")).alias("read"),
        ((F.col("text") == F.col("lemma")) & (F.col("kind") == "kana")).alias("lemma_is_kana"),
    )
    met = met.groupBy("id", "entry_id").agg(F.max("spelt").alias("spelt"), F.max("read").alias("read"), F.max("lemma_is_kana").alias("in_kana")).filter("spelt OR read")
    rows = met.join(entries.withColumnRenamed("kana_usual", "entry_kana"), "entry_id").join(senses, "entry_id").join(words, "id")
    same_pos = _hinted(F.col("pos"), F.lower(F.col("sense_pos")))
    rows = rows.filter((F.size("glosses") > 0) & ((F.coalesce("pos", F.lit("")) != "感動詞") | same_pos))
    overlap = F.size(F.array_intersect("context", english_words(F.array_join("glosses", " "))))
    score = 2.0 * F.col("spelt").cast("int") + 1.0 * F.col("read").cast("int") + priority(F.col("tags"))
    score = score + F.when(F.col("entry_kana") & F.col("in_kana"), 0.35).otherwise(0.0) + F.when(same_pos, 0.55).otherwise(0.0)
    score = score + F.least(F.lit(0.08), overlap * 0.04) + F.when(F.col("kana_usual") & F.col("in_kana"), 0.10).otherwise(0.0) - 0.20 * F.col("sense_index")
    gloss = F.array_join(F.slice(F.array_distinct("glosses"), 1, 3), "; ")
    best = rows.withColumn("score", F.round(score, 9)).groupBy("id").agg(
        F.max_by(F.struct(gloss.alias("gloss"), "entry_id", "sense_index", "score"), F.struct("score", -F.col("entry_id"), -F.col("sense_index"))).alias("b")
    )
    found = best.select("id", "b.gloss", "b.entry_id", "b.sense_index", F.round("b.score", 3).alias("confidence"))
    return found.unionByName(words.filter("fixed IS NOT NULL").select("id", "fixed.*", F.lit(5.0).alias("confidence")))


def expression_entries(asked: DataFrame, entries: DataFrame, forms: DataFrame, senses: DataFrame) -> DataFrame:
    """(surface, reading, entry_id, senses, sense_indexes) of the best entry for each asked(surface, reading, with_particle).

    An entry needs the surface among its forms, the reading among its kana forms if one is asked and it has any, and to be an
    expression or interjection unless a particle is inside. Up to four glosses make a sense; equal senses count once.
    """
    asked = asked.withColumn("kana", to_hiragana(F.coalesce("reading", F.lit(""))))
    kana = forms.filter("kind = 'kana'").groupBy("entry_id").agg(F.array_sort(F.collect_set("text")).alias("kanas"))
    kinds = senses.groupBy("entry_id").agg(F.max(F.lower("sense_pos").contains("expressions (phrases") | F.lower("sense_pos").contains("interjection")).alias("phrase"))
    met = asked.join(forms.withColumnRenamed("text", "surface"), "surface").groupBy("surface", "reading", "kana", "with_particle", "entry_id")
    met = met.agg(F.max(F.col("kind") == "kanji").alias("spelt")).join(entries, "entry_id").join(kinds, "entry_id").join(kana, "entry_id", "left")
    fits = (F.col("kana") == "") | F.col("kanas").isNull() | F.array_contains("kanas", F.col("kana"))
    met = met.filter(fits & (F.col("phrase") | F.col("with_particle")))
    score = priority(F.col("tags")) + F.when(F.col("spelt"), 0.25).otherwise(0.0)
    best = met.groupBy("surface", "reading", "kana").agg(F.max_by(F.struct("entry_id", "kanas"), F.struct(F.round(score, 6), -F.col("entry_id"))).alias("b"))
    text = F.array_join(F.slice("glosses", 1, 4), "; ")
    described = senses.filter(F.size("glosses") > 0).select("entry_id", "sense_index", text.alias("sense"))
    described = described.groupBy("entry_id", "sense").agg(F.min("sense_index").alias("at")).groupBy("entry_id").agg(F.array_sort(F.collect_list(F.struct("at", "sense"))).alias("s"))
    rows = best.join(described, best["b.entry_id"] == described["entry_id"], "left")
    chosen = F.when(F.col("kana") != "", F.col("kana")).when(F.array_contains("b.kanas", F.col("surface")) | F.col("b.kanas").isNull(), F.col("surface")).otherwise(F.col("b.kanas")[0])
    return rows.select("surface", to_katakana(chosen).alias("reading"), "b.entry_id", F.col("s.sense").alias("senses"), F.col("s.at").alias("sense_indexes"))


def word_ngrams(rows: DataFrame, key: str, words: str, least: int = 2, most: int = 4) -> DataFrame:
    """(key, at, n, ngram): every run of least to most words, as candidates for expressions; at counts from 0."""
    sizes = F.sequence(F.lit(least), F.lit(most))
    runs = F.flatten(F.transform(sizes, lambda n: F.transform(
        F.sequence(F.lit(0), F.greatest(F.size(words) - n, F.lit(0))), lambda i: F.struct(i.alias("at"), n.alias("n"), F.array_join(F.slice(words, i + 1, n), " ").alias("ngram"))
    )))
    runs = F.filter(runs, lambda r: r["at"] + r["n"] <= F.size(words))
    return rows.select(F.col(key).alias("key"), F.explode(runs).alias("r")).select("key", "r.*")


def claimed(found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Of runs (at, n), those that a greedy reader takes: from the left, the longest first, none overlapping."""
    out, free = [], 0
    for at, n in sorted(found, key=lambda r: (r[0], -r[1])):
        if at >= free:
            out.append((at, n))
            free = at + n
    return out


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("at", T.IntegerType()), T.StructField("n", T.IntegerType())])))
def _claimed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in parts:
        yield part.map(lambda runs: [{"at": a, "n": n} for a, n in claimed([(r["at"], r["n"]) for r in runs])])


def expressions(candidates: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(key, at, n, ngram): the candidates that lexicon(ngram) holds, after greedy longest-match selection within each key."""
    known = candidates.join(lexicon.select("ngram").distinct(), "ngram", "left_semi")
    taken = known.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("at", "n"))).alias("runs"))
    taken = taken.select("key", F.explode(_claimed("runs")).alias("r")).select("key", "r.at", "r.n")
    return taken.join(known, ["key", "at", "n"])
