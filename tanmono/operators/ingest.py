"""From cues to the model in one call: sentences with translations, words, occurrences, counts, and what a re-import invalidates."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tanmono.functions.text import lexeme_key
from tanmono.operators import model
from tanmono.operators.cues import aligned_by_time
from tanmono.plans.storage import materialize

_POSITIVE = 2**63 - 1


@dataclass
class Tables:
    """The tables of the model: sentences(id, source_id, cue_index, start_ms, end_ms, japanese, english), occurrences(lexeme_id, sentence_id,
    surface, n), lexemes(id, lexeme_key, lemma, reading, part_of_speech, corpus_count, known_at, ...), cards(lexeme_id, sentence_id, ...) and
    planned(batch_id, sentence_id), the sentences of named plans."""

    sentences: DataFrame
    occurrences: DataFrame
    lexemes: DataFrame
    cards: DataFrame
    planned: DataFrame


def fresh_sentences(japanese: DataFrame, english: DataFrame) -> DataFrame:
    """Sentences of cues (source_id, cue_index, start_ms, end_ms, text) with the translations that overlap them in time.

    An id comes from source and cue, so a re-import gives the same cue the same id.
    """
    sentence = F.xxhash64("source_id", "cue_index", "start_ms").bitwiseAND(F.lit(_POSITIVE)).alias("id")
    rows = japanese.select(sentence, "source_id", "cue_index", "start_ms", "end_ms", F.col("text").alias("japanese"))
    timed = [F.col("start_ms").alias("start"), F.col("end_ms").alias("end")]
    cues = rows.select("id", F.col("source_id").alias("source"), *timed)
    lines = english.select(F.xxhash64("source_id", "cue_index", "start_ms").alias("id"), F.col("source_id").alias("source"), *timed, "text")
    met = aligned_by_time(cues, lines).select("id", F.col("translation").alias("english"))
    return rows.join(met, "id", "left").withColumn("english", F.coalesce("english", F.lit("")))


def ingested(stored: Tables, sentences: DataFrame, tokens: Callable[[DataFrame, str, str], DataFrame]) -> Tables:
    """stored after its sources in sentences were replaced by them.

    tokens(lines, key, text) gives the words to learn, (sentence_id, position, surface, lemma, reading, pos). Occurrences of the replaced
    sentences go, plans that show one of them go as a whole, every count is taken anew from the occurrences that there are now, and
    lexemes that no longer occur go unless they are known or have a card. New lexemes get an id from their key.
    """
    fresh = materialize(sentences, "fresh")
    columns = [c for c in stored.sentences.columns if c in fresh.columns]
    gone = materialize(stored.sentences.join(fresh.select("source_id").distinct(), "source_id", "left_semi").select(F.col("id").alias("sentence_id")), "gone")
    words = tokens(fresh.select("id", "japanese"), "id", "japanese").withColumn("lexeme_key", lexeme_key("lemma", "reading"))
    words = materialize(words.select("sentence_id", "position", "surface", "lemma", "reading", "pos", "lexeme_key"), "words")
    firsts = words.groupBy("lexeme_key").agg(F.min_by(F.struct("lemma", "reading", F.col("pos").alias("part_of_speech")), F.struct("sentence_id", "position")).alias("w"))
    added = firsts.join(stored.lexemes.select("lexeme_key"), "lexeme_key", "left_anti").select(
        F.conv(F.substring("lexeme_key", 1, 15), 16, 10).cast("bigint").alias("id"), "lexeme_key", "w.lemma", "w.reading", "w.part_of_speech"
    )
    lexemes = materialize(stored.lexemes.drop("corpus_count").unionByName(added, allowMissingColumns=True), "lexemes")
    counted = words.groupBy("lexeme_key", "sentence_id", "surface").agg(F.count("*").alias("n")).join(lexemes.select(F.col("id").alias("lexeme_id"), "lexeme_key"), "lexeme_key")
    kept = stored.occurrences.join(gone, "sentence_id", "left_anti").select("lexeme_id", "sentence_id", "surface", "n")
    occurrences = materialize(kept.unionByName(counted.select(kept.columns)), "occurrences")
    totals = occurrences.groupBy(F.col("lexeme_id").alias("id")).agg(F.sum("n").alias("corpus_count"))
    tracked = stored.cards.select(F.col("lexeme_id").alias("id"), F.lit(True).alias("_tracked")).distinct()
    lexemes = lexemes.join(totals, "id", "left").join(tracked, "id", "left").withColumn("corpus_count", F.coalesce("corpus_count", F.lit(0)))
    lexemes = lexemes.filter("corpus_count > 0 OR known_at IS NOT NULL OR _tracked").drop("_tracked")
    lines = model.replaced(stored.sentences.select(columns), fresh.select(columns), "source_id")
    hit = stored.planned.join(gone, "sentence_id", "left_semi").select("batch_id").distinct()
    cards = model.cleared_references(stored.cards, "sentence_id", lines, "id")
    return Tables(lines, occurrences, lexemes, cards, stored.planned.join(hit, "batch_id", "left_anti"))


def totals(tables: Tables, fresh: DataFrame) -> tuple[int, int]:
    """Sentences and occurrences that fresh(id) brought."""
    rows = tables.occurrences.join(fresh.select(F.col("id").alias("sentence_id")), "sentence_id", "left_semi")
    return fresh.count(), rows.agg(F.sum("n")).first()[0] or 0
