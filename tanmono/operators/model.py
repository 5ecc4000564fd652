"""The canonical model: sources, sentences, lexemes and occurrences, each row once, and what is counted on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tanmono.session import table


def upserted(df: DataFrame, keys: list[str], version: list[Column], keep_first: str | None = None) -> DataFrame:
    """The latest row of every key; the column keep_first keeps its earliest value. One shuffle, partial aggregation."""
    rest = [c for c in df.columns if c not in keys]
    latest = F.max_by(F.struct(*rest), F.struct(*version)).alias("_row")
    first = [F.min(keep_first).alias("_first")] if keep_first else []
    rows = df.groupBy(*keys).agg(latest, *first)
    values = [F.col("_first").alias(c) if c == keep_first else F.col(f"_row.{c}").alias(c) for c in rest]
    return rows.select(*keys, *values).select(df.columns)


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Re-imports replace title and paths and keep the first import time."""
    version = [F.col("imported_at"), F.coalesce("title", F.lit(""))]
    return upserted(table(spark, sf_dir, "sources"), ["id", "series", "season", "episode"], version, "imported_at")


def sentences(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Each sentence once; repeated rows are equal in all columns.

    With columns named, these are the keys of a hash aggregation, which suits text; without, the id is the key and the scan reads
    just what later steps use, which suits numbers.
    """
    rows = table(spark, sf_dir, "sentences")
    return rows.select(*columns).distinct() if columns else rows.dropDuplicates(["id"])


def lexemes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lexemes").dropDuplicates(["id"])


def occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "occurrences").dropDuplicates(["lexeme_id", "sentence_id", "surface"])
    return rows.select("lexeme_id", "sentence_id", "surface", F.coalesce("count", F.lit(1)).alias("n"))


def corpus_counts(occ: DataFrame, lex: DataFrame) -> DataFrame:
    """(id, stored, counted): every lexeme's stored count beside its occurrences now, 0 if there are none."""
    counts = occ.groupBy(F.col("lexeme_id").alias("id")).agg(F.sum("n").alias("counted"))
    rows = lex.select("id", F.col("corpus_count").alias("stored")).join(counts, "id", "left")
    return rows.select("id", "stored", F.coalesce("counted", F.lit(0)).alias("counted"))


def source_counts(occ: DataFrame, sen: DataFrame, lex: DataFrame) -> DataFrame:
    """(source_id, lexeme_id, source_count, base_rank): occurrences in each source; rank falls with them and rises with length."""
    rows = occ.join(sen.select(F.col("id").alias("sentence_id"), "source_id"), "sentence_id")
    counts = rows.groupBy("source_id", "lexeme_id").agg(F.sum("n").alias("source_count"))
    rank = F.try_divide(F.lit(1.0), F.col("source_count")) + F.char_length("lemma") * 0.01
    return counts.join(lex.select(F.col("id").alias("lexeme_id"), "lemma"), "lexeme_id").select("source_id", "lexeme_id", "source_count", rank.alias("base_rank"))


def shortest_examples(occ: DataFrame, sen: DataFrame) -> DataFrame:
    """(source_id, lexeme_id, example_sentence_id): the shortest sentence of the source, then the earliest.

    A minimum over structs, so that partial aggregation leaves one row of a pair for each task.
    """
    lines = sen.select(F.col("id").alias("sentence_id"), "source_id", F.char_length("japanese").alias("length"), "cue_index")
    rows = occ.select("lexeme_id", "sentence_id").join(lines, "sentence_id")
    best = rows.groupBy("source_id", "lexeme_id").agg(F.min(F.struct("length", "cue_index", "sentence_id")).alias("best"))
    return best.select("source_id", "lexeme_id", F.col("best.sentence_id").alias("example_sentence_id"))


def sentence_words(occ: DataFrame, lex: DataFrame) -> DataFrame:
    """(sentence_id, n_words, n_unknown, word_ids): distinct lexemes of each sentence, those not yet known, and their ids."""
    known = lex.select(F.col("id").alias("lexeme_id"), F.col("known_at").isNotNull().alias("known"))
    rows = occ.select("sentence_id", "lexeme_id").distinct().join(known, "lexeme_id")
    return rows.groupBy("sentence_id").agg(
        F.count("*").alias("n_words"), F.count_if(~F.col("known")).alias("n_unknown"), F.array_sort(F.collect_list("lexeme_id")).alias("word_ids")
    )


def translation_contexts(occ: DataFrame, sen: DataFrame, most: int = 5) -> DataFrame:
    """(lexeme_id, context): the first few distinct translations of a lexeme's sentences, in order.

    The window's limit is applied in every map task before the shuffle, so a frequent lexeme stays small.
    """
    lines = sen.filter("english <> ''").select(F.col("id").alias("sentence_id"), "english")
    rows = occ.select("lexeme_id", "sentence_id").join(lines, "sentence_id").select("lexeme_id", "english")
    rank = F.dense_rank().over(Window.partitionBy("lexeme_id").orderBy("english"))
    few = rows.withColumn("r", rank).filter(F.col("r") <= most).select("lexeme_id", "english").distinct()
    return few.groupBy("lexeme_id").agg(F.array_join(F.array_sort(F.collect_list("english")), " ").alias("context"))


def vocabulary_growth(src: DataFrame, sen: DataFrame, occ: DataFrame, lex: DataFrame) -> DataFrame:
    """Per series, season and episode: sentences, lexemes first met, and their running totals; episodes without any too."""
    episode = ["series", "season", "episode"]
    lines = sen.select(F.col("id").alias("sentence_id"), "source_id")
    places = src.select(F.col("id").alias("source_id"), *episode)
    sizes = places.join(lines.groupBy("source_id").agg(F.count("*").alias("n")), "source_id", "left")
    sizes = sizes.groupBy(*episode).agg(F.sum(F.coalesce("n", F.lit(0))).alias("sentences"))
    pairs = occ.select("lexeme_id", "sentence_id").join(lines, "sentence_id").select("lexeme_id", "source_id").distinct()
    first = pairs.join(places, "source_id").groupBy("series", "season", "lexeme_id").agg(F.min("episode").alias("episode"))
    glossed = lex.select(F.col("id").alias("lexeme_id"), ((F.col("dictionary_status") == "matched") & F.col("gloss").isNotNull()).alias("glossed"))
    new = first.join(glossed, "lexeme_id").groupBy(*episode).agg(F.count("*").alias("new_lexemes"), F.count_if("glossed").alias("new_glossed"))
    rows = sizes.join(new, episode, "left").fillna(0, ["new_lexemes", "new_glossed"])
    so_far = Window.partitionBy("series", "season").orderBy("episode").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumns({"all_lexemes": F.sum("new_lexemes").over(so_far), "all_glossed": F.sum("new_glossed").over(so_far)})


def corpus_stats(src: DataFrame, sen: DataFrame, lex: DataFrame) -> DataFrame:
    """(name, n): sources, sentences, lexemes and known lexemes."""
    counts = [
        src.agg(F.count("*").alias("n")).withColumn("name", F.lit("sources")),
        sen.agg(F.count("*").alias("n")).withColumn("name", F.lit("sentences")),
        lex.agg(F.count("*").alias("n")).withColumn("name", F.lit("lexemes")),
        lex.filter("known_at IS NOT NULL").agg(F.count("*").alias("n")).withColumn("name", F.lit("known")),
    ]
    out = counts[0]
    for more in counts[1:]:
        out = out.unionByName(more)
    return out.select("name", "n")


def undefined_lexemes(occ: DataFrame, sen: DataFrame, lex: DataFrame) -> DataFrame:
    """(lexeme_id, lemma, total, example_id): lexemes without a definition, with their best example.

    Best is a sentence with a translation, then the shortest, then the earliest.
    """
    lacking = lex.filter("dictionary_status = 'missing' OR gloss IS NULL").select(F.col("id").alias("lexeme_id"), "lemma")
    missing = F.coalesce(F.col("english") == "", F.lit(True)).alias("missing")
    lines = sen.select(F.col("id").alias("sentence_id"), missing, F.char_length("japanese").alias("length"), "cue_index")
    rows = occ.join(lacking, "lexeme_id").join(lines, "sentence_id")
    best = F.min(F.struct("missing", "length", "cue_index", "sentence_id")).alias("best")
    return rows.groupBy("lexeme_id", "lemma").agg(F.sum("n").alias("total"), best).select("lexeme_id", "lemma", "total", F.col("best.sentence_id").alias("example_id"))


def exclusion() -> Column:
    """Why a lexeme is never taught, as of excluded_lexemes(), null if it may be."""
    reaction = (F.coalesce("part_of_speech", F.lit("")) == "感動詞") & (F.char_length("lemma") <= 1)
    return F.when(reaction, "reaction_fragment").when((F.col("dictionary_status") == "missing") | F.col("gloss").isNull(), "missing_definition")


def excluded_lexemes(occ: DataFrame, sen: DataFrame, lex: DataFrame) -> DataFrame:
    """(source_id, lexeme_id, lexeme_key, lemma, reason, source_count, example_id, position): what is never taught, and why.

    Interjections of one character are reaction fragments, other lexemes without a definition lack it. Per source, or scope, the frequent
    ones first, then by lemma and key; the example is as of undefined_lexemes().
    """
    out = lex.select(F.col("id").alias("lexeme_id"), "lexeme_key", "lemma", exclusion().alias("reason")).filter("reason IS NOT NULL")
    missing = F.coalesce(F.col("english") == "", F.lit(True)).alias("missing")
    lines = sen.select(F.col("id").alias("sentence_id"), "source_id", missing, F.char_length("japanese").alias("length"), "cue_index")
    rows = occ.join(out, "lexeme_id").join(lines, "sentence_id")
    best = F.min(F.struct("missing", "length", "cue_index", "sentence_id")).alias("best")
    rows = rows.groupBy("source_id", "lexeme_id", "lexeme_key", "lemma", "reason").agg(F.sum("n").alias("source_count"), best)
    order = Window.partitionBy("source_id").orderBy(F.col("source_count").desc(), "lemma", "lexeme_key")
    return rows.select("source_id", "lexeme_id", "lexeme_key", "lemma", "reason", "source_count", F.col("best.sentence_id").alias("example_id"), F.row_number().over(order).alias("position"))


def stale_lexemes(lex: DataFrame, occ: DataFrame, version: int = 2, force: bool = False) -> DataFrame:
    """(id): lexemes that occur and whose dictionary match is missing or of an older version; with force, all that occur."""
    stale = lex.filter(F.lit(force) | F.col("dictionary_status").isNull() | (F.coalesce("dictionary_version", F.lit(0)) < version))
    return stale.select("id").join(occ.select(F.col("lexeme_id").alias("id")), "id", "left_semi")


def orphan_lexemes(lex: DataFrame, occ: DataFrame, tracked: DataFrame) -> DataFrame:
    """(id): lexemes without occurrences that are neither known nor tracked(lexeme_id) by a card."""
    loose = lex.filter("known_at IS NULL").select("id").join(occ.select(F.col("lexeme_id").alias("id")), "id", "left_anti")
    return loose.join(tracked.select(F.col("lexeme_id").alias("id")), "id", "left_anti")


def lexeme_labels(asked: DataFrame, lex: DataFrame) -> DataFrame:
    """asked(key, ids) with labels: 'lemma（reading）' of each id in order; absent ids drop out, repeated ones stay."""
    names = lex.select("id", F.concat("lemma", F.lit("（"), "reading", F.lit("）")).alias("label"))
    rows = asked.select("key", F.posexplode("ids").alias("pos", "id")).join(names, "id")
    lists = rows.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("pos", "label"))).alias("l"))
    return asked.join(lists, "key", "left").select("key", F.coalesce(F.col("l.label"), F.array().cast("array<string>")).alias("labels"))


def first_event(events: DataFrame, key: str, time: str) -> DataFrame:
    """(key, first_at): first write wins."""
    return events.filter(F.col(key).isNotNull() & F.col(time).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.min(time).alias("first_at"))


def replaced(stored: DataFrame, fresh: DataFrame, partition: str) -> DataFrame:
    """stored with every partition that fresh holds replaced in full; the rows of other partitions stay."""
    return stored.join(fresh.select(partition).distinct(), partition, "left_anti").unionByName(fresh)


def without_batches(batches: DataFrame, cards: DataFrame, changed: DataFrame) -> DataFrame:
    """batches(batch_id) less those with a card whose sentence_id is in changed."""
    hit = cards.join(changed.select("sentence_id"), "sentence_id", "left_semi").select("batch_id").distinct()
    return batches.join(hit, "batch_id", "left_anti")


def lexemes_from_tokens(tokens: DataFrame) -> DataFrame:
    """Tokens (sentence_id, position, surface, lemma, reading, pos) to occurrences' lexemes: one row a key.

    The part of speech is the one met first; the count is that of all tokens.
    """
    key = F.substring(F.sha2(F.concat_ws("\x1f", "lemma", "reading"), 256), 1, 24).alias("lexeme_key")
    return tokens.withColumn("lexeme_key", key).groupBy("lexeme_key", "lemma", "reading").agg(
        F.min_by("pos", F.struct("sentence_id", "position")).alias("pos"), F.count("*").alias("corpus_count")
    )


def migrated(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """df with every column (name to type) that an older version of the table lacks, as nulls."""
    return df.withColumns({name: F.lit(None).cast(kind) for name, kind in columns.items() if name not in df.columns})


def more_confident(stored: DataFrame, fresh: DataFrame, key: str, value: str, confidence: str, order: str) -> DataFrame:
    """(key, value, confidence): the stored value, unless a fresh one is surer or nothing sure is stored; the first of equals wins.

    fresh has order, the order of arrival.
    """
    old = stored.select(key, value, confidence, F.lit(None).cast("bigint").alias("o"))
    both = old.unionByName(fresh.select(key, value, confidence, F.col(order).cast("bigint").alias("o")))
    best = F.max_by(F.struct(value, confidence), F.struct(F.coalesce(confidence, F.lit(float("-inf"))), -F.coalesce("o", F.lit(-(2**62)))))
    return both.groupBy(key).agg(best.alias("b")).select(key, f"b.{value}", f"b.{confidence}")


def cleared_references(state: DataFrame, column: str, existing: DataFrame, key: str) -> DataFrame:
    """state with column set to null where it names no existing key."""
    there = existing.select(F.col(key).alias("_key")).distinct()
    rows = state.join(there, F.col(column) == F.col("_key"), "left")
    return rows.withColumn(column, F.col("_key")).select(state.columns)


def shared_examples(cards: DataFrame) -> DataFrame:
    """(sentence_id, n): sentences that more than one card has reserved; a consistent state has none."""
    return cards.filter("sentence_id IS NOT NULL").groupBy("sentence_id").agg(F.count("*").alias("n")).filter("n > 1")
