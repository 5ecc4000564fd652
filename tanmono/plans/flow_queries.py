"""Queries on tokens, cards and streams, with their SQL."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tanmono.functions import text as tx
from tanmono.operators import cards, ingest, model, ranking, semantics, tokens
from tanmono.plans import sql
from tanmono.plans.model_queries import _DIFFICULTY, _REIMPORTED, kept_model, reimported
from tanmono.plans.storage import materialize
from tanmono.plans.text_queries import _ANAK, SRT_CUES
from tanmono.session import table
from tanmono.sinks import reports
from tanmono.streaming import state


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = model.sentences(spark, sf_dir, "id", "japanese").filter("japanese <> ''").select("id", tx.clean_text("japanese").alias("text"))
    return tokens.default_tokens(lines, "id", "text")


def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(tokens.content_words(_tokens(spark, sf_dir)))


_TOKENS = f"""
WITH s AS (SELECT DISTINCT id, {sql.clean("japanese")} AS text FROM sentences WHERE japanese <> ''),
w AS (SELECT id AS sentence_id, regexp_extract_all(text, '{tokens.WORD}') AS words FROM s),
t AS (SELECT sentence_id, unnest(words) AS surface, generate_subscripts(words, 1) - 1 AS position FROM w),
k AS (SELECT *, lower(surface) AS lemma, translate(lower(surface), {_ANAK}) AS reading FROM t)"""
TOKEN_COUNTS = _TOKENS + r""" SELECT sentence_id, substr(sha256(concat_ws(chr(31), lemma, reading)), 1, 24) AS lexeme_key, surface, count(*) AS n
FROM k WHERE regexp_matches(surface, '[\x{3040}-\x{30ff}\x{3400}-\x{9fff}]') GROUP BY ALL"""


def derived_lexemes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.lexemes_from_tokens(_tokens(spark, sf_dir)).select("lexeme_key", "lemma", "reading", "pos", "corpus_count")


DERIVED_LEXEMES = _TOKENS + """ SELECT substr(sha256(concat_ws(chr(31), lemma, reading)), 1, 24) AS lexeme_key, lemma, reading, '名詞' AS pos, count(*) AS corpus_count
FROM k GROUP BY lemma, reading"""


def target_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a learner sees as target: the literal span for words without an ending, else the surface."""
    lines = model.sentences(spark, sf_dir, "id", "japanese").withColumnRenamed("id", "sentence_id")
    rows = model.occurrences(spark, sf_dir).join(lines, "sentence_id")
    start, end = tokens.literal_span(F.col("japanese"), F.col("surface"))
    lexical = ~F.col("surface").rlike("[ぁ-ゖ]")
    span = tokens.target_span(F.col("japanese"), F.when(lexical, start), F.when(lexical, end), start, end, F.concat("surface", F.lit("*")))
    return rows.select("lexeme_id", "sentence_id", "surface", span.alias("t")).select("lexeme_id", "sentence_id", "surface", "t.target", "t.start", "t.end")


TARGET_SPANS = f"""WITH {sql.MODEL}, t AS (SELECT lexeme_id, sentence_id, surface, CASE WHEN surface <> '' AND contains(japanese, surface) THEN instr(japanese, surface) - 1 END AS start FROM occ JOIN sen ON id = sentence_id)
SELECT lexeme_id, sentence_id, surface, CASE WHEN NOT regexp_matches(surface, '[ぁ-ゖ]') AND start IS NOT NULL THEN surface ELSE surface || '*' END AS target, CAST(start AS INTEGER) AS start, CAST(start + length(surface) AS INTEGER) AS "end" FROM t"""


def media_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    src = model.sources(spark, sf_dir).select(F.col("id").alias("source_id"), "video_path")
    rows = model.sentences(spark, sf_dir).select("id", "source_id", "start_ms", "end_ms").join(src.filter("video_path IS NOT NULL"), "source_id")
    return reports.media_names(rows).select("id", "clip", "clip_start", "clip_end", "still_at")


MEDIA_NAMES = f"""WITH {sql.MODEL}, m AS (SELECT sen.id, video_path, greatest(start_ms - 200, 0) AS s, greatest(end_ms + 200, greatest(start_ms - 200, 0) + 400) AS e, (start_ms + end_ms) // 2 AS still_at
FROM sen JOIN src ON src.id = source_id WHERE video_path IS NOT NULL)
SELECT id, substr(sha256(concat_ws('|', video_path, s, e)), 1, 20) || '.mp3' AS clip, s AS clip_start, e AS clip_end, still_at FROM m"""


def card_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored queue as the plan; defined lexemes have a card, known ones with reviews."""
    plan = table(spark, sf_dir, "source_queue").groupBy("lexeme_id").agg(F.min("example_sentence_id").alias("sentence_id"))
    lex = model.lexemes(spark, sf_dir).filter("dictionary_status = 'matched'")
    held = lex.select(F.col("id").alias("lexeme_id"), (F.col("id") * 10).alias("card_id"), F.lit(0).cast("bigint").alias("reps"))
    pulled = lex.filter("known_at IS NOT NULL").select((F.col("id") * 10).alias("card_id"), F.lit(3).cast("bigint").alias("reps"))
    return cards.actions(plan, cards.learned(held, pulled))


CARD_ACTIONS = f"""WITH {sql.MODEL}, p AS (SELECT lexeme_id, min(example_sentence_id) AS sentence_id FROM source_queue GROUP BY 1)
SELECT lexeme_id, sentence_id, CASE WHEN lexeme_id IN (SELECT id FROM lex WHERE dictionary_status = 'matched') THEN 'move' ELSE 'add' END AS action FROM p
WHERE lexeme_id NOT IN (SELECT id FROM lex WHERE dictionary_status = 'matched' AND known_at IS NOT NULL)"""


def clean_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 40 of every source's queue through the quality gate until 20 are accepted.

    A sentence without translation or with fragments in it is a fault, of a card as of an alternative.
    """
    occ, sen, lex = kept_model(spark, sf_dir)
    ranked = ranking.ranked(ranking.candidates(occ, sen, lex), ["hybrid"], 40)
    queue = materialize(ranked.select("source_id", "rank", "lexeme_id", "sentence_id", "difficulty"), "queue")
    words = occ.select("sentence_id", "lexeme_id").distinct().join(lex.select(F.col("id").alias("lexeme_id"), F.col("known_at").isNull().alias("open")), "lexeme_id")
    words = words.groupBy("sentence_id").agg(F.array_sort(F.collect_list("lexeme_id")).alias("words"), F.collect_list(F.when(F.col("open"), F.col("lexeme_id"))).alias("open"))
    findings = F.array_compact(F.array(
        F.when(F.coalesce(F.col("english") == "", F.lit(True)), F.lit("missing_translation")), F.when(ranking.contains_any("japanese", ranking.FRAGMENT_MARKS), F.lit("fragment")),
    ))
    lines = sen.select(F.col("id").alias("sentence_id"), "source_id", "cue_index", F.char_length("japanese").alias("length"), findings.alias("findings"))
    examples = occ.join(queue.select("lexeme_id").distinct(), "lexeme_id", "left_semi").select("lexeme_id", "sentence_id").distinct()
    examples = examples.join(lines, "sentence_id").join(queue.select("source_id", "lexeme_id"), ["source_id", "lexeme_id"]).join(words, "sentence_id")
    needs = F.filter("open", lambda x: x != F.col("lexeme_id"))
    # An alternative may need only words of the same queue, of which a source has 40.
    taught = queue.groupBy("source_id").agg(F.collect_set("lexeme_id").alias("taught"))
    examples = examples.withColumn("needs", needs).join(taught, "source_id").filter("size(findings) = 0 AND size(array_except(needs, taught)) = 0")
    # At most 20 sentences are shown when an alternative is looked for, and one is the card's own.
    alternatives = cards.first_alternatives(examples, 20).groupBy("source_id", "lexeme_id").agg(
        F.array_sort(F.collect_list(F.struct("length", "cue_index", "sentence_id", "needs", "findings"))).alias("alternatives")
    )
    rows = queue.join(lines.select("sentence_id", "source_id", "findings"), ["source_id", "sentence_id"]).join(words, "sentence_id")
    rows = rows.join(alternatives, ["source_id", "lexeme_id"], "left").select(
        F.col("source_id").alias("plan"), F.col("rank").alias("position"), "lexeme_id", "sentence_id", "difficulty", "findings", "words",
        F.coalesce("alternatives", F.array()).alias("alternatives"),
    )
    return cards.select_clean(rows, 20)


_FRAGMENT = sql.any_of("japanese", ranking.FRAGMENT_MARKS)
#: One card of every plan a step: accepted words, shown sentences and refused words are carried along.
CLEAN_SELECTION = _DIFFICULTY.replace("\nWITH ", "\nWITH RECURSIVE ", 1) + f""",
queue AS (SELECT source_id, rank, lexeme_id, sentence_id, difficulty FROM ranked WHERE metric = 'hybrid' AND rank <= 40),
wds AS (SELECT sentence_id, list(lexeme_id) AS words, list(lexeme_id) FILTER (known_at IS NULL) AS open FROM (SELECT DISTINCT sentence_id, lexeme_id FROM occ) JOIN lex ON id = lexeme_id GROUP BY 1),
lns AS (SELECT id AS sentence_id, source_id, cue_index, length(japanese) AS l,
        list_filter([CASE WHEN coalesce(english, '') = '' THEN 'missing_translation' END, CASE WHEN {_FRAGMENT} THEN 'fragment' END], lambda x: x IS NOT NULL) AS findings FROM sen),
alt AS (SELECT source_id, lexeme_id, list({{'s': sentence_id, 'n': list_filter(coalesce(open, []), lambda x: x <> lexeme_id)}} ORDER BY l, cue_index, sentence_id) AS alts
        FROM (SELECT DISTINCT lexeme_id, sentence_id FROM occ) JOIN lns USING (sentence_id) JOIN wds USING (sentence_id) JOIN (SELECT source_id, lexeme_id FROM queue) USING (source_id, lexeme_id)
        WHERE len(findings) = 0 GROUP BY 1, 2),
card AS (SELECT q.*, findings, words, coalesce(alts, []) AS alts FROM queue q JOIN lns USING (source_id, sentence_id) JOIN wds USING (sentence_id) LEFT JOIN alt USING (source_id, lexeme_id)),
walk AS (
  SELECT DISTINCT source_id, 0 AS rank, 0 AS n, []::BIGINT[] AS taught, []::BIGINT[] AS shown, []::STRUCT(w BIGINT, d DOUBLE)[] AS refused,
         NULL::BIGINT AS lexeme_id, NULL::BIGINT AS sentence_id, NULL::BIGINT AS replaced, '' AS reasons FROM card
  UNION ALL
  SELECT source_id, rank, n + CAST(ok AS INTEGER), CASE WHEN ok THEN list_append(taught, lexeme_id) ELSE taught END,
         CASE WHEN ok THEN list_append(shown, CASE WHEN bad THEN other ELSE sentence_id END) ELSE shown END,
         CASE WHEN ok THEN refused ELSE list_append(refused, {{'w': lexeme_id, 'd': difficulty}}) END,
         lexeme_id, CASE WHEN bad AND ok THEN other ELSE sentence_id END, CASE WHEN bad AND ok THEN sentence_id END, CASE WHEN ok THEN '' ELSE faults END
  FROM (SELECT *, faults <> '' AS bad, faults = '' OR other IS NOT NULL AS ok FROM (
    SELECT c.*, w.n, w.taught, w.shown, w.refused,
           array_to_string(list_sort(list_concat(c.findings, CASE WHEN len(list_filter(w.refused, lambda r: list_contains(c.words, r.w) AND r.d > c.difficulty + 2.0::DOUBLE)) > 0
             THEN ['rejected_word_became_harder_context'] ELSE [] END)), ',') AS faults,
           list_filter(c.alts, lambda a: a.s <> c.sentence_id AND NOT list_contains(w.shown, a.s) AND list_has_all(w.taught, a.n))[1].s AS other
    FROM walk w JOIN card c ON c.source_id = w.source_id AND c.rank = w.rank + 1 WHERE w.n < 20)))
SELECT source_id AS plan, lexeme_id, sentence_id, CASE WHEN reasons = '' THEN CAST(n AS INTEGER) END AS clean_position, replaced, reasons FROM walk WHERE rank > 0"""


def _reingested(spark: SparkSession, sf_dir: str) -> tuple[ingest.Tables, ingest.Tables]:
    """The model before and after those sources that came in more than once are ingested anew, from their lines with a translation."""
    occ, sen, lex = model.occurrences(spark, sf_dir), model.sentences(spark, sf_dir, *_SENTENCE), model.lexemes(spark, sf_dir)
    held = lex.filter("dictionary_status = 'matched'").select(F.col("id").alias("lexeme_id"), F.lit(None).cast("bigint").alias("sentence_id"))
    planned = table(spark, sf_dir, "source_queue").select(F.col("source_id").alias("batch_id"), F.col("example_sentence_id").alias("sentence_id"))
    before = ingest.Tables(sen, occ, lex, held, planned)
    lines = sen.join(reimported(spark, sf_dir), "source_id", "left_semi").filter("english <> '' AND japanese <> ''")
    cue = ["source_id", "cue_index", "start_ms", "end_ms"]
    fresh = ingest.fresh_sentences(lines.select(*cue, F.col("japanese").alias("text")), lines.select(*cue, F.col("english").alias("text")))
    return before, ingest.ingested(before, fresh, lambda rows, key, text: tokens.content_words(tokens.default_tokens(rows, key, text)))


_SENTENCE = ("id", "source_id", "cue_index", "start_ms", "end_ms", "japanese", "english")


def reingested_lexemes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every lexeme's count after the re-import, and before, null for new ones; those that nothing holds any more are gone."""
    before, after = _reingested(spark, sf_dir)
    old = model.corpus_counts(before.occurrences, before.lexemes).select("id", F.col("counted").alias("before"))
    return after.lexemes.select("id", "lexeme_key", "corpus_count").join(old, "id", "left").select("lexeme_key", "corpus_count", "before")


_INGESTED = f"""
WITH {sql.MODEL}, {_REIMPORTED},
f AS (SELECT DISTINCT id, source_id, cue_index, start_ms, japanese FROM sen SEMI JOIN again USING (source_id) WHERE english <> '' AND japanese <> ''),
gone AS (SELECT id FROM sen WHERE source_id IN (SELECT source_id FROM f)),
t AS (SELECT source_id, cue_index, start_ms, unnest(regexp_extract_all(japanese, '{tokens.WORD}')) AS surface FROM f),
fresh AS (SELECT substr(sha256(concat_ws(chr(31), lower(surface), translate(lower(surface), {_ANAK}))), 1, 24) AS key, * FROM t WHERE regexp_matches(surface, '[\\x{{3040}}-\\x{{30ff}}\\x{{3400}}-\\x{{9fff}}]')),
kept AS (SELECT lexeme_id, sentence_id, surface, n FROM occ WHERE sentence_id NOT IN (SELECT id FROM gone))"""
REINGESTED_LEXEMES = _INGESTED + """,
c AS (SELECT lexeme_id, sum(n) AS n FROM kept GROUP BY 1), d AS (SELECT key, count(*) AS n FROM fresh GROUP BY 1), b AS (SELECT lexeme_id, sum(n) AS n FROM occ GROUP BY 1)
SELECT coalesce(lexeme_key, key) AS lexeme_key, CAST(coalesce(c.n, 0) + coalesce(d.n, 0) AS BIGINT) AS corpus_count, CASE WHEN lex.id IS NOT NULL THEN CAST(coalesce(b.n, 0) AS BIGINT) END AS before
FROM lex FULL JOIN d ON key = lexeme_key LEFT JOIN c ON c.lexeme_id = lex.id LEFT JOIN b ON b.lexeme_id = lex.id
WHERE coalesce(c.n, 0) + coalesce(d.n, 0) > 0 OR known_at IS NOT NULL OR dictionary_status = 'matched'"""


def reingested_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences and occurrences of every source after the re-import, and whether its queue still stands as a plan."""
    after = _reingested(spark, sf_dir)[1]
    lines = after.sentences.select(F.col("id").alias("sentence_id"), "source_id")
    words = after.occurrences.join(lines, "sentence_id").groupBy("source_id").agg(F.sum("n").alias("n_words"))
    plans = after.planned.select(F.col("batch_id").alias("source_id"), F.lit(True).alias("planned")).distinct()
    rows = lines.groupBy("source_id").agg(F.count("*").alias("n_sentences")).join(words, "source_id", "left").join(plans, "source_id", "left")
    return rows.fillna(0, ["n_words"]).fillna(False, ["planned"])


REINGESTED_SOURCES = _INGESTED + """,
s AS (SELECT id, source_id FROM sen WHERE id NOT IN (SELECT id FROM gone) UNION ALL SELECT id, source_id FROM f),
w AS (SELECT source_id, sum(n) AS n FROM kept JOIN sen ON id = sentence_id GROUP BY 1 UNION ALL SELECT source_id, count(*) FROM fresh GROUP BY 1),
hit AS (SELECT DISTINCT source_id FROM source_queue WHERE example_sentence_id IN (SELECT id FROM gone))
SELECT source_id, count(*) AS n_sentences, CAST(coalesce((SELECT sum(n) FROM w WHERE w.source_id = s.source_id), 0) AS BIGINT) AS n_words,
       source_id IN (SELECT source_id FROM source_queue) AND source_id NOT IN (SELECT source_id FROM hit) AS planned FROM s GROUP BY source_id"""


def _shape(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """An encoder for tests of the cache: a text's length and its blanks."""
    for part in parts:
        yield part.map(lambda t: [float(len(t)), float(t.count(" "))])


def cached_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cache after all translations were asked for, with those of aligned lines in it before."""
    lines = model.sentences(spark, sf_dir, "id", "japanese", "english").filter("english <> ''")
    texts = lines.select(F.lit("encoder").alias("model"), F.lit("query").alias("role"), F.col("english").alias("text"))
    have = texts.join(lines.filter("japanese <> ''").select(F.col("english").alias("text")).distinct(), "text", "left_semi").distinct()
    vector = F.array(F.lit(-1.0), F.lit(-1.0)).cast("array<float>").alias("vector")
    cache = have.select("model", "role", F.sha2("text", 256).alias("text_hash"), vector)
    return semantics.cached_vectors(texts, cache, _shape)[1].select("text_hash", F.col("vector")[0].cast("int").alias("length"), F.col("vector")[1].cast("int").alias("blanks"))


CACHED_VECTORS = """WITH a AS (SELECT DISTINCT english FROM sentences WHERE japanese <> '' AND english <> '')
SELECT sha256(english) AS text_hash, -1 AS length, -1 AS blanks FROM a
UNION ALL SELECT DISTINCT sha256(english), CAST(length(english) AS INTEGER), CAST(length(english) - length(replace(english, ' ', '')) AS INTEGER) FROM sentences WHERE english <> '' AND english NOT IN (FROM a)"""


def stream_first_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    rows = state.stream(spark, f"{sf_dir}/event[s].parquet", schema).filter("event_type = 'purchase'")
    return state.first_events(rows, "user_id", "ts").withColumnRenamed("key", "user_id")


STREAM_FIRST_KNOWN = "SELECT user_id, min(ts) AS first_at FROM events WHERE event_type = 'purchase' AND user_id IS NOT NULL AND ts IS NOT NULL GROUP BY 1"


def stream_event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = state.stream(spark, f"{sf_dir}/event[s].parquet", table(spark, sf_dir, "events").schema)
    counts = state.window_counts(rows, "event_type", "ts")
    return counts.select(F.col("kind").alias("event_type"), F.unix_timestamp("start").alias("start_s"), "n")


STREAM_EVENT_WINDOWS = """SELECT event_type, CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS start_s, count(*) AS n FROM events GROUP BY 1, 2"""


def stream_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subtitle documents ingested as a stream."""
    pattern = f"{sf_dir}/document[s].parquet"
    docs = state.stream(spark, pattern, table(spark, sf_dir, "documents").schema).filter("kind = 'srt'")
    return state.ingested_cues(docs, "doc_id", "text").groupBy(F.col("key").alias("doc_id")).agg(F.count("*").alias("n_cues"), F.sum("start").alias("starts"))


STREAM_CUES = f'SELECT doc_id, count(*) AS n_cues, CAST(sum(start) AS BIGINT) AS starts FROM ({SRT_CUES}) GROUP BY 1'

QUERIES = {
    "token_counts": (token_counts, TOKEN_COUNTS),
    "derived_lexemes": (derived_lexemes, DERIVED_LEXEMES),
    "target_spans": (target_spans, TARGET_SPANS),
    "media_names": (media_names, MEDIA_NAMES),
    "card_actions": (card_actions, CARD_ACTIONS),
    "clean_selection": (clean_selection, CLEAN_SELECTION),
    "reingested_lexemes": (reingested_lexemes, REINGESTED_LEXEMES),
    "reingested_sources": (reingested_sources, REINGESTED_SOURCES),
    "cached_vectors": (cached_vectors, CACHED_VECTORS),
    "stream_first_known": (stream_first_known, STREAM_FIRST_KNOWN),
    "stream_event_windows": (stream_event_windows, STREAM_EVENT_WINDOWS),
    "stream_cues": (stream_cues, STREAM_CUES),
}
