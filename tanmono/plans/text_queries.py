"""Queries on text functions, sources, cues and their alignment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tanmono.functions import text as tx
from tanmono.operators import cues, model
from tanmono.plans import sql
from tanmono.plans.storage import materialize
from tanmono.session import table
from tanmono.sources import subtitles


def srt_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").filter("kind = 'srt'")
    return subtitles.parse_srt(docs, "doc_id", "text").withColumnRenamed("key", "doc_id")


SRT_CUES = rf"""
WITH blocks AS (
  SELECT doc_id, generate_subscripts(parts, 1) AS block, unnest(parts) AS body FROM (
    SELECT doc_id, regexp_split_to_array({sql.strip("regexp_replace(replace(text, chr(65279), ''), chr(13) || chr(10) || '?', chr(10), 'g')")}, '\n\s*\n') AS parts
    FROM documents WHERE kind = 'srt')),
lines AS (SELECT doc_id, block, list_filter(string_split(body, chr(10)), lambda x: {sql.strip("x")} <> '') AS lines FROM blocks),
timed AS (SELECT *, list_position(list_transform(lines, lambda x: contains(x, '-->')), true) AS timing FROM lines),
parts AS (SELECT *, regexp_extract(lines[timing], '{subtitles.TIMING}', ['h','m','s','f','i','n','t','g']) AS p, {sql.strip("lines[1]")} AS head
          FROM timed WHERE timing > 0 AND regexp_matches(lines[timing], '{subtitles.TIMING}'))
SELECT doc_id, CAST(block AS INTEGER) AS block,
       CAST(CASE WHEN timing > 1 AND regexp_full_match(head, '[+-]?[0-9]{{1,9}}') THEN CAST(head AS INTEGER) ELSE block END AS INTEGER) AS cue,
       ((CAST(p.h AS BIGINT) * 60 + CAST(p.m AS BIGINT)) * 60 + CAST(p.s AS BIGINT)) * 1000 + CAST(p.f AS BIGINT) AS start,
       ((CAST(p.i AS BIGINT) * 60 + CAST(p.n AS BIGINT)) * 60 + CAST(p.t AS BIGINT)) * 1000 + CAST(p.g AS BIGINT) AS "end",
       {sql.clean("array_to_string(lines[timing + 1:], ' ')")} AS text
FROM parts WHERE {sql.clean("array_to_string(lines[timing + 1:], ' ')")} <> ''
"""


def clean_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.sentences(spark, sf_dir, "id", "japanese", "english").select("id", tx.clean_text("japanese").alias("japanese"), tx.clean_text("english").alias("english"))


CLEAN_LINES = f"SELECT DISTINCT id, {sql.clean('japanese')} AS japanese, {sql.clean('english')} AS english FROM sentences"


def lexeme_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.lexemes(spark, sf_dir).select("id", tx.lexeme_key("lemma", "reading").alias("lexeme_key"))


LEXEME_KEYS = "SELECT DISTINCT id, substr(sha256(concat_ws(chr(31), lemma, reading)), 1, 24) AS lexeme_key FROM lexemes"


def kana_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.lexemes(spark, sf_dir).select(
        "id", tx.to_hiragana("lemma").alias("hiragana"), tx.to_katakana("reading").alias("katakana"), tx.katakana_reading("lemma").alias("kana_only")
    )


_KANA = f"'{tx._KATAKANA}', '{tx._HIRAGANA}'"
_ANAK = f"'{tx._HIRAGANA}', '{tx._KATAKANA}'"
KANA_FOLD = f"""SELECT DISTINCT id, translate(lemma, {_KANA}) AS hiragana, translate(reading, {_ANAK}) AS katakana,
  regexp_replace(translate(lemma, {_ANAK}), '[^ァ-ヶー]', '', 'g') AS kana_only FROM lexemes"""


def pos_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = model.lexemes(spark, sf_dir).withColumn("label", tx.learner_pos("part_of_speech"))
    return rows.groupBy("part_of_speech", "label").agg(F.count("*").alias("n"))


POS_LABELS = "SELECT part_of_speech, CASE part_of_speech " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in tx.POS_LABELS.items()) + """
  ELSE part_of_speech END AS label, count(*) AS n FROM (SELECT DISTINCT * FROM lexemes) GROUP BY 1, 2"""


def english_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = model.sentences(spark, sf_dir, "id", "source_id", "english").select("source_id", F.explode(tx.english_words("english")).alias("word"))
    return rows.groupBy("source_id", "word").agg(F.count("*").alias("n_sentences"))


_STOP = ", ".join(f"'{w}'" for w in tx.STOPWORDS)
ENGLISH_WORDS = f"""
WITH words AS (SELECT DISTINCT id, source_id, unnest(regexp_extract_all(lower(english), '[a-z][a-z''-]+')) AS word FROM sentences)
SELECT source_id, word, count(*) AS n_sentences FROM words WHERE word NOT IN ({_STOP}) GROUP BY 1, 2"""


def source_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.concat_ws(" ", "series", tx.source_label("season", "episode")).alias("label")
    return model.sources(spark, sf_dir).select("id", label, tx.deck_name("series").alias("deck"), F.array_join(tx.note_tags("series"), " ").alias("tags"))


SOURCE_LABELS = f"""WITH {sql.MODEL} SELECT id, series || ' ' || format('S{{:02d}}E{{:02d}}', season, episode) AS label, '{tx.DECK_PARENT}::' || replace(series, '::', '-') AS deck,
  '{tx.NOTE_TAG} series::' || replace(series, ' ', '_') AS tags FROM src"""


def _targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = model.sentences(spark, sf_dir, "id", "japanese").withColumnRenamed("id", "sentence_id")
    rows = model.occurrences(spark, sf_dir).join(lines, "sentence_id")
    at = F.position(F.col("surface"), F.col("japanese")) - 1
    known = F.col("surface").rlike(r"[\x{4e00}-\x{9fff}]")  # forms in kanji have a span, the others are found by their text
    start = F.when(known & (at >= 0), at)
    return rows.select("lexeme_id", "sentence_id", "surface", "japanese", start.alias("s"), (start + F.char_length("surface")).alias("e"))


def cloze_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _targets(spark, sf_dir)
    return rows.select("lexeme_id", "sentence_id", "surface", tx.blank_target(F.col("japanese"), F.col("surface"), F.col("s"), F.col("e")).alias("cloze"))


def highlight_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _targets(spark, sf_dir)
    return rows.select("lexeme_id", "sentence_id", "surface", tx.highlight_target(F.col("japanese"), F.col("surface"), F.col("s"), F.col("e")).alias("highlighted"))


def _marked_sql(name: str, shown: str) -> str:
    by_span = f"{sql.escape('substr(japanese, 1, pos - 1)')} || {shown} || {sql.escape('substr(japanese, pos + length(surface))')}"
    return f"""
WITH {sql.MODEL}, t AS (
  SELECT lexeme_id, sentence_id, surface, japanese, instr(japanese, surface) AS pos, {sql.escape("japanese")} AS h, {sql.escape("surface")} AS w
  FROM occ JOIN sen ON sen.id = sentence_id)
SELECT lexeme_id, sentence_id, surface, CASE WHEN regexp_matches(surface, '[\\x{{4e00}}-\\x{{9fff}}]') AND pos > 0 AND surface <> '' THEN {by_span}
  WHEN w <> '' AND instr(h, w) > 0 THEN substr(h, 1, instr(h, w) - 1) || {shown} || substr(h, instr(h, w) + length(w)) ELSE h END AS {name} FROM t"""


CLOZE_TEXT = _marked_sql("cloze", """'<span class="target-blank">（　）</span>'""")
HIGHLIGHT_TEXT = _marked_sql("highlighted", """('<span class="target-answer">' || w || '</span>')""")


def _track(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    rows = model.sentences(spark, sf_dir, "id", "source_id", "cue_index", "start_ms", "end_ms", text)
    rows = rows.select("id", F.col("source_id").alias("source"), F.col("cue_index").alias("cue"), F.col("start_ms").alias("start"), F.col("end_ms").alias("end"), F.col(text).alias("text"))
    return rows.filter("text <> ''")


def merged_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cues.merge_continuations(materialize(_track(spark, sf_dir, "japanese").drop("id"), "track"))


MERGED_CUES = rf"""
WITH c AS (SELECT DISTINCT source_id AS source, cue_index AS cue, start_ms AS start, end_ms AS stop, japanese AS text FROM sentences WHERE japanese <> ''),
p AS (SELECT *, lag(text) OVER w AS before, lag(stop) OVER w AS ended FROM c WINDOW w AS (PARTITION BY source ORDER BY cue)),
b AS (SELECT *, CASE WHEN regexp_matches(before, '→{sql.BLANKS}*$') AND start - ended <= 500 THEN 0 ELSE 1 END AS new FROM p),
i AS (SELECT *, sum(new) OVER (PARTITION BY source ORDER BY cue ROWS UNBOUNDED PRECEDING) AS island FROM b)
SELECT source, min(cue) AS cue, arg_min(start, cue) AS start, arg_max(stop, cue) AS "end",
       list_reduce(list(text ORDER BY cue), lambda a, b: trim(regexp_replace(regexp_replace(a, '→+$', ''), '{sql.BLANKS}+$', '') || ' ' || b, ' ')) AS text,
       CAST(count(*) AS INTEGER) AS n_cues
FROM i GROUP BY source, island"""


def _two_tracks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The cues of sources that keep their tracks apart."""
    apart = table(spark, sf_dir, "sentences").filter("japanese = ''").select(F.col("source_id").alias("source")).distinct()
    ja, en = (_track(spark, sf_dir, c).join(apart, "source", "left_semi") for c in ("japanese", "english"))
    return materialize(ja, "track"), materialize(en, "track")


_TRACKS = """
apart AS (SELECT DISTINCT source_id FROM sentences WHERE japanese = ''),
ja AS (SELECT DISTINCT id, source_id AS source, start_ms AS start, end_ms AS stop FROM sentences SEMI JOIN apart USING (source_id) WHERE japanese <> ''),
en AS (SELECT DISTINCT id, source_id AS source, start_ms AS start, end_ms AS stop, english AS text FROM sentences SEMI JOIN apart USING (source_id) WHERE english <> ''),
g0 AS (SELECT *, lag(regexp_replace(text, '""" + sql.BLANKS + """+$', '')) OVER w AS l, lag(stop) OVER w AS ended, regexp_replace(text, '^""" + sql.BLANKS + r"""+', '') AS r
       FROM en WINDOW w AS (PARTITION BY source ORDER BY start, stop, id)),
g1 AS (SELECT *, CASE WHEN start - ended <= 150 AND (regexp_matches(l, '[,;:—\-…]$') OR (regexp_matches(r, '^\p{Ll}') AND NOT regexp_matches(l, '[.!?]["”’)]*$')))
       THEN 0 ELSE 1 END AS new FROM g0),
g2 AS (SELECT *, sum(new) OVER (PARTITION BY source ORDER BY start, stop, id ROWS UNBOUNDED PRECEDING) AS island FROM g1),
g AS (SELECT id, source, start, stop, text, first_value(id) OVER (PARTITION BY source, island ORDER BY start, stop, id) AS grp FROM g2)"""


def utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cues.translation_groups(_two_tracks(spark, sf_dir)[1].drop("cue")).select("source", "id", "grp")


UTTERANCES = f"WITH {_TRACKS} SELECT source, id, grp FROM g"


def interval_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    ja, en = _two_tracks(spark, sf_dir)
    return cues.overlaps(ja, en, "source").withColumnsRenamed({"a": "japanese_id", "b": "english_id"})


INTERVAL_OVERLAPS = f"""WITH {_TRACKS} SELECT ja.source, ja.id AS japanese_id, en.id AS english_id, least(ja.stop, en.stop) - greatest(ja.start, en.start) AS overlap
FROM ja JOIN en ON ja.source = en.source AND ja.start < en.stop AND en.start < ja.stop AND ja.start < ja.stop AND en.start < en.stop"""


def aligned_translations(spark: SparkSession, sf_dir: str) -> DataFrame:
    ja, en = _two_tracks(spark, sf_dir)
    return cues.aligned_by_time(ja.drop("cue", "text"), en.drop("cue"))


ALIGNED = f"""
WITH {_TRACKS},
spans AS (SELECT source, grp, arg_min(start, (start, stop, id)) AS gs, arg_max(stop, (start, stop, id)) AS ge, min((start, stop, id)) AS place, list(text ORDER BY start, stop, id) AS texts
          FROM g GROUP BY source, grp),
m AS (SELECT ja.id, ja.source, g.grp, ja.start AS cs, ja.stop AS ce, sum(least(ja.stop, g.stop) - greatest(ja.start, g.start)) AS o
      FROM ja JOIN g ON ja.source = g.source AND ja.start < g.stop AND g.start < ja.stop AND ja.start < ja.stop AND g.start < g.stop GROUP BY ALL),
s AS (SELECT m.*, place, texts, o / greatest(1, ge - gs) >= 0.5 OR o / greatest(1, ce - cs) >= 0.35 AS strong, abs(cs + ce - gs - ge) AS away FROM m JOIN spans USING (source, grp)),
r AS (SELECT *, bool_or(strong) OVER (PARTITION BY id) AS has, row_number() OVER (PARTITION BY id ORDER BY o DESC, away, place) AS k FROM s),
t AS (SELECT source, id, flatten(list(texts ORDER BY place)) AS texts FROM r WHERE strong OR (NOT has AND k = 1) GROUP BY source, id),
u AS (SELECT source, id, x, min(pos) AS pos FROM (SELECT source, id, unnest(texts) AS x, generate_subscripts(texts, 1) AS pos FROM t) GROUP BY ALL)
SELECT source, id, string_agg(x, ' ' ORDER BY pos) AS translation FROM u GROUP BY source, id"""


def missing_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps: episodes up to a season's last that no source has."""
    src = model.sources(spark, sf_dir)
    asked = src.groupBy("series", "season").agg(F.max("episode").alias("last")).select("series", "season", F.explode(F.sequence(F.lit(1), F.greatest("last", F.lit(1)))).alias("episode"))
    return subtitles.missing_episodes(src, asked)


MISSING_EPISODES = f"""WITH {sql.MODEL}, a AS (SELECT series, season, CAST(unnest(range(1, greatest(max(episode), 1) + 1)) AS INTEGER) AS episode FROM src GROUP BY 1, 2)
SELECT a.* FROM a ANTI JOIN src USING (series, season, episode)"""


QUERIES = {
    "srt_cues": (srt_cues, SRT_CUES),
    "clean_lines": (clean_lines, CLEAN_LINES),
    "lexeme_keys": (lexeme_keys, LEXEME_KEYS),
    "kana_fold": (kana_fold, KANA_FOLD),
    "pos_labels": (pos_labels, POS_LABELS),
    "english_words": (english_words, ENGLISH_WORDS),
    "source_labels": (source_labels, SOURCE_LABELS),
    "cloze_text": (cloze_text, CLOZE_TEXT),
    "highlight_text": (highlight_text, HIGHLIGHT_TEXT),
    "merged_cues": (merged_cues, MERGED_CUES),
    "utterances": (utterances, UTTERANCES),
    "interval_overlaps": (interval_overlaps, INTERVAL_OVERLAPS),
    "aligned_translations": (aligned_translations, ALIGNED),
    "missing_episodes": (missing_episodes, MISSING_EPISODES),
}
