"""Queries on the canonical model and on ranking, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tanmono.operators import model, ranking
from tanmono.plans import sql
from tanmono.plans.storage import materialize
from tanmono.session import table


def _model(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return model.occurrences(spark, sf_dir), model.sentences(spark, sf_dir), model.lexemes(spark, sf_dir)


def kept_model(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The model as tables with the columns that ranking reads, for queries that read it several times."""
    occ, _, lex = _model(spark, sf_dir)
    sen = model.sentences(spark, sf_dir, "id", "source_id", "cue_index", "japanese", "english")
    lex = lex.select("id", "lexeme_key", "lemma", "reading", "part_of_speech", "gloss", "dictionary_status", "known_at")
    return materialize(occ, "occ"), materialize(sen, "sen"), materialize(lex, "lex")


def upserted_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.sources(spark, sf_dir).select("id", "series", "season", "episode", "title", "video_path", "imported_at")


UPSERTED_SOURCES = f"WITH {sql.MODEL} SELECT id, series, season, episode, title, video_path, imported_at FROM src"


def corpus_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    occ, _, lex = _model(spark, sf_dir)
    return model.corpus_counts(occ, lex)


CORPUS_COUNTS = f"""WITH {sql.MODEL} SELECT id, corpus_count AS stored, CAST(coalesce(sum(n), 0) AS BIGINT) AS counted
FROM lex LEFT JOIN occ ON lexeme_id = id GROUP BY id, corpus_count"""


def queue_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The learning queue as rebuilt from occurrences: rank and shortest example of every lexeme in every source."""
    occ, sen, lex = _model(spark, sf_dir)
    rows = model.source_counts(occ, sen, lex).join(model.shortest_examples(occ, sen), ["source_id", "lexeme_id"])
    return rows.select("source_id", "lexeme_id", F.round("base_rank", 9).alias("rank_score"), "example_sentence_id")


QUEUE_TABLE = f"""
WITH {sql.MODEL}, r AS (SELECT source_id, lexeme_id, n, sentence_id, length(japanese) AS l, cue_index FROM occ JOIN sen ON sen.id = sentence_id),
q AS (SELECT source_id, lexeme_id, sum(n) AS total, arg_min(sentence_id, (l, cue_index, sentence_id)) AS example_sentence_id FROM r GROUP BY 1, 2)
SELECT source_id, lexeme_id, round(1.0::DOUBLE / total + length(lemma) * 0.01::DOUBLE, 9) AS rank_score, example_sentence_id FROM q JOIN lex ON lex.id = lexeme_id"""


def sentence_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    occ, _, lex = _model(spark, sf_dir)
    return model.sentence_words(occ, lex).withColumn("word_ids", F.array_join("word_ids", ","))


SENTENCE_WORDS = f"""WITH {sql.MODEL}, w AS (SELECT DISTINCT sentence_id, lexeme_id FROM occ)
SELECT sentence_id, count(*) AS n_words, count(*) FILTER (known_at IS NULL) AS n_unknown, string_agg(lexeme_id, ',' ORDER BY lexeme_id) AS word_ids
FROM w JOIN lex ON id = lexeme_id GROUP BY sentence_id"""


def translation_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    occ, sen, _ = _model(spark, sf_dir)
    return model.translation_contexts(occ, sen)


TRANSLATION_CONTEXTS = f"""WITH {sql.MODEL}, t AS (SELECT DISTINCT lexeme_id, english FROM occ JOIN sen ON id = sentence_id WHERE english <> ''),
r AS (SELECT *, row_number() OVER (PARTITION BY lexeme_id ORDER BY english) AS k FROM t)
SELECT lexeme_id, string_agg(english, ' ' ORDER BY english) AS context FROM r WHERE k <= 5 GROUP BY lexeme_id"""


def vocabulary_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    occ, sen, lex = _model(spark, sf_dir)
    return model.vocabulary_growth(model.sources(spark, sf_dir), sen, occ, lex)


VOCABULARY_GROWTH = f"""
WITH {sql.MODEL},
e AS (SELECT series, season, episode, count(sen.id) AS sentences FROM src LEFT JOIN sen ON source_id = src.id GROUP BY ALL),
f AS (SELECT series, season, lexeme_id, min(episode) AS episode FROM occ JOIN sen ON sen.id = sentence_id JOIN src ON src.id = source_id GROUP BY ALL),
n AS (SELECT series, season, episode, count(*) AS new_lexemes, count(*) FILTER (dictionary_status = 'matched' AND gloss IS NOT NULL) AS new_glossed
      FROM f JOIN lex ON lex.id = lexeme_id GROUP BY ALL)
SELECT e.*, coalesce(new_lexemes, 0) AS new_lexemes, coalesce(new_glossed, 0) AS new_glossed,
       CAST(sum(coalesce(new_lexemes, 0)) OVER w AS BIGINT) AS all_lexemes, CAST(sum(coalesce(new_glossed, 0)) OVER w AS BIGINT) AS all_glossed
FROM e LEFT JOIN n USING (series, season, episode) WINDOW w AS (PARTITION BY series, season ORDER BY episode ROWS UNBOUNDED PRECEDING)"""


def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, sen, lex = _model(spark, sf_dir)
    return model.corpus_stats(model.sources(spark, sf_dir), sen, lex)


CORPUS_STATS = f"""WITH {sql.MODEL} SELECT 'sources' AS name, count(*) AS n FROM src UNION ALL SELECT 'sentences', count(*) FROM sen
UNION ALL SELECT 'lexemes', count(*) FROM lex UNION ALL SELECT 'known', count(known_at) FROM lex"""


def undefined_lexemes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.undefined_lexemes(*_model(spark, sf_dir))


UNDEFINED_LEXEMES = f"""
WITH {sql.MODEL}, u AS (
  SELECT lexeme_id, lemma, sum(n) OVER (PARTITION BY lexeme_id) AS total, sentence_id,
         row_number() OVER (PARTITION BY lexeme_id ORDER BY coalesce(english, '') = '', length(japanese), cue_index, sentence_id) AS k
  FROM occ JOIN lex ON lex.id = lexeme_id JOIN sen ON sen.id = sentence_id WHERE dictionary_status = 'missing' OR gloss IS NULL)
SELECT lexeme_id, lemma, CAST(total AS BIGINT) AS total, sentence_id AS example_id FROM u WHERE k = 1"""


def excluded_lexemes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each source's queue leaves out, why, and in which order it is listed."""
    return model.excluded_lexemes(*_model(spark, sf_dir))


EXCLUDED_LEXEMES = f"""
WITH {sql.MODEL}, o AS (SELECT id, lexeme_key, lemma, CASE WHEN coalesce(part_of_speech, '') = '感動詞' AND length(lemma) <= 1 THEN 'reaction_fragment'
       WHEN dictionary_status = 'missing' OR gloss IS NULL THEN 'missing_definition' END AS reason FROM lex),
g AS (SELECT source_id, lexeme_id, lexeme_key, lemma, reason, CAST(sum(n) AS BIGINT) AS source_count,
             arg_min(sentence_id, (coalesce(english, '') = '', length(japanese), cue_index, sentence_id)) AS example_id
      FROM occ JOIN o ON o.id = lexeme_id JOIN sen ON sen.id = sentence_id WHERE reason IS NOT NULL GROUP BY ALL)
SELECT *, CAST(row_number() OVER (PARTITION BY source_id ORDER BY source_count DESC, lemma, lexeme_key) AS INTEGER) AS position FROM g"""


def stale_lexemes(spark: SparkSession, sf_dir: str) -> DataFrame:
    occ, _, lex = _model(spark, sf_dir)
    return model.stale_lexemes(lex, occ)


STALE_LEXEMES = f"""WITH {sql.MODEL} SELECT id FROM lex WHERE (dictionary_status IS NULL OR coalesce(dictionary_version, 0) < 2)
AND EXISTS (SELECT 1 FROM occ WHERE lexeme_id = id)"""


def orphan_lexemes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards are taken from the stored queue."""
    occ, _, lex = _model(spark, sf_dir)
    return model.orphan_lexemes(lex, occ, table(spark, sf_dir, "source_queue"))


ORPHAN_LEXEMES = f"""WITH {sql.MODEL} SELECT id FROM lex WHERE known_at IS NULL AND NOT EXISTS (SELECT 1 FROM occ WHERE lexeme_id = id)
AND NOT EXISTS (SELECT 1 FROM source_queue q WHERE q.lexeme_id = id)"""


def lexeme_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of every sentence's words in reverse order of id, with one id that does not exist."""
    occ, _, lex = _model(spark, sf_dir)
    asked = model.sentence_words(occ, lex).select(F.col("sentence_id").alias("key"), F.concat(F.reverse("word_ids"), F.array(F.lit(-1).cast("bigint"))).alias("ids"))
    return model.lexeme_labels(asked, lex).select("key", F.array_join("labels", "、").alias("labels"))


LEXEME_LABELS = f"""WITH {sql.MODEL}, w AS (SELECT DISTINCT sentence_id, lexeme_id FROM occ)
SELECT sentence_id AS key, coalesce(string_agg(lemma || '（' || reading || '）', '、' ORDER BY lexeme_id DESC), '') AS labels FROM w JOIN lex ON id = lexeme_id GROUP BY 1"""


def known_first_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").filter("event_type = 'purchase'")
    return model.first_event(rows, "user_id", "ts").withColumnRenamed("key", "user_id")


KNOWN_FIRST_EVENT = "SELECT user_id, min(ts) AS first_at FROM events WHERE event_type = 'purchase' AND user_id IS NOT NULL AND ts IS NOT NULL GROUP BY 1"


def reimported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source_id) of sources that came in more than once."""
    counts = table(spark, sf_dir, "sources").groupBy(F.col("id").alias("source_id")).agg(F.count_distinct("imported_at").alias("n"))
    return counts.filter("n > 1").select("source_id")


_REIMPORTED = "again AS (SELECT id AS source_id FROM sources GROUP BY id HAVING count(DISTINCT imported_at) > 1)"


def replaced_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences per source after re-imported sources were replaced by those of their lines that have a translation."""
    sen = model.sentences(spark, sf_dir, "id", "source_id", "cue_index", "english")
    fresh = sen.join(reimported(spark, sf_dir), "source_id", "left_semi").filter("english <> ''").select(sen.columns)
    return model.replaced(sen, fresh, "source_id").groupBy("source_id").agg(F.count("*").alias("n"), F.sum("cue_index").alias("cues"))


REPLACED_SOURCES = f"""WITH {sql.MODEL}, {_REIMPORTED}, f AS (SELECT sen.* FROM sen SEMI JOIN again USING (source_id) WHERE english <> '')
SELECT source_id, count(*) AS n, CAST(sum(cue_index) AS BIGINT) AS cues FROM (SELECT source_id, cue_index FROM sen WHERE source_id NOT IN (SELECT source_id FROM f)
UNION ALL SELECT source_id, cue_index FROM f) GROUP BY 1"""


def kept_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plans, one for each lexeme's cards in the stored queue, that no re-imported source touches."""
    queue = table(spark, sf_dir, "source_queue").select(F.col("lexeme_id").alias("batch_id"), F.col("example_sentence_id").alias("sentence_id"))
    lines = model.sentences(spark, sf_dir).select(F.col("id").alias("sentence_id"), "source_id")
    changed = lines.join(reimported(spark, sf_dir), "source_id", "left_semi")
    return model.without_batches(queue.select("batch_id").distinct(), queue, changed)


KEPT_BATCHES = f"""WITH {sql.MODEL}, {_REIMPORTED} SELECT DISTINCT lexeme_id AS batch_id FROM source_queue WHERE lexeme_id NOT IN (
SELECT q.lexeme_id FROM source_queue q JOIN sen ON sen.id = example_sentence_id JOIN again ON again.source_id = sen.source_id)"""


_EXAMPLES = f"""
WITH {sql.MODEL},
w AS (SELECT sentence_id, count(*) AS n_words, count(*) FILTER (known_at IS NULL) AS n_unknown
      FROM (SELECT DISTINCT sentence_id, lexeme_id FROM occ) JOIN lex ON id = lexeme_id GROUP BY 1),
x AS (SELECT source_id, lexeme_id, sentence_id, cue_index, n_words, n_unknown, row_number() OVER (PARTITION BY source_id, lexeme_id ORDER BY
        coalesce(english, '') = '', contains(japanese, '→') OR contains(japanese, '…') OR left(japanese, 1) IN ('＜', '《', '≪'),
        {sql.any_of("japanese", ranking.COLLOQUIAL_MARKS)}, n_words NOT BETWEEN 2 AND 6, n_unknown - CAST(known_at IS NULL AS INTEGER),
        surface <> lemma, abs(length(japanese) - 14), cue_index, sentence_id) AS k
      FROM occ JOIN sen ON sen.id = sentence_id JOIN lex ON lex.id = lexeme_id JOIN w USING (sentence_id)),
examples AS (SELECT * EXCLUDE k FROM x WHERE k = 1)"""


def initial_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.initial_examples(*_model(spark, sf_dir))


INITIAL_EXAMPLES = _EXAMPLES + " SELECT * FROM examples"


def _ranked(spark: SparkSession, sf_dir: str, metrics: list[str], limit: int | None = None) -> DataFrame:
    return ranking.ranked(ranking.candidates(*kept_model(spark, sf_dir)), metrics, limit)


def _metric_sql(metric: str) -> str:
    return " + ".join(f"CAST(round(c_{n} * 1000000) AS BIGINT) * {round(w * 100)}" for n, w in ranking.WEIGHTS[metric].items())


_DIFFICULTY = _EXAMPLES + f""",
z AS (SELECT lemma, log10(sum(n) * 1e9::DOUBLE / (SELECT sum(n) FROM occ)) AS zipf FROM occ JOIN lex ON id = lexeme_id GROUP BY lemma),
cnt AS (SELECT source_id, lexeme_id, sum(n) AS source_count FROM occ JOIN sen ON sen.id = sentence_id GROUP BY 1, 2),
cand AS (SELECT e.*, lexeme_key, lemma, part_of_speech, source_count, japanese, english, coalesce(zipf, 0) AS zipf,
                length(regexp_replace(lemma, '[\\s\\x{{3000}}]', '', 'g')) AS chars, greatest(n_words, 1) AS wd, greatest(n_unknown, 1) AS un
         FROM cnt JOIN examples e USING (source_id, lexeme_id) JOIN lex ON lex.id = lexeme_id JOIN sen ON sen.id = sentence_id LEFT JOIN z USING (lemma)
         WHERE known_at IS NULL AND (dictionary_status IS NULL OR (dictionary_status = 'matched' AND gloss IS NOT NULL))
           AND NOT (coalesce(part_of_speech, '') = '感動詞' AND length(lemma) <= 1)),
comp AS (SELECT *,
    round(greatest(0, least(1, (6.8::DOUBLE - zipf) / 4.3::DOUBLE)), 6) AS c_general,
    round(least(1, 1.0::DOUBLE / sqrt(greatest(source_count, 1))), 6) AS c_source,
    round(0.7::DOUBLE * CASE WHEN wd > 1 THEN (un - 1) / (wd - 1) ELSE 0 END + 0.3::DOUBLE * least(1, greatest(wd - 2, 0) / 10), 6) AS c_sentence,
    round(0.55::DOUBLE * least(1, greatest(chars - 1, 0) / 5) + 0.45::DOUBLE * CASE WHEN chars > 0
          THEN len(regexp_extract_all(lemma, '[\\x{{3400}}-\\x{{9fff}}]')) / chars ELSE 0 END, 6) AS c_form,
    round(0.40::DOUBLE * CAST(coalesce(english, '') = '' AS INTEGER) + 0.30::DOUBLE * CAST({sql.any_of("japanese", ranking.FRAGMENT_MARKS)} AS INTEGER)
          + 0.20::DOUBLE * CAST({sql.any_of("japanese", ranking.COLLOQUIAL_MARKS)} AS INTEGER) + 0.10::DOUBLE * CAST(wd <= 1 AS INTEGER), 6) AS c_quality,
    CASE WHEN coalesce(part_of_speech, '') = '感動詞' OR lemma IN ({", ".join(f"'{f}'" for f in ranking.FILLERS)}) THEN 1.0::DOUBLE
         WHEN regexp_full_match(lemma, '[\\x{{3040}}-\\x{{30ff}}ー]') THEN 0.8::DOUBLE ELSE 0.0::DOUBLE END AS c_noise FROM cand),
scored AS ({" UNION ALL ".join(f"SELECT *, '{m}' AS metric, floor((greatest(0, least(100000000, {_metric_sql(m)})) + 500) / 1000) / 1000.0::DOUBLE AS difficulty FROM comp" for m in ranking.WEIGHTS)}),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY source_id, metric ORDER BY difficulty, source_count DESC, cue_index, lexeme_key) AS INTEGER) AS rank FROM scored)"""


def difficulty_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate of every source under all three metrics."""
    return _ranked(spark, sf_dir, list(ranking.WEIGHTS)).select("source_id", "lexeme_id", "metric", "difficulty", "rank")


DIFFICULTY_RANKING = _DIFFICULTY + " SELECT source_id, lexeme_id, metric, difficulty, rank FROM ranked"


def difficulty_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ranking.components(ranking.candidates(*kept_model(spark, sf_dir)))
    return rows.select("source_id", "lexeme_id", "c_general", "c_source", "c_sentence", "c_form", "c_quality", "c_noise")


DIFFICULTY_COMPONENTS = _DIFFICULTY + " SELECT source_id, lexeme_id, c_general, c_source, c_sentence, c_form, c_quality, c_noise FROM comp"


def metric_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ranks of each candidate under the three metrics side by side."""
    rows = _ranked(spark, sf_dir, list(ranking.WEIGHTS))
    return rows.groupBy("source_id", "lexeme_id").pivot("metric", list(ranking.WEIGHTS)).agg(F.first("rank"))


METRIC_COMPARISON = _DIFFICULTY + "SELECT source_id, lexeme_id, " + ", ".join(f"max(rank) FILTER (metric = '{m}') AS {m}" for m in ranking.WEIGHTS) + " FROM ranked GROUP BY 1, 2"


def unseen_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidates that a plan of 20 looks at, easiest first: the flagship query."""
    rows = _ranked(spark, sf_dir, ["hybrid"], 100)
    return rows.select("source_id", "rank", "lexeme_id", "lemma", "difficulty", "source_count", F.col("sentence_id").alias("example_id"))


UNSEEN_QUEUE = _DIFFICULTY + """ SELECT source_id, rank, lexeme_id, lemma, difficulty, CAST(source_count AS BIGINT) AS source_count, sentence_id AS example_id
FROM ranked WHERE metric = 'hybrid' AND rank <= 100"""


def _parts(spark: SparkSession, sf_dir: str, limit: int | None = None, scopes: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Candidates and their examples, all or those that a plan of that limit looks at; by source or by scope."""
    occ, sen, lex = kept_model(spark, sf_dir)
    if scopes is not None:
        sen = materialize(ranking.scoped(sen, scopes), "scoped")
    columns = ["source_id", "lexeme_id", "lemma", "metric", "difficulty", "source_count", "cue_index", "lexeme_key"]
    rows = materialize(ranking.scored(ranking.candidates(occ, sen, lex), ["hybrid"]).select(columns), "scored")
    if limit is None:
        return rows, materialize(ranking.example_parts(rows, occ, sen, lex), "parts")
    pool = materialize(ranking.with_ranks(rows, ranking.pool_size(limit)), "pool")
    return pool, materialize(ranking.example_parts(rows, occ, sen, lex, pool), "parts")


def example_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = ranking.opening_scores(_parts(spark, sf_dir)[1])
    return scores.select(
        "source_id", "lexeme_id", "sentence_id", "surface", "n_unknown_others", "n_harder",
        F.round("example_score", 6).alias("example_score"), F.round("joint_score", 6).alias("joint_score"),
    )


_EXAMPLE_SCORES = _DIFFICULTY + f""",
h AS (SELECT * FROM ranked WHERE metric = 'hybrid'),
ex AS (SELECT h.source_id, lexeme_id, h.lemma, h.difficulty, rank, o.sentence_id, surface, japanese, english, n_words
       FROM occ o JOIN sen ON sen.id = o.sentence_id JOIN (SELECT source_id, lexeme_id, lemma, difficulty, rank FROM h) h USING (source_id, lexeme_id) JOIN w ON w.sentence_id = o.sentence_id),
ctx AS (SELECT DISTINCT o.sentence_id, o.lexeme_id AS other, h.difficulty AS od FROM occ o JOIN lex ON lex.id = o.lexeme_id JOIN sen ON sen.id = o.sentence_id
        LEFT JOIN h ON h.source_id = sen.source_id AND h.lexeme_id = o.lexeme_id WHERE lex.known_at IS NULL),
agg AS (SELECT ex.source_id, ex.lexeme_id, ex.sentence_id, surface, count(other) AS n_unknown_others,
               count(other) FILTER (od IS NULL OR od - difficulty - 2.0::DOUBLE > 0) AS n_harder, coalesce(sum(greatest(od - difficulty - 2.0::DOUBLE, 0)), 0) AS gaps
        FROM ex LEFT JOIN ctx ON ctx.sentence_id = ex.sentence_id AND other <> ex.lexeme_id GROUP BY ALL),
es AS (SELECT ex.source_id, ex.lexeme_id, ex.sentence_id, ex.surface, difficulty, rank, CAST(n_unknown_others AS INTEGER) AS n_unknown_others, CAST(n_harder AS INTEGER) AS n_harder,
    10.0::DOUBLE * n_unknown_others + 8.0::DOUBLE * n_harder + gaps + 25.0::DOUBLE * CAST(coalesce(english, '') = '' AS INTEGER)
    + 15.0::DOUBLE * CAST({sql.any_of("japanese", ranking.PLAN_FRAGMENT_MARKS)} AS INTEGER)
    + 8.0::DOUBLE * CAST(len(regexp_extract_all(japanese, '[。？！?!]')) > 1 AS INTEGER) + 5.0::DOUBLE * CAST({sql.any_of("japanese", ranking.COLLOQUIAL_MARKS)} AS INTEGER)
    + 3.0::DOUBLE * CAST(n_words <= 1 AS INTEGER) + 1.25::DOUBLE * abs(n_words - 2) + 0.75::DOUBLE * CAST(ex.surface <> lemma AS INTEGER)
    + 50.0::DOUBLE * CAST(lemma = 'いい' AND starts_with(substr(japanese, instr(japanese, ex.surface) + length(ex.surface)), 'たい') AS INTEGER)
    + 0.15::DOUBLE * greatest(len(list_filter(regexp_split_to_array(coalesce(english, ''), '\\s+'), lambda x: x <> '')) - 30, 0) + 0.01::DOUBLE * length(japanese) AS score
    FROM ex JOIN agg USING (source_id, lexeme_id, sentence_id, surface))"""
EXAMPLE_SCORES = _EXAMPLE_SCORES + """ SELECT source_id, lexeme_id, sentence_id, surface, n_unknown_others, n_harder, round(score, 6) AS example_score,
round(difficulty + 3.0::DOUBLE * score, 6) AS joint_score FROM es"""


def _first_planned(rows: DataFrame, parts: DataFrame) -> DataFrame:
    scores = ranking.opening_scores(parts).join(rows.select("source_id", "lexeme_id", "rank"), ["source_id", "lexeme_id"])
    key = F.struct(F.round("joint_score", 6).alias("joint"), "difficulty", "rank", "sentence_id", "surface", "lexeme_id")
    best = scores.groupBy("source_id").agg(F.min(key).alias("b"))
    return best.select("source_id", "b.lexeme_id", "b.sentence_id", "b.surface", F.col("b.joint").alias("joint_score"))


def first_planned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first card of every source's plan, from expressions alone."""
    return _first_planned(*_parts(spark, sf_dir, 20))


FIRST_PLANNED = _EXAMPLE_SCORES + """, b AS (SELECT source_id, min((round(difficulty + 3.0::DOUBLE * score, 6), difficulty, rank, sentence_id, surface, lexeme_id)) AS b FROM es WHERE rank <= 100 GROUP BY 1)
SELECT source_id, b[6] AS lexeme_id, b[4] AS sentence_id, b[5] AS surface, b[1] AS joint_score FROM b"""


def _plan(pool: DataFrame, parts: DataFrame, reserved: DataFrame | None = None) -> DataFrame:
    plan = ranking.planned(pool, parts, 20, reserved)
    return plan.withColumns({"example_score": F.round("example_score", 6), "joint_score": F.round("joint_score", 6)})


def planned_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plan of 20 cards for every source."""
    return _plan(*_parts(spark, sf_dir, 20))


def seasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(scope_id, source_id): the sources of every season as one scope, by its smallest source, and all sources as scope 0."""
    src = model.sources(spark, sf_dir).select("id", "series", "season")
    firsts = src.groupBy("series", "season").agg(F.min("id").alias("scope_id"))
    same = F.col("a.series").eqNullSafe(F.col("b.series")) & F.col("a.season").eqNullSafe(F.col("b.season"))
    by_season = src.alias("a").join(firsts.alias("b"), same).select("scope_id", F.col("id").alias("source_id"))
    return by_season.unionByName(src.select(F.lit(0).cast("bigint").alias("scope_id"), F.col("id").alias("source_id")))


def scoped_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidates of a plan of 20 for every season and for all sources together, counts and examples over the whole scope."""
    occ, sen, lex = kept_model(spark, sf_dir)
    sen = materialize(ranking.scoped(sen, seasons(spark, sf_dir)), "scoped")
    rows = ranking.ranked(ranking.candidates(occ, sen, lex), ["hybrid"], 100)
    return rows.select(
        F.col("source_id").alias("scope_id"), "rank", "lexeme_id", "difficulty", "source_count", F.col("sentence_id").alias("example_id")
    )


def _scoped_sql(text: str) -> str:
    """The SQL of a query by source, by scope instead; scopes overlap, so sentences are told apart by scope."""
    scopes = """,
scopes AS (SELECT id AS source_id, min(id) OVER (PARTITION BY series, season) AS scope_id FROM src UNION ALL SELECT id, 0 FROM src),
one AS (SELECT * FROM sen),
two AS (SELECT scope_id, one.* EXCLUDE (source_id) FROM one JOIN scopes USING (source_id))"""
    text = text.replace(sql.MODEL, sql.MODEL.rstrip() + scopes, 1)
    head, tail = text.split(scopes)
    for old, new in (
        ("JOIN sen ON sen.id = sentence_id LEFT JOIN z", "JOIN sen ON sen.id = sentence_id AND sen.source_id = e.source_id LEFT JOIN z"),
        ("SELECT DISTINCT o.sentence_id, o.lexeme_id AS other, h.difficulty AS od", "SELECT DISTINCT sen.source_id, o.sentence_id, o.lexeme_id AS other, h.difficulty AS od"),
        ("LEFT JOIN ctx ON ctx.sentence_id = ex.sentence_id AND", "LEFT JOIN ctx ON ctx.source_id = ex.source_id AND ctx.sentence_id = ex.sentence_id AND"),
        ("FROM sen", "FROM two sen"), ("JOIN sen", "JOIN (SELECT * EXCLUDE (scope_id), scope_id AS source_id FROM two) sen"),
    ):
        tail = tail.replace(old, new)
    return head + scopes + tail


SCOPED_QUEUE = _scoped_sql(_DIFFICULTY) + """ SELECT source_id AS scope_id, rank, lexeme_id, difficulty, CAST(source_count AS BIGINT) AS source_count, sentence_id AS example_id
FROM ranked WHERE metric = 'hybrid' AND rank <= 100"""


def scoped_first_planned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first card of the plan of every season and of all sources together."""
    rows = _first_planned(*_parts(spark, sf_dir, 20, seasons(spark, sf_dir)))
    return rows.withColumnRenamed("source_id", "scope_id")


SCOPED_FIRST_PLANNED = _scoped_sql(FIRST_PLANNED).replace("SELECT source_id, b[6]", "SELECT source_id AS scope_id, b[6]")


def scoped_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plan of 20 cards for every season and for all sources together; sentences of the stored queue's cards are reserved for them."""
    reserved = table(spark, sf_dir, "source_queue").groupBy("lexeme_id").agg(F.min("example_sentence_id").alias("sentence_id"))
    return _plan(*_parts(spark, sf_dir, 20, seasons(spark, sf_dir)), reserved).withColumnRenamed("source_id", "scope_id")


def known_alternatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentences that stored cards show are used, whatever lexeme shows them."""
    occ, sen, lex = _model(spark, sf_dir)
    used = table(spark, sf_dir, "source_queue").filter("example_sentence_id IS NOT NULL").select(F.col("example_sentence_id").alias("sentence_id")).distinct()
    return ranking.known_alternatives(occ, sen, lex, used)


KNOWN_ALTERNATIVES = f"""
WITH {sql.MODEL}, k AS (SELECT sentence_id, count(*) FILTER (known_at IS NULL) AS u FROM (SELECT DISTINCT sentence_id, lexeme_id FROM occ) JOIN lex ON id = lexeme_id GROUP BY 1)
SELECT source_id, lexeme_id, sentence_id, surface, CAST(row_number() OVER (PARTITION BY source_id, lexeme_id ORDER BY coalesce(english, '') = '', length(japanese), cue_index, sentence_id, surface) AS INTEGER) AS rank
FROM occ JOIN k USING (sentence_id) JOIN lex ON lex.id = lexeme_id JOIN sen ON sen.id = sentence_id
WHERE u = CAST(known_at IS NULL AS INTEGER) AND contains(japanese, surface) AND sentence_id NOT IN (SELECT example_sentence_id FROM source_queue WHERE example_sentence_id IS NOT NULL)"""


QUERIES = {
    "upserted_sources": (upserted_sources, UPSERTED_SOURCES),
    "corpus_counts": (corpus_counts, CORPUS_COUNTS),
    "queue_table": (queue_table, QUEUE_TABLE),
    "sentence_words": (sentence_words, SENTENCE_WORDS),
    "translation_contexts": (translation_contexts, TRANSLATION_CONTEXTS),
    "vocabulary_growth": (vocabulary_growth, VOCABULARY_GROWTH),
    "corpus_stats": (corpus_stats, CORPUS_STATS),
    "undefined_lexemes": (undefined_lexemes, UNDEFINED_LEXEMES),
    "excluded_lexemes": (excluded_lexemes, EXCLUDED_LEXEMES),
    "stale_lexemes": (stale_lexemes, STALE_LEXEMES),
    "orphan_lexemes": (orphan_lexemes, ORPHAN_LEXEMES),
    "lexeme_labels": (lexeme_labels, LEXEME_LABELS),
    "known_first_event": (known_first_event, KNOWN_FIRST_EVENT),
    "replaced_sources": (replaced_sources, REPLACED_SOURCES),
    "kept_batches": (kept_batches, KEPT_BATCHES),
    "initial_examples": (initial_examples, INITIAL_EXAMPLES),
    "difficulty_components": (difficulty_components, DIFFICULTY_COMPONENTS),
    "difficulty_ranking": (difficulty_ranking, DIFFICULTY_RANKING),
    "metric_comparison": (metric_comparison, METRIC_COMPARISON),
    "unseen_queue": (unseen_queue, UNSEEN_QUEUE),
    "example_scores": (example_scores, EXAMPLE_SCORES),
    "first_planned": (first_planned, FIRST_PLANNED),
    "planned_batch": (planned_batch, None),
    "scoped_queue": (scoped_queue, SCOPED_QUEUE),
    "scoped_first_planned": (scoped_first_planned, SCOPED_FIRST_PLANNED),
    "scoped_plan": (scoped_plan, None),
    "known_alternatives": (known_alternatives, KNOWN_ALTERNATIVES),
}
