"""Queries on words in place and expressions, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tanmono.functions import text as tx
from tanmono.operators import audit, model, morphs, tokens
from tanmono.plans import sql
from tanmono.plans.meaning_queries import _words
from tanmono.plans.storage import materialize
from tanmono.plans.text_queries import _ANAK
from tanmono.session import table


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = model.sentences(spark, sf_dir, "id", "japanese", "english").filter("japanese <> ''")
    return rows.select(F.col("id").alias("sentence_id"), tx.clean_text("japanese").alias("text"), "english")


def _morphs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    lines = materialize(_lines(spark, sf_dir), "lines")
    return lines, materialize(morphs.morphs(lines, "sentence_id", "text"), "morphs")


def located_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of every line with its class and span, and where its inflection ends."""
    return morphs.endings(_morphs(spark, sf_dir)[1]).select("sentence_id", "position", "surface", "reading", "pos", "start", "end", "inflected_end")


_MORPHS = f"""
lines AS (SELECT DISTINCT id AS sentence_id, {sql.clean("japanese")} AS text, english FROM sentences WHERE japanese <> ''),
pieces AS (SELECT sentence_id, unnest(p) AS surface, generate_subscripts(p, 1) AS i FROM (SELECT sentence_id, regexp_extract_all(text, '{tokens.WORD}|[\\s\\S]') AS p FROM lines)),
spans AS (SELECT *, sum(length(surface)) OVER (PARTITION BY sentence_id ORDER BY i) AS stop FROM pieces),
runs AS (SELECT sentence_id, surface, CAST(stop - length(surface) AS INTEGER) AS start, CAST(stop AS INTEGER) AS "end" FROM spans WHERE regexp_full_match(surface, '{tokens.WORD}')),
m AS (SELECT *, CAST(row_number() OVER w - 1 AS INTEGER) AS position, translate(lower(surface), {_ANAK}) AS reading, CASE WHEN NOT regexp_full_match(surface, '[ぁ-ゖ]+') THEN '名詞'
        WHEN surface IN ({", ".join(f"'{p}'" for p in morphs.PARTICLES)}) THEN '助詞' WHEN lag("end") OVER w = start THEN '助動詞' ELSE '副詞' END AS pos
      FROM runs WINDOW w AS (PARTITION BY sentence_id ORDER BY start)),
e AS (SELECT *, min(stop) OVER (PARTITION BY sentence_id ORDER BY position ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS inflected_end FROM (
      SELECT *, CASE WHEN lead(start) OVER w = "end" AND lead(pos) OVER w = '助動詞' THEN NULL ELSE "end" END AS stop FROM m WINDOW w AS (PARTITION BY sentence_id ORDER BY position)))"""
LOCATED_WORDS = f'WITH {_MORPHS.lstrip()} SELECT sentence_id, position, surface, reading, pos, start, "end", inflected_end FROM e'


def learner_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words to learn by their place among all words of the line."""
    return morphs.component_tokens(_morphs(spark, sf_dir)[1]).select("sentence_id", "position", "surface", "pos")


_CONTENT = ", ".join(f"'{p}'" for p in tokens.CONTENT_POS)
LEARNER_WORDS = f"""WITH {_MORPHS.lstrip()} SELECT sentence_id, position, surface, pos FROM m WHERE pos IN ({_CONTENT}) AND regexp_matches(surface, '[\\x{{3040}}-\\x{{30ff}}\\x{{3400}}-\\x{{9fff}}]')"""


def inflected_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every occurrence's surface as a word of the analyzer, with its ending; as plain text where it is the dictionary form."""
    lines = model.sentences(spark, sf_dir, "id", "japanese").filter("japanese <> ''").select(F.col("id").alias("sentence_id"), tx.clean_text("japanese").alias("text"))
    occ = model.occurrences(spark, sf_dir).select("sentence_id", "lexeme_id", "surface")
    targets = occ.join(model.lexemes(spark, sf_dir).select(F.col("id").alias("lexeme_id"), "lemma"), "lexeme_id")
    found = morphs.inflected_targets(targets, lines, lambda surface: tx.to_katakana(F.lower(surface)))
    return found.select("sentence_id", "lexeme_id", "surface", "start", "end")


INFLECTED_TARGETS = f"""WITH {sql.MODEL}, {_MORPHS.lstrip()},
t AS (SELECT sentence_id, lexeme_id, surface, lemma, text FROM occ JOIN lex ON id = lexeme_id JOIN lines USING (sentence_id)),
f AS (SELECT sentence_id, lower(surface) AS lemma, surface, arg_min({{'s': start, 'e': inflected_end}}, position) AS span FROM e GROUP BY ALL)
SELECT sentence_id, lexeme_id, t.surface, coalesce(span.s, CASE WHEN t.surface = t.lemma THEN nullif(instr(text, t.surface), 0) - 1 END) AS start,
       coalesce(span.e, CASE WHEN t.surface = t.lemma THEN nullif(instr(text, t.surface), 0) - 1 END + length(t.surface)) AS "end"
FROM t LEFT JOIN f USING (sentence_id, lemma, surface)"""


def _forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(surface, lemma, reading, gloss): what a form stands for, by the first lexeme with a gloss that it is a form of."""
    lex = model.lexemes(spark, sf_dir).filter("gloss <> ''").select(F.col("id").alias("lexeme_id"), "lemma", "reading", "gloss")
    forms = table(spark, sf_dir, "occurrences").select("lexeme_id", "surface").distinct().join(lex, "lexeme_id")
    return materialize(forms.groupBy("surface").agg(F.min_by(F.struct("lemma", "reading", "gloss"), "lexeme_id").alias("b")).select("surface", "b.*"), "forms")


def expression_rows(spark: SparkSession, sf_dir: str, lines: DataFrame | None = None) -> DataFrame:
    """The runs of words that are the form of some lexeme with a gloss, weighed against the words in them; lines as of _lines()."""
    return morphs.line_analyses(_lines(spark, sf_dir) if lines is None else lines, _forms(spark, sf_dir), tx.english_words)


def expression_analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every run of words that a dictionary form spells, with the decision whether it is an expression there."""
    return expression_rows(spark, sf_dir).select("sentence_id", "position", "n", "start", "end", "surface", "lemma", "with_particle", "decision", "margin", "opacity")


def _like(a: str, b: str) -> str:
    return f"coalesce(len(list_intersect({a}, {b})) / nullif(least(len({a}), len({b})), 0), 0)::DOUBLE"


_ANALYSES = f"""{sql.MODEL}, {_MORPHS.lstrip()},
forms AS (SELECT surface, arg_min({{'l': lemma, 'r': reading, 'g': gloss}}, id) AS b FROM (SELECT DISTINCT lexeme_id, surface FROM occ) JOIN lex ON id = lexeme_id WHERE gloss <> '' GROUP BY 1),
parts AS (SELECT sentence_id, position, coalesce(b.g, m.surface) AS gloss FROM m LEFT JOIN forms USING (surface) WHERE pos IN ({_CONTENT}) AND regexp_matches(m.surface, '[\\x{{3040}}-\\x{{30ff}}\\x{{3400}}-\\x{{9fff}}]')),
steps AS (SELECT a.sentence_id, a.position, k.n, a.start, b."end" FROM m a, (VALUES (2), (3), (4)) k(n), m b WHERE b.sentence_id = a.sentence_id AND b.position = a.position + k.n - 1),
cand AS (SELECT s.*, substr(text, s.start + 1, s."end" - s.start) AS surface, bool_or(pos = '助詞') AS with_particle
         FROM steps s JOIN m ON m.sentence_id = s.sentence_id AND m.position BETWEEN s.position AND s.position + s.n - 1 JOIN lines ON lines.sentence_id = s.sentence_id
         GROUP BY s.sentence_id, s.position, s.n, s.start, s."end", text
         HAVING sum(length(m.surface)) = s."end" - s.start AND bool_or(pos IN ({_CONTENT}))),
known AS (SELECT c.*, b.l AS lemma, b.r AS reading, b.g AS gloss FROM cand c JOIN forms USING (surface)
          WHERE regexp_matches(surface, '[\\x{{3040}}-\\x{{30ff}}\\x{{3400}}-\\x{{9fff}}]') AND len(regexp_extract_all(surface, '{tokens.WORD}')) <> 1),
own AS (SELECT k.sentence_id, k.position, k.n, count(*) AS n_parts, string_agg(p.gloss, ' ' ORDER BY p.position) AS glosses
        FROM known k JOIN parts p ON p.sentence_id = k.sentence_id AND p.position BETWEEN k.position AND k.position + k.n - 1 GROUP BY 1, 2, 3),
w AS (SELECT k.*, coalesce(n_parts, 0) AS n_parts, {_words("coalesce(english, '')")} AS we, {_words("gloss")} AS wf, {_words("coalesce(glosses, '')")} AS wc,
             regexp_replace(text, '^[\\s。？！?!、…]+|[\\s。？！?!、…]+$', '', 'g') = k.surface AS alone
      FROM known k LEFT JOIN own USING (sentence_id, position, n) JOIN lines USING (sentence_id)),
sc AS (SELECT *, {_like("we", "wf")} AS phrase, {_like("we", "wc")} AS comp, CASE WHEN n_parts > 1 THEN 1.0::DOUBLE - {_like("wf", "wc")} ELSE 1.0::DOUBLE END AS op FROM w),
ana AS (SELECT sentence_id, position, n, start, "end", surface, lemma, reading, gloss, with_particle, CASE WHEN n_parts < 1 THEN 'insufficient_evidence'
  WHEN phrase >= 0.82::DOUBLE AND phrase - comp >= CASE WHEN n_parts > 1 AND alone THEN 0.02::DOUBLE ELSE 0.04::DOUBLE END AND op >= CASE WHEN with_particle THEN 0.14::DOUBLE ELSE 0.16::DOUBLE END THEN 'expression'
  WHEN comp > phrase THEN 'components' ELSE 'ambiguous' END AS decision,
  CASE WHEN n_parts < 1 THEN 0.0::DOUBLE ELSE round(phrase - comp, 6) END AS margin, CASE WHEN n_parts < 1 THEN 0.0::DOUBLE ELSE round(op, 6) END AS opacity FROM sc)"""
EXPRESSION_ANALYSES = f'WITH {_ANALYSES} SELECT sentence_id, position, n, start, "end", surface, lemma, with_particle, decision, margin, opacity FROM ana'


def words_with_expressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of every line after accepted expressions took the place of their parts."""
    lines = materialize(_lines(spark, sf_dir), "lines")
    taken = materialize(morphs.taken_runs(expression_rows(spark, sf_dir, lines)), "taken")
    return morphs.lines_with_expressions(lines, taken).select("sentence_id", "position", "surface", "lemma", "pos", "start", "end")


WORDS_WITH_EXPRESSIONS = f"""WITH RECURSIVE {_ANALYSES},
acc AS (SELECT sentence_id, position, max(n) AS n FROM ana WHERE decision = 'expression' GROUP BY 1, 2),
walk AS (SELECT sentence_id, min(position) AS position FROM acc GROUP BY 1
         UNION ALL SELECT w.sentence_id, (SELECT min(b.position) FROM acc b WHERE b.sentence_id = w.sentence_id AND b.position >= w.position + a.n)
         FROM walk w JOIN acc a ON a.sentence_id = w.sentence_id AND a.position = w.position),
took AS (SELECT ana.* FROM ana JOIN acc USING (sentence_id, position, n) JOIN (SELECT DISTINCT sentence_id, position FROM walk WHERE position IS NOT NULL) USING (sentence_id, position))
SELECT sentence_id, position, surface, lemma, '表現' AS pos, start, "end" FROM took
UNION ALL SELECT sentence_id, position, surface, lower(surface), pos, start, "end" FROM m
WHERE pos IN ({_CONTENT}) AND regexp_matches(surface, '[\\x{{3040}}-\\x{{30ff}}\\x{{3400}}-\\x{{9fff}}]')
  AND NOT EXISTS (SELECT 1 FROM took t WHERE t.sentence_id = m.sentence_id AND m.position BETWEEN t.position AND t.position + t.n - 1)"""


def overlapping_analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every occurrence whose form stands in its line, the analyses that overlap it."""
    lines = materialize(_lines(spark, sf_dir), "lines")
    found = expression_rows(spark, sf_dir, lines).select("sentence_id", F.struct("start", "end", "decision").alias("a"))
    found = found.groupBy("sentence_id").agg(F.collect_list("a").alias("found"))
    # Texts come only with the lines in which there is an analysis.
    lines = materialize(lines.select("sentence_id", "text").join(found, "sentence_id"), "analyzed")
    occ = model.occurrences(spark, sf_dir).select("sentence_id", "lexeme_id", "surface").join(lines, "sentence_id")
    start, end = tokens.literal_span(F.col("text"), F.col("surface"))
    cards = occ.select("sentence_id", "lexeme_id", start.alias("start"), end.alias("end"), "found").filter("start IS NOT NULL")
    met = F.filter("found", lambda a: audit.overlaps(a["start"], a["end"]))
    counts = cards.select("lexeme_id", "sentence_id", met.alias("met")).select("lexeme_id", "sentence_id", F.size("met").alias("n"), F.size(F.filter("met", lambda a: a["decision"] == "expression")).alias("e"))
    # An occurrence has a row for each of its forms.
    return counts.filter("n > 0").groupBy("lexeme_id", "sentence_id").agg(F.sum("n").alias("n"), F.sum("e").alias("n_expressions"))


OVERLAPPING_ANALYSES = f"""WITH {_ANALYSES}, c AS (SELECT lexeme_id, sentence_id, instr(text, surface) - 1 AS s, length(surface) AS l FROM occ JOIN lines USING (sentence_id) WHERE instr(text, surface) > 0 AND surface <> '')
SELECT lexeme_id, c.sentence_id, count(*) AS n, count(*) FILTER (decision = 'expression') AS n_expressions FROM c JOIN ana a ON a.sentence_id = c.sentence_id AND a.start < s + l AND a."end" > s GROUP BY 1, 2"""

QUERIES = {
    "located_words": (located_words, LOCATED_WORDS),
    "learner_words": (learner_words, LEARNER_WORDS),
    "inflected_targets": (inflected_targets, INFLECTED_TARGETS),
    "expression_analyses": (expression_analyses, EXPRESSION_ANALYSES),
    "words_with_expressions": (words_with_expressions, WORDS_WITH_EXPRESSIONS),
    "overlapping_analyses": (overlapping_analyses, OVERLAPPING_ANALYSES),
}
