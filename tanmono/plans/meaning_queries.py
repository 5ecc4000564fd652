"""Queries on dictionary lookup, similarity and card audits, with their SQL.

The tables hold no dictionary, so entries, forms and senses are laid out from the lexemes' own dictionary columns; tags and usage marks
follow from the entry's number. Similarities that a text encoder would give are stood in for by ratios of the texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tanmono.functions import text as tx
from tanmono.operators import audit, dictionary, model, semantics
from tanmono.plans import sql
from tanmono.plans.text_queries import _ANAK, _KANA
from tanmono.session import table

#: Letters of the particles that stand inside phrases.
_IN_PHRASES = "はがをにへとでのもやか"
_TAGS = {0: ["ichi1"], 1: ["news1"], 2: ["spec2"], 3: ["nf40"], 4: []}
_SENSE_POS = {"名詞": "noun (common)", "代名詞": "pronoun", "動詞": "godan verb", "形容詞": "adjective (keiyoushi)", "副詞": "adverb (fukushi)", "感動詞": "interjection (kandoushi)"}


def dictionary_tables(lex: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = lex.filter("dictionary_entry_id IS NOT NULL").select(
        F.col("dictionary_entry_id").alias("entry_id"), F.coalesce("dictionary_sense_index", F.lit(0)).alias("sense_index"), "lemma", "reading", "part_of_speech", "gloss"
    )
    tags, usual = F.array().cast("array<string>"), F.col("entry_id") % 10 == 0
    for rest, names in _TAGS.items():
        tags = F.when(F.col("entry_id") % 5 == rest, F.array(*map(F.lit, names)).cast("array<string>")).otherwise(tags)
    pos = F.lit("")
    for name, text in _SENSE_POS.items():
        pos = F.when(F.col("part_of_speech") == name, text).otherwise(pos)
    entries = rows.select("entry_id").distinct().select("entry_id", tags.alias("tags"), usual.alias("kana_usual"))
    forms = rows.select("entry_id", F.lit("kanji").alias("kind"), F.col("lemma").alias("text"))
    forms = forms.unionByName(rows.select("entry_id", F.lit("kana").alias("kind"), tx.to_hiragana("reading").alias("text"))).distinct()
    senses = rows.filter("gloss <> ''").groupBy("entry_id", "sense_index").agg(F.max(pos).alias("sense_pos"), F.array_sort(F.collect_set("gloss")).alias("glosses"))
    return entries, forms, senses.withColumn("kana_usual", usual)


_POS_CASE = "CASE part_of_speech " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _SENSE_POS.items()) + " ELSE '' END"
_DICTIONARY = f"""
WITH {sql.MODEL},
d AS (SELECT dictionary_entry_id AS entry_id, coalesce(dictionary_sense_index, 0) AS sense_index, lemma, reading, part_of_speech, gloss FROM lex WHERE dictionary_entry_id IS NOT NULL),
entries AS (SELECT DISTINCT entry_id, CASE entry_id % 5 WHEN 0 THEN 0.9::DOUBLE WHEN 1 THEN 0.65::DOUBLE WHEN 2 THEN 0.4::DOUBLE WHEN 3 THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END AS prio,
                   entry_id % 10 = 0 AS usual FROM d),
forms AS (SELECT entry_id, 'kanji' AS kind, lemma AS text FROM d UNION SELECT entry_id, 'kana', translate(reading, {_KANA}) FROM d),
senses AS (SELECT entry_id, sense_index, max({_POS_CASE}) AS sense_pos, list_sort(list(DISTINCT gloss)) AS glosses FROM d WHERE gloss <> '' GROUP BY 1, 2)"""


def _words(text: str) -> str:
    stop = ", ".join(f"'{w}'" for w in tx.STOPWORDS)
    return f"list_distinct(list_filter(regexp_extract_all(lower({text}), '[a-z][a-z''-]+'), lambda w: w NOT IN ({stop})))"


def resolved_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    lex = model.lexemes(spark, sf_dir)
    contexts = model.translation_contexts(model.occurrences(spark, sf_dir), model.sentences(spark, sf_dir)).withColumnRenamed("lexeme_id", "id")
    words = lex.select("id", "lemma", "reading", F.col("part_of_speech").alias("pos")).join(contexts, "id", "left")
    return dictionary.resolve(words, *dictionary_tables(lex))


_HINTED = "CASE part_of_speech " + " ".join(
    f"WHEN '{name}' THEN {' OR '.join(f'''contains(sense_pos, '{h}')''' for h in hints)}" for name, hints in dictionary.POS_HINTS.items()
) + " ELSE false END"
RESOLVED_WORDS = _DICTIONARY + f""",
t AS (SELECT DISTINCT lexeme_id, english FROM occ JOIN sen ON id = sentence_id WHERE english <> ''),
c AS (SELECT lexeme_id, string_agg(english, ' ' ORDER BY english) AS context FROM (SELECT *, row_number() OVER (PARTITION BY lexeme_id ORDER BY english) AS k FROM t) WHERE k <= 5 GROUP BY 1),
ask AS (SELECT id, lemma, translate(reading, {_KANA}) AS kana, part_of_speech, {_words("coalesce(context, '')")} AS ctx FROM lex LEFT JOIN c ON lexeme_id = id),
met AS (SELECT id, entry_id, bool_or(text = lemma) AS spelt, bool_or(text = kana AND kind = 'kana') AS rd, bool_or(text = lemma AND kind = 'kana') AS in_kana
        FROM ask JOIN forms ON text = lemma OR text = kana GROUP BY 1, 2 HAVING spelt OR rd),
sc AS (SELECT id, entry_id, sense_index, array_to_string(glosses[:3], '; ') AS gloss, round(2.0::DOUBLE * CAST(spelt AS INTEGER) + CAST(rd AS INTEGER) + prio
          + CASE WHEN usual AND in_kana THEN 0.35::DOUBLE ELSE 0 END + CASE WHEN {_HINTED} THEN 0.55::DOUBLE ELSE 0 END
          + least(0.08::DOUBLE, len(list_intersect(ctx, {_words("array_to_string(glosses, ' ')")})) * 0.04::DOUBLE)
          + CASE WHEN usual AND in_kana THEN 0.10::DOUBLE ELSE 0 END - 0.20::DOUBLE * sense_index, 9) AS score
       FROM met JOIN entries USING (entry_id) JOIN senses USING (entry_id) JOIN ask USING (id)
       WHERE coalesce(part_of_speech, '') <> '感動詞' OR {_HINTED})
SELECT id, gloss, entry_id, sense_index, round(score, 3) AS confidence FROM sc QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, entry_id, sense_index) = 1"""


def expression_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of two to four English words that are some lexeme's gloss."""
    words = F.regexp_extract_all(F.lower("english"), F.lit("[a-z]+"), F.lit(0))
    lines = model.sentences(spark, sf_dir).select("id", words.alias("words"))
    return dictionary.word_ngrams(lines, "id", "words").join(_glosses(spark, sf_dir), "ngram", "left_semi").withColumnRenamed("key", "id")


def _glosses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.lexemes(spark, sf_dir).filter("gloss <> ''").select(F.regexp_replace(F.lower("gloss"), "^to ", "").alias("ngram")).distinct()


EXPRESSION_CANDIDATES = f"""
WITH {sql.MODEL}, w AS (SELECT id, regexp_extract_all(lower(english), '[a-z]+') AS words FROM sen),
g AS (SELECT DISTINCT regexp_replace(lower(gloss), '^to ', '') AS ngram FROM lex WHERE gloss <> ''),
r AS (SELECT id, words, n, unnest(range(0, len(words) - n + 1)) AS "at" FROM w, (VALUES (2), (3), (4)) v(n) WHERE len(words) >= n)
SELECT id, CAST("at" AS INTEGER) AS "at", n, array_to_string(words["at" + 1:"at" + n], ' ') AS ngram FROM r
WHERE array_to_string(words["at" + 1:"at" + n], ' ') IN (SELECT ngram FROM g)"""


def expressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs that a greedy reader takes, longest first."""
    found = expression_candidates(spark, sf_dir).withColumnRenamed("id", "key")
    return dictionary.expressions(found, _glosses(spark, sf_dir)).withColumnRenamed("key", "id")


def expression_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    lex = model.lexemes(spark, sf_dir)
    asked = lex.select(F.col("lemma").alias("surface"), "reading", F.col("lemma").rlike(f"[{_IN_PHRASES}]").alias("with_particle"))
    out = dictionary.expression_entries(asked, *dictionary_tables(lex))
    return out.select("surface", "reading", "entry_id", F.array_join("senses", " / ").alias("senses"))


EXPRESSION_ENTRIES = _DICTIONARY + f""",
ask AS (SELECT DISTINCT lemma AS surface, translate(reading, {_KANA}) AS kana, regexp_matches(lemma, '[{_IN_PHRASES}]') AS particle FROM lex),
kinds AS (SELECT entry_id, bool_or(contains(sense_pos, 'expressions (phrases') OR contains(sense_pos, 'interjection')) AS phrase FROM senses GROUP BY 1),
kanas AS (SELECT entry_id, list_sort(list(DISTINCT text)) AS kanas FROM forms WHERE kind = 'kana' GROUP BY 1),
met AS (SELECT surface, kana, entry_id, bool_or(kind = 'kanji') AS spelt FROM ask JOIN forms ON text = surface JOIN kinds USING (entry_id) LEFT JOIN kanas USING (entry_id)
        WHERE (kana = '' OR kanas IS NULL OR list_contains(kanas, kana)) AND (phrase OR particle) GROUP BY 1, 2, 3),
b AS (SELECT surface, kana, entry_id FROM met JOIN entries USING (entry_id)
      QUALIFY row_number() OVER (PARTITION BY surface, kana ORDER BY round(prio + CASE WHEN spelt THEN 0.25::DOUBLE ELSE 0 END, 6) DESC, entry_id) = 1),
s AS (SELECT entry_id, string_agg(sense, ' / ' ORDER BY pos) AS senses FROM (SELECT entry_id, array_to_string(glosses[:4], '; ') AS sense, min(sense_index) AS pos FROM senses GROUP BY 1, 2) GROUP BY 1)
SELECT surface, translate(CASE WHEN kana <> '' THEN kana WHEN kanas IS NULL OR list_contains(kanas, surface) THEN surface ELSE kanas[1] END, {_ANAK}) AS reading, b.entry_id, senses
FROM b LEFT JOIN s USING (entry_id) LEFT JOIN kanas USING (entry_id)"""


def nearest_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every vector whose id is divisible by 100."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    found = semantics.nearest(rows.filter("id % 100 = 0"), rows, 5)
    return found.withColumn("score", F.round("score", 6))


NEAREST_EMBEDDINGS = """
WITH p AS (SELECT q.vec_id AS query, r.vec_id AS id, round(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(r.embedding AS DOUBLE[])), 9) AS score
           FROM embeddings q, embeddings r WHERE q.vec_id % 100 = 0 AND q.vec_id <> r.vec_id)
SELECT query, id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS INTEGER) AS rank FROM p
QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, id) <= 5"""


def expression_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A translation, two phrase senses and the words' glosses, by four vectors that follow each other; labels tell what is of one kind."""
    rows = table(spark, sf_dir, "embeddings")
    part = lambda name, off: rows.select((F.col("vec_id") - off).alias("vec_id"), F.col("embedding").alias(name), F.col("label").alias(f"l_{name}"))
    met = part("english", 0).join(part("one", 1), "vec_id").join(part("two", 2), "vec_id").join(part("words", 3), "vec_id")
    near = lambda a, b: F.sqrt(F.greatest(F.round((1 + semantics.dot(F.col(a), F.col(b))) / 2, 9), F.lit(0.0)))
    best = F.greatest(F.struct(near("english", "one").alias("s"), near("one", "words").alias("w")), F.struct(near("english", "two").alias("s"), near("two", "words").alias("w")))
    kinds = F.size(F.array_distinct(F.array("l_one", "l_two", "l_words")))
    flags = [kinds.alias("n"), (F.col("l_one") == F.col("l_english")).alias("alone"), (F.col("l_two") == F.col("l_english")).alias("particle")]
    met = met.select("vec_id", best.alias("best"), near("english", "words").alias("component"), *flags)
    d = semantics.decide(F.col("best.s"), F.col("component"), F.col("best.w"), F.col("n"), F.col("alone"), F.col("particle"))
    return met.select("vec_id", d.alias("d")).select("vec_id", "d.*")


def _near(a: str, b: str) -> str:
    return f"sqrt(greatest(round((1 + list_dot_product(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))) / 2, 9), 0.0::DOUBLE))"


EXPRESSION_DECISIONS = f"""
WITH v AS (SELECT a.vec_id, a.embedding AS e, b.embedding AS o, c.embedding AS t, d.embedding AS w, len(list_distinct([b.label, c.label, d.label])) AS n, b.label = a.label AS alone, c.label = a.label AS particle FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1
           JOIN embeddings c ON c.vec_id = a.vec_id + 2 JOIN embeddings d ON d.vec_id = a.vec_id + 3),
m AS (SELECT vec_id, greatest(({_near("e", "o")}, {_near("o", "w")}), ({_near("e", "t")}, {_near("t", "w")})) AS best, {_near("e", "w")} AS comp, n, alone, particle FROM v),
s AS (SELECT *, best[1] AS phrase, best[1] - comp AS margin, CASE WHEN n > 1 THEN 1 - best[2] ELSE 1 END AS opacity FROM m)
SELECT vec_id, CASE WHEN n < 1 THEN 'insufficient_evidence'
  WHEN phrase >= 0.82::DOUBLE AND margin >= CASE WHEN n > 1 AND alone THEN 0.02::DOUBLE ELSE 0.04::DOUBLE END AND opacity >= CASE WHEN particle THEN 0.14::DOUBLE ELSE 0.16::DOUBLE END THEN 'expression'
  WHEN comp > phrase THEN 'components' ELSE 'ambiguous' END AS decision,
  CASE WHEN n < 1 THEN 0.0::DOUBLE ELSE round(margin, 6) END AS margin, CASE WHEN n < 1 THEN 0.0::DOUBLE ELSE round(opacity, 6) END AS opacity FROM s"""


def cache_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts to encode when the vectors of all aligned lines are in the cache."""
    lines = model.sentences(spark, sf_dir, "id", "japanese", "english").filter("english <> ''")
    texts = lines.select(F.lit("encoder").alias("model"), F.lit("query").alias("role"), F.col("english").alias("text"))
    cached = lines.filter("japanese <> ''").select(F.lit("encoder").alias("model"), F.lit("query").alias("role"), F.sha2("english", 256).alias("text_hash"))
    return semantics.cache_misses(texts, cached).select("role", "text_hash")


CACHE_MISSES = """SELECT DISTINCT 'query' AS role, sha256(english) AS text_hash FROM sentences WHERE english <> ''
AND english NOT IN (SELECT english FROM sentences WHERE japanese <> '' AND english <> '')"""


def votes(lex: DataFrame) -> DataFrame:
    """(id, status, decisive): every lexeme's reading against three readers of its lemma.

    These know the reading of the most frequent lexeme with that lemma, that of the first one, and this lexeme's own. Only a lemma with kanji
    has a span whose reading can be in doubt. A disagreement is decisive if both others agree on another reading.
    """
    rank = F.struct(F.coalesce("corpus_count", F.lit(0)).alias("n"), (-F.col("id")).alias("i"))
    both = lex.groupBy("lemma").agg(F.max_by("reading", rank).alias("often"), F.min_by("reading", "id").alias("first"))
    given = F.array(tx.to_katakana("often"), tx.to_katakana("first"), tx.to_katakana("reading"))
    status = semantics.reading_consensus(F.col("reading"), given, F.col("lemma").rlike(r"[\x{4e00}-\x{9fff}]"))
    decisive = (F.col("often") == F.col("first")) & (F.col("often") != F.col("reading"))
    return lex.join(both, "lemma").select("id", status.alias("status"), F.coalesce(decisive, F.lit(False)).alias("decisive"))


def reading_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return votes(model.lexemes(spark, sf_dir))


_VOTES = f"""
b AS (SELECT lemma, arg_max(reading, (coalesce(corpus_count, 0), -id)) AS o, arg_min(reading, id) AS f FROM lex GROUP BY 1),
v AS (SELECT id, lemma, translate(reading, {_ANAK}) AS want, coalesce(o = f AND o <> reading, false) AS decisive,
             list_filter([translate(o, {_ANAK}), translate(f, {_ANAK}), translate(reading, {_ANAK})], lambda x: x <> '') AS votes FROM lex JOIN b USING (lemma)),
votes AS (SELECT id, decisive, CASE WHEN NOT regexp_matches(lemma, '[\\x{{4e00}}-\\x{{9fff}}]') OR want = '' THEN 'unresolved'
  WHEN len(list_filter(votes, lambda x: x <> want)) > len(list_distinct(list_filter(votes, lambda x: x <> want))) THEN 'disagreement'
  WHEN list_contains(votes, want) THEN 'agreement' ELSE 'unresolved' END AS status FROM v)"""
READING_VOTES = f"WITH {sql.MODEL}, {_VOTES} SELECT id, status, decisive FROM votes"


QUERIES = {
    "resolved_words": (resolved_words, RESOLVED_WORDS),
    "expression_candidates": (expression_candidates, EXPRESSION_CANDIDATES),
    "expressions": (expressions, None),
    "expression_entries": (expression_entries, EXPRESSION_ENTRIES),
    "nearest_embeddings": (nearest_embeddings, NEAREST_EMBEDDINGS),
    "expression_decisions": (expression_decisions, EXPRESSION_DECISIONS),
    "cache_misses": (cache_misses, CACHE_MISSES),
    "reading_votes": (reading_votes, READING_VOTES),
}
