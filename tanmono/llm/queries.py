"""Queries of the training-data problems, by problem number, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tanmono.llm import alignment as p3
from tanmono.llm import copies as p2
from tanmono.llm import leaks as p7
from tanmono.llm import lookalikes as p1
from tanmono.llm import packing as p6
from tanmono.llm import spans as p8
from tanmono.llm import term_counts as p5
from tanmono.llm import top_items as p4
from tanmono.session import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = p1.lookalike_pairs(table(spark, sf_dir, "sentences"), "id", "japanese")
    lines = lines.select(
        F.lit("japanese").alias("field"), F.lit(0).cast("bigint").alias("lexeme_id"),
        F.col("key_a").cast("string").alias("key_a"), F.col("key_b").cast("string").alias("key_b"),
    )
    words = p1.lookalike_pairs(table(spark, sf_dir, "occurrences"), "surface", "surface", "lexeme_id")
    return lines.unionByName(words.select(F.lit("surface").alias("field"), F.col("scope").alias("lexeme_id"), "key_a", "key_b"))


def p1_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = p1.lookalike_forms(table(spark, sf_dir, "sentences"), "japanese")
    words = p1.lookalike_forms(table(spark, sf_dir, "occurrences"), "surface", "lexeme_id")
    both = lines.withColumn("field", F.lit("japanese")).unionByName(words.withColumn("field", F.lit("surface")))
    return both.select("field", F.col("scope").cast("bigint").alias("lexeme_id"), "form", "text", "n_rows", "n_forms")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2.copy_members(table(spark, sf_dir, "sentences"), "id", "japanese", "english")


def p2_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2.distinct_records(table(spark, sf_dir, "sentences"), "id", "japanese", "english")


def _aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "sentences").select(
        "id", F.col("source_id").alias("source"), F.col("cue_index").alias("cue"), F.col("start_ms").alias("start"),
        F.col("end_ms").alias("end"), F.col("japanese").alias("ja_text"), F.col("english").alias("en_text"),
    )
    return p3.translation_pairs(lines)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _aligned(spark, sf_dir)
    return pairs.select(F.least("ja", "en").alias("sentence_id_a"), F.greatest("ja", "en").alias("sentence_id_b"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = p4.top_per_group(table(spark, sf_dir, "source_queue"), "source_id", "lexeme_id", "rank_score", 20)
    return top.select(F.col("group_id").alias("source_id"), F.col("item_id").alias("lexeme_id"))


def _lemma_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    occurrences = table(spark, sf_dir, "occurrences").select("lexeme_id", "sentence_id", "surface", "count")
    lemmas = table(spark, sf_dir, "lexemes").select(F.col("id").alias("lexeme_id"), "lemma").distinct()
    rows = occurrences.join(lemmas, "lexeme_id")
    return p5.value_counts(rows, "sentence_id", "lemma", "count", ["lexeme_id", "surface"])


def _n_sentences(spark: SparkSession, sf_dir: str) -> int:
    return table(spark, sf_dir, "occurrences").select("sentence_id").distinct().count()


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = p5.marked(_lemma_counts(spark, sf_dir), _n_sentences(spark, sf_dir))
    marks = F.array_compact(F.array(F.when(F.col("rare"), F.lit("rare")), F.when(F.col("common"), F.lit("common"))))
    return counts.select(F.col("value").alias("lemma"), F.explode(marks).alias("mark"))


def p5_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every lemma with its total and its sentences, also those that never occur."""
    counts = p5.marked(_lemma_counts(spark, sf_dir), _n_sentences(spark, sf_dir))
    lemmas = table(spark, sf_dir, "lexemes").filter("lemma IS NOT NULL").select(F.col("lemma").alias("value")).distinct()
    filled = lemmas.join(counts, "value", "left").fillna(0, ["total", "records"]).fillna(False, ["rare", "common"])
    return filled.select(F.col("value").alias("lemma"), "total", F.col("records").alias("n_sentences"), "rare", "common")


def p5_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every run of up to three words of the English lines, words being what stands between blanks."""
    lines = table(spark, sf_dir, "sentences").select("id", "english").filter("english <> ''").distinct()
    counts = p5.ngram_counts(lines.select(F.split("english", " ").alias("words")), "words", 3)
    return counts.select(F.translate("ngram", p5.UNIT, " ").alias("ngram"), "n", "total", F.col("records").alias("n_sentences"))


def _packed(spark: SparkSession, sf_dir: str, search: bool = True) -> DataFrame:
    """Sizes by the byte-level tokenizer: a token a byte and one at the end."""
    docs = table(spark, sf_dir, "documents")
    known = docs.filter("n_tokens IS NOT NULL").select("doc_id", "n_tokens")
    counted = docs.filter("n_tokens IS NULL").select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("bigint").alias("n_tokens"))
    return p6.packed_documents(known.unionByName(counted), "doc_id", "n_tokens", table(spark, sf_dir, "context_windows"), "window_id", "capacity_tokens", search)


def p6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in its containers."""
    return _packed(spark, sf_dir).withColumnsRenamed({"window": "window_id", "capacity": "capacity_tokens", "container": "container_id", "id": "doc_id"})


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many containers the lower bound, the packing before the search and the result have."""
    report = p6.packing_report(_packed(spark, sf_dir), _packed(spark, sf_dir, False))
    return report.withColumnsRenamed({"window": "window_id", "capacity": "capacity_tokens"})


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = p7.leaked_passages(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "eval_items"), "item_id", "lang", "text")
    return found.select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8.sharing_pairs(table(spark, sf_dir, "documents"), "doc_id", "text").toDF("doc_id_a", "doc_id_b")


def p8_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fuzzy passages of documents with the representatives of what they share: bounds, equal characters, longest exact span."""
    found = p8.span_passages(table(spark, sf_dir, "documents"), "doc_id", "text")
    return found.select(F.col("a").alias("doc_id_a"), F.col("b").alias("doc_id_b"), "start_a", "end_a", "start_b", "end_b", "equal", "longest")


def p8_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8.shared_share(table(spark, sf_dir, "documents"), "doc_id", "text").withColumnRenamed("doc", "doc_id")


_CANONICAL = r"""
WITH texts AS (
  SELECT DISTINCT id,
         regexp_replace(lower(japanese), '[^\p{L}\p{N}\p{M}]|[\x{fe00}-\x{fe0f}\x{e0100}-\x{e01ef}]', '', 'g') AS a,
         regexp_replace(lower(english), '[^\p{L}\p{N}\p{M}]|[\x{fe00}-\x{fe0f}\x{e0100}-\x{e01ef}]', '', 'g') AS b
  FROM sentences WHERE japanese <> '' AND english <> ''),
groups AS (SELECT DISTINCT id, min(id) OVER (PARTITION BY least(a, b), greatest(a, b)) AS first_id FROM texts)
"""


_LEMMAS = """
WITH occ AS (SELECT DISTINCT lexeme_id, sentence_id, surface, coalesce(count, 1) AS count FROM occurrences),
counts AS (
  SELECT lemma, CAST(sum(count) AS BIGINT) AS total, count(DISTINCT sentence_id) AS n_sentences
  FROM occ JOIN (SELECT DISTINCT id, lemma FROM lexemes) ON id = lexeme_id GROUP BY lemma),
marked AS (
  SELECT *, total BETWEEN 1 AND 2 AS rare,
         n_sentences >= 0.03 * (SELECT count(DISTINCT sentence_id) FROM occurrences) AS common FROM counts)
"""


_WINDOWS = """
WITH starts AS (SELECT doc_id, text, unnest(range(1, length(text) - 238)) AS p FROM documents WHERE length(text) >= 240),
windows AS (SELECT doc_id, p, md5_number(substr(text, p, 240)) AS w FROM starts)
"""


def queries() -> dict[str, Query]:
    return {
        "p1_found": p1_found, "p1_forms": p1_forms,
        "p2_found": p2_found, "p2_records": p2_records,
        "p3_found": p3_found,
        "p4_found": p4_found,
        "p5_found": p5_found, "p5_counts": p5_counts, "p5_ngrams": p5_ngrams,
        "p6_packing": p6_packing, "p6_report": p6_report,
        "p7_found": p7_found,
        "p8_found": p8_found, "p8_shared": p8_shared, "p8_passages": p8_passages,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": _CANONICAL + "SELECT first_id, id AS copy_id FROM groups WHERE id <> first_id",
        "p2_records": _CANONICAL + "SELECT first_id, count(*) AS n_copies FROM groups GROUP BY first_id",
        "p4_found": """
            WITH pairs AS (SELECT source_id, lexeme_id, max(rank_score) AS s FROM source_queue
                           WHERE rank_score IS NOT NULL AND NOT isnan(rank_score) GROUP BY ALL)
            SELECT source_id, lexeme_id FROM pairs
            QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY s DESC, lexeme_id) <= 20""",
        "p8_found": _WINDOWS + """, held AS (SELECT DISTINCT doc_id, w FROM windows)
            SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM held a JOIN held b USING (w) WHERE a.doc_id < b.doc_id""",
        "p8_shared": _WINDOWS + """, common AS (SELECT w FROM windows GROUP BY w HAVING min(doc_id) < max(doc_id)),
            spots AS (SELECT doc_id, p, lead(p) OVER (PARTITION BY doc_id ORDER BY p) AS following FROM windows SEMI JOIN common USING (w)),
            sums AS (SELECT doc_id, sum(least(240, coalesce(following - p, 240))) AS n FROM spots GROUP BY doc_id)
            SELECT doc_id, coalesce(length(text), 0) AS n_chars, CAST(coalesce(n, 0) AS BIGINT) AS n_shared FROM documents LEFT JOIN sums USING (doc_id)""",
        "p5_ngrams": """
            WITH lines AS (SELECT DISTINCT id, string_split(english, ' ') AS w FROM sentences WHERE english <> ''),
            starts AS (SELECT id, w, unnest(range(1, len(w) + 1)) AS p FROM lines),
            grams AS (SELECT id, array_to_string(w[p : p + n - 1], ' ') AS ngram, n
                      FROM starts, (VALUES (1), (2), (3)) AS sizes(n) WHERE p + n - 1 <= len(w))
            SELECT ngram, n, count(*) AS total, count(DISTINCT id) AS n_sentences FROM grams GROUP BY ngram, n""",
        "p5_found": _LEMMAS + """SELECT lemma, 'rare' AS mark FROM marked WHERE rare
            UNION ALL SELECT lemma, 'common' FROM marked WHERE common""",
        "p5_counts": _LEMMAS + """SELECT DISTINCT l.lemma, coalesce(total, 0) AS total, coalesce(n_sentences, 0) AS n_sentences,
            coalesce(rare, false) AS rare, coalesce(common, false) AS common FROM lexemes l LEFT JOIN marked USING (lemma)""",
    }
