"""Text to tokens. The default analyzer takes runs of one script as words; language packs plug in with the same columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tanmono.functions.text import to_katakana

#: Parts of speech that carry content.
CONTENT_POS = ["名詞", "代名詞", "動詞", "形容詞", "形状詞", "副詞", "連体詞", "感動詞"]
#: Words of the default analyzer: runs of kanji, of katakana, of hiragana, of Latin letters and digits.
WORD = r"[\x{4e00}-\x{9fff}々]+|[ァ-ヺー・]+|[ぁ-ゖ]+|[0-9A-Za-zà-ÿÀ-ß]+"
TOKEN = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("surface", "lemma", "reading", "pos")] + [T.StructField(c, T.IntegerType()) for c in ("start", "end")]
)

#: Lines that are analyzed before their tokens are handed on.
TEXTS_AT_ONCE = 2_000


def default_tokens(lines: DataFrame, key: str, text: str) -> DataFrame:
    """(sentence_id, position, surface, lemma, reading, pos), position from 0; no Python is involved."""
    words = F.regexp_extract_all(F.col(text), F.lit(WORD), F.lit(0))
    rows = lines.select(F.col(key).alias("sentence_id"), F.posexplode(words).alias("position", "surface"))
    lemma = F.lower("surface")
    return rows.select("sentence_id", "position", "surface", lemma.alias("lemma"), to_katakana(lemma).alias("reading"), F.lit("名詞").alias("pos"))


def analyzed_lines(lines: DataFrame, key: str, text: str, analyze: Callable[[str], list[dict]], keep: tuple[str, ...] = (), kind: T.StructType = TOKEN) -> DataFrame:
    """(sentence_id, text, *keep, tokens): lines with the array of what a language pack's analyze(text) gives, of fields as in kind.

    No text is shuffled and none is read twice: a line's tokens leave Python beside the line, TEXTS_AT_ONCE lines at a time, and
    each distinct text among these is analyzed once. As a map over Arrow batches it is not repeated by what later steps filter.
    """
    rows = lines.select(F.col(key).alias("sentence_id"), F.col(text).alias("text"), *keep)
    schema = T.StructType([*rows.schema.fields, T.StructField("tokens", T.ArrayType(kind))])
    array, columns = to_arrow_type(schema["tokens"].dataType), schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, TEXTS_AT_ONCE):
                batch = whole.slice(first, TEXTS_AT_ONCE)
                texts = [x or "" for x in batch.column(1).to_pylist()]
                known = {x: analyze(x) for x in dict.fromkeys(texts)}
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([known[x] for x in texts], array)], columns)

    return rows.mapInArrow(run, schema)


def analyzed_texts(lines: DataFrame, key: str, text: str, analyze: Callable[[str], list[dict]]) -> DataFrame:
    """(sentence_id, text, position, surface, lemma, reading, pos, start, end): the tokens of analyzed_lines() as rows, with their text."""
    rows = analyzed_lines(lines, key, text, analyze)
    return rows.select("sentence_id", "text", F.posexplode("tokens").alias("position", "t")).select("sentence_id", "text", "position", "t.*")


def analyzed(lines: DataFrame, key: str, text: str, analyze: Callable[[str], list[dict]]) -> DataFrame:
    """Tokens of a language pack's analyze(text) -> [{surface, lemma, reading, pos, start, end}], over Arrow batches."""
    return analyzed_texts(lines, key, text, analyze).drop("text")


def content_words(tokens: DataFrame) -> DataFrame:
    """Tokens with content that hold Japanese script; proper nouns are for the analyzer to mark as other parts of speech."""
    return tokens.filter(F.col("pos").isin(CONTENT_POS) & F.col("surface").rlike(r"[\x{3040}-\x{30ff}\x{3400}-\x{9fff}]"))


def token_counts(tokens: DataFrame) -> DataFrame:
    """(sentence_id, lexeme_key, surface, n): occurrences of each form of each word in each sentence."""
    key = F.substring(F.sha2(F.concat_ws("\x1f", "lemma", "reading"), 256), 1, 24).alias("lexeme_key")
    return tokens.groupBy("sentence_id", key, "surface").agg(F.count("*").alias("n"))


def literal_span(sentence: Column, target: Column) -> tuple[Column, Column]:
    """Start and end, in code points from 0, of the first literal occurrence; nulls if there is none."""
    at = F.position(target, sentence)
    start = F.when((at > 0) & (F.char_length(target) > 0), at - 1)
    return start, start + F.char_length(target)


def target_span(sentence: Column, lexical_start: Column, lexical_end: Column, start: Column, end: Column, surface: Column) -> Column:
    """struct(target, start, end) that a learner sees: the lexical span if it lies in the sentence, else the stored one."""
    lexical = (lexical_start >= 0) & (lexical_start < lexical_end) & (lexical_end <= F.char_length(sentence))
    own = F.struct(F.substr(sentence, lexical_start + 1, lexical_end - lexical_start).alias("target"), lexical_start.alias("start"), lexical_end.alias("end"))
    return F.when(F.coalesce(lexical, F.lit(False)), own).otherwise(F.struct(surface.alias("target"), start.alias("start"), end.alias("end")))


def located(surfaces: list[str], text: str) -> list[tuple[int, int]]:
    """Spans of an analyzer's surfaces in its text, each searched from the end of the one before, else from the start.

    A surface that the text does not hold gets an empty span where the search stood.
    """
    out, at = [], 0
    for surface in surfaces:
        start = text.find(surface, at)
        start = text.find(surface) if start < 0 else start
        start, end = (start, start + len(surface)) if start >= 0 else (at, at)
        out.append((start, end))
        at = max(at, end)
    return out


def dictionary_forms(tokens: DataFrame, forms: DataFrame, first: str, second: str) -> DataFrame:
    """tokens with lemma: the first form, unless only the second stands in the dictionary's forms(text)."""
    known = forms.select("text").distinct()
    one = known.select(F.col("text").alias("_one"), F.lit(True).alias("_has_one"))
    two = known.select(F.col("text").alias("_two"), F.lit(True).alias("_has_two"))
    rows = tokens.join(one, F.col(first) == F.col("_one"), "left").join(two, F.col(second) == F.col("_two"), "left")
    lemma = F.when(F.col("_has_one").isNull() & F.col("_has_two").isNotNull(), F.col(second)).otherwise(F.col(first))
    return rows.withColumn("lemma", lemma).drop("_one", "_two", "_has_one", "_has_two")


def single_words(surfaces: DataFrame, analyze: Callable[[str], list[dict]]) -> DataFrame:
    """(surface) of surfaces(surface) that are one word when analyzed alone; each distinct one is analyzed once.

    The function is marked so that the optimizer does not move it to the rows below the distinct ones.
    """

    @F.pandas_udf(T.IntegerType())
    def n_words(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield part.map(lambda x: sum(any(c.isalnum() for c in t["surface"]) for t in analyze(x or "")))

    return surfaces.select("surface").distinct().withColumn("n", n_words.asNondeterministic()("surface")).filter("n = 1").select("surface")
