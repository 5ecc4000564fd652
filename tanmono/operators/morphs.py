"""Words of unspaced text in place: spans, readings in context, inflected forms, and expressions that stand for their parts.

An analyzer is any function text -> [{surface, lemma, reading, pos, start, end}]; script_runs() is the one that needs no dictionary.
Morphs are rows (sentence_id, position, surface, lemma, reading, pos, start, end), spans in code points from 0.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tanmono.functions.text import to_katakana
from tanmono.operators.semantics import decide
from tanmono.operators.tokens import CONTENT_POS, TOKEN, analyzed_lines, analyzed_texts, content_words, located, single_words
from tanmono.plans.storage import materialize

#: Words of the default analyzer, as of tokens.WORD: runs of kanji, of katakana, of hiragana, of Latin letters and digits.
_RUN = re.compile("[一-鿿々]+|[ァ-ヺー・]+|([ぁ-ゖ]+)|[0-9A-Za-zà-ÿÀ-ß]+")
#: Case and topic particles.
PARTICLES = ["は", "が", "を", "に", "へ", "と", "で", "の", "も", "や", "か", "から", "まで", "より"]
#: What may follow the interrogative when it is read ナニ.
AFTER_NANI = ["が", "を", "も", "に", "へ", "から", "まで", "か"]
SENTENCE_END = "。？！?!"
#: Classes of words that never belong to an expression, that inflect the word before, and that an expression is.
PUNCTUATION, AUXILIARY, PARTICLE, EXPRESSION = "補助記号", "助動詞", "助詞", "表現"
#: Words of an expression.
LEAST_WORDS, MOST_WORDS = 2, 4
_SCRIPT = r"[\x{3040}-\x{30ff}\x{3400}-\x{9fff}]"
_JAPANESE = re.compile("[\u3040-\u30ff\u3400-\u9fff]")
#: Bits of the filter of a lexicon's surfaces, 8 MB whatever its size; what passes it by chance is left out by the join.
FILTER_BITS = 26
_ENDED = T.StructType([*TOKEN.fields, T.StructField("inflected_end", T.IntegerType())])
_RUNS = T.StructType([
    *(T.StructField(c, T.IntegerType()) for c in ("position", "n", "start", "end")), T.StructField("surface", T.StringType()),
    T.StructField("with_particle", T.BooleanType()), T.StructField("parts", T.ArrayType(T.StringType())),
])


def script_runs(text: str) -> list[dict]:
    """Runs of one script as words: a hiragana run is a particle, the ending of the word that it touches, or an adverb."""
    out, last = [], None
    for run in _RUN.finditer(text):
        surface = run[0]
        pos = "名詞" if not run[1] else PARTICLE if surface in PARTICLES else AUXILIARY if last == run.start() else "副詞"
        out.append({"surface": surface, "lemma": surface.lower(), "reading": surface.lower(), "pos": pos, "start": run.start(), "end": run.end()})
        last = run.end()
    return out


def plain_analyzer(cut: Callable[[str], list[dict]]) -> Callable[[str], list[dict]]:
    """An analyzer from cut(text) -> [{surface, ...}], which knows no places: each surface is looked for after the one before.

    What cut leaves out is filled in: the surface is lemma and reading, the class is unknown.
    """

    def analyze(text: str) -> list[dict]:
        words = cut(text)
        spans = located([w["surface"] for w in words], text)
        return [{"lemma": w["surface"], "reading": w["surface"], "pos": ""} | w | {"start": a, "end": b} for w, (a, b) in zip(words, spans, strict=True)]

    return analyze


def contextual(rows: DataFrame, text: str) -> DataFrame:
    """Morphs with a column of their sentence's text; two words are read by what follows them.

    The adjective いい before たい is the verb "say"; 何 is ナニ at the end, before the end of a sentence, and before case particles.
    """
    word = F.struct("lemma", "reading", "pos", "end")
    return rows.withColumns(_in_context(F.col(text), word))


def _in_context(text: Column, word: Column) -> dict[str, Column]:
    """lemma, pos and reading of a word(lemma, reading, pos, end) by what follows it in the text."""
    rest = F.substr(text, word["end"] + 1, F.char_length(text))
    bare = F.ltrim(rest)
    says = (word["lemma"] == "いい") & (word["reading"] == "イイ") & rest.startswith("たい")
    nani = (bare == "") | F.contains(F.lit(SENTENCE_END), F.substring(bare, 1, 1))
    for mark in AFTER_NANI:
        nani = nani | bare.startswith(mark)
    nani = (word["lemma"] == "何") & (word["reading"] == "ナン") & nani
    return {
        "lemma": F.when(says, "いう").otherwise(word["lemma"]), "pos": F.when(says, "動詞").otherwise(word["pos"]),
        "reading": F.when(says, "イウ").when(nani, "ナニ").otherwise(word["reading"]),
    }


def morphs(lines: DataFrame, key: str, text: str, analyze: Callable[[str], list[dict]] = script_runs) -> DataFrame:
    """Morphs of lines, readings in katakana and in context; nothing is shuffled, as a line's words carry their text."""
    rows = analyzed_texts(lines, key, text, analyze).withColumn("reading", to_katakana("reading"))
    return contextual(rows, "text").drop("text")


def endings(rows: DataFrame) -> DataFrame:
    """Morphs with inflected_end: where the auxiliaries that touch a word, one after the other, end."""
    order = Window.partitionBy("sentence_id").orderBy("position")
    goes_on = (F.lead("start").over(order) == F.col("end")) & (F.lead("pos").over(order) == AUXILIARY)
    stop = F.when(~F.coalesce(goes_on, F.lit(False)), F.col("end"))
    return rows.withColumn("_stop", stop).withColumn("inflected_end", F.min("_stop").over(order.rowsBetween(0, Window.unboundedFollowing))).drop("_stop")


def inflected_spans(targets: DataFrame, rows: DataFrame, lines: DataFrame) -> DataFrame:
    """targets(sentence_id, lemma, reading, surface) with start and end of the word and the auxiliaries that inflect it, nulls if not found.

    The first morph with this lemma, reading and surface counts. A word in dictionary form may also be found as plain text
    in lines(sentence_id, text).
    """
    identity = ["sentence_id", "lemma", "reading", "surface"]
    first = endings(rows).groupBy(*identity).agg(F.min_by(F.struct("start", F.col("inflected_end").alias("end")), "position").alias("span"))
    met = targets.join(first, identity, "left").join(lines.select("sentence_id", F.col("text").alias("_text")), "sentence_id", "left")
    at = F.when(F.col("surface") == F.col("lemma"), F.nullif(F.position(F.col("surface"), F.col("_text")), F.lit(0)) - 1)
    start = F.coalesce("span.start", at)
    return met.select(*targets.columns, start.alias("start"), F.coalesce("span.end", start + F.char_length("surface")).alias("end"))


def ended(words: list[dict]) -> list[dict]:
    """An analyzer's words with inflected_end, as of endings()."""
    out, after, stop = [], None, None
    for word in reversed(words):
        goes_on = after is not None and after["start"] == word["end"] and after["pos"] == AUXILIARY
        stop = stop if goes_on else word["end"] if stop is None else min(stop, word["end"])
        out.append(word | {"inflected_end": stop})
        after = word
    return out[::-1]


def inflected_targets(targets: DataFrame, lines: DataFrame, reading: Callable[[Column], Column], analyze: Callable[[str], list[dict]] = script_runs) -> DataFrame:
    """inflected_spans() of the targets(sentence_id, lemma, surface) of lines(sentence_id, text); reading(surface) is the one that is asked for.

    A line meets all its targets before it is analyzed, so its words are an array beside them and never rows that are shuffled. Targets
    without a line are left out.
    """
    rest = [c for c in targets.columns if c != "sentence_id"]
    asked = targets.groupBy("sentence_id").agg(F.collect_list(F.struct(*rest)).alias("targets"))
    met = lines.select("sentence_id", "text").join(asked, "sentence_id")
    met = analyzed_lines(met, "sentence_id", "text", lambda text: ended(analyze(text)), ("targets",), _ENDED)

    def word(t: Column) -> Column:
        plain = F.struct(t["lemma"].alias("lemma"), to_katakana(t["reading"]).alias("reading"), t["pos"].alias("pos"), t["end"].alias("end"))
        read = _in_context(F.col("text"), plain)
        return F.struct(read["lemma"].alias("lemma"), read["reading"].alias("reading"), *(t[c].alias(c) for c in ("surface", "start", "inflected_end")))

    met = met.select("sentence_id", "text", "targets", F.transform("tokens", word).alias("words"))
    met = met.select("sentence_id", "text", "words", F.explode("targets").alias("t")).select("sentence_id", "text", "words", "t.*")
    same = lambda w: (w["surface"] == F.col("surface")) & (w["lemma"] == F.col("lemma")) & (w["reading"] == reading(F.col("surface")))
    met = met.withColumn("_span", F.get(F.filter("words", same), F.lit(0)))
    at = F.when(F.col("surface") == F.col("lemma"), F.nullif(F.position(F.col("surface"), F.col("text")), F.lit(0)) - 1)
    start = F.coalesce(F.col("_span.start"), at)
    return met.select(*targets.columns, start.alias("start"), F.coalesce(F.col("_span.inflected_end"), start + F.char_length("surface")).alias("end"))


def span_reading(tokens: Column, start: Column, end: Column) -> Column:
    """Reading in katakana of the tokens, an array of (start, end, reading), that fill a span exactly; null if none do."""
    inside = F.filter(tokens, lambda t: (t["start"] >= start) & (t["end"] <= end))
    fits = (F.element_at(inside, 1)["start"] == start) & (F.element_at(inside, -1)["end"] == end)
    length = F.aggregate(inside, F.lit(0).cast("long"), lambda n, t: n + t["end"] - t["start"])
    whole = (F.size(inside) > 0) & (length == end - start)
    return F.when(whole, F.when(fits, F.nullif(to_katakana(F.array_join(F.transform(inside, lambda t: t["reading"]), "")), F.lit(""))))


def nth_reading(nodes: list[tuple[str, str]], text: str, start: int, end: int, most: int = 6) -> str | None:
    """Reading of text[start:end] by an analyzer whose nodes (surface, reading) may differ from the text.

    The target is the n-th occurrence of its letters in the text, so the n-th run of up to most nodes that spells it is taken.
    """
    target, found = text[start:end], []
    for first in range(len(nodes) if target else 0):
        surface = ""
        for last in range(first, min(len(nodes), first + most)):
            surface += nodes[last][0]
            if len(surface) >= len(target):
                found += ["".join(r for _, r in nodes[first : last + 1])] * (surface == target)
                break
    n = text[:start].count(target) if target else 0
    return (found[n] or None) if n < len(found) else None


def node_readings(rows: DataFrame, nodes: Callable[[str], list[tuple[str, str]]]) -> Column:
    """nth_reading() over rows with text, start and end, in katakana, by a language pack's nodes()."""

    @F.pandas_udf(T.StringType())
    def read(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for text, start, end in parts:
            yield pd.Series([nth_reading(nodes(t), t, int(a), int(b)) if t and pd.notna(a) and pd.notna(b) else None for t, a, b in zip(text, start, end, strict=True)])

    return to_katakana(read(rows["text"], rows["start"], rows["end"]))


def component_tokens(rows: DataFrame) -> DataFrame:
    """The morphs that are words to learn, by their position among all morphs; proper nouns (pos2) are none."""
    rows = rows.filter("NOT (pos = '名詞' AND pos2 <=> '固有名詞')") if "pos2" in rows.columns else rows
    return content_words(rows)


def expression_candidates(rows: DataFrame, lines: DataFrame) -> DataFrame:
    """(sentence_id, position, n, start, end, surface, with_particle): runs of neighbouring morphs that may be an expression.

    No punctuation is in them, they touch, one has content, and some letter is Japanese. Runs come from leads over a sentence, so a
    sentence is sorted once.
    """
    order = Window.partitionBy("sentence_id").orderBy("position")
    fields = ("start", "end", "pos")
    ahead = {f"{f}{k}": F.lead(f, k).over(order) for k in range(1, MOST_WORDS) for f in fields}
    met = rows.select("sentence_id", "position", *(F.col(f).alias(f"{f}0") for f in fields), *(c.alias(n) for n, c in ahead.items()))
    runs = []
    for n in range(LEAST_WORDS, MOST_WORDS + 1):
        kinds = F.array(*(F.col(f"pos{k}") for k in range(n)))
        touch = F.col("start1") == F.col("end0")
        for k in range(2, n):
            touch = touch & (F.col(f"start{k}") == F.col(f"end{k - 1}"))
        content = F.exists(kinds, lambda p: p.isin(CONTENT_POS))
        fits = F.coalesce(touch & content & ~F.array_contains(kinds, PUNCTUATION), F.lit(False))
        run = F.struct(F.lit(n).alias("n"), F.col("start0").alias("start"), F.col(f"end{n - 1}").alias("end"), F.array_contains(kinds, PARTICLE).alias("with_particle"))
        runs.append(F.when(fits, run))
    met = met.select("sentence_id", "position", F.explode(F.array_compact(F.array(*runs))).alias("r")).select("sentence_id", "position", "r.*")
    met = met.join(lines.select("sentence_id", "text"), "sentence_id")
    surface = F.substr(F.col("text"), F.col("start") + 1, F.col("end") - F.col("start"))
    return met.select("sentence_id", "position", "n", "start", "end", surface.alias("surface"), "with_particle").filter(F.col("surface").rlike(_SCRIPT))


def likeness(a: Column, b: Column) -> Column:
    """Share of the shorter set of words that the other holds, 0 if one is empty: a stand-in for vectors where none are at hand."""
    shared = F.size(F.array_intersect(a, b))
    return F.coalesce(F.try_divide(shared.cast("double"), F.least(F.size(a), F.size(b))), F.lit(0.0))


def analyses(candidates: DataFrame, lexicon: DataFrame, parts: DataFrame, lines: DataFrame, words: Callable[[Column], Column],
             analyze: Callable[[str], list[dict]] = script_runs, similar: Callable[[Column, Column], Column] = likeness) -> DataFrame:
    """Candidates that lexicon(surface, lemma, reading, gloss) holds, with lemma, reading, gloss, decision, margin and opacity.

    A surface that is one word when it stands alone is no candidate; the lexicon's are looked at, each once, not the candidates'. The decision weighs the translation in lines(sentence_id,
    text, english) against the phrase's gloss and against those of its parts(sentence_id, position, gloss).
    """
    several = lexicon.join(single_words(lexicon, analyze), "surface", "left_anti")
    known = materialize(candidates.join(several, "surface"), "known")
    inside = parts.select("sentence_id", F.col("position").alias("_p"), F.col("gloss").alias("_g"))
    span = (F.col("_p") >= F.col("position")) & (F.col("_p") < F.col("position") + F.col("n"))
    own = known.select("sentence_id", "position", "n").join(inside, "sentence_id").filter(span)
    own = own.groupBy("sentence_id", "position", "n").agg(F.array_sort(F.collect_list(F.struct("_p", "_g"))).alias("_parts"))
    met = known.join(own, ["sentence_id", "position", "n"], "left").join(lines.select("sentence_id", "text", "english"), "sentence_id")
    met = met.withColumn("_glosses", F.transform(F.coalesce("_parts", F.array()), lambda x: x["_g"]))
    return _decided(met, words, similar).select(*candidates.columns, "lemma", "reading", "gloss", "decision", "margin", "opacity")


def _decided(met: DataFrame, words: Callable[[Column], Column], similar: Callable[[Column, Column], Column]) -> DataFrame:
    """Candidates with text, english, gloss and the _glosses of their parts, with decision, margin and opacity."""
    alone = F.regexp_replace("text", rf"^[\s{SENTENCE_END}、…]+|[\s{SENTENCE_END}、…]+$", "") == F.col("surface")
    met = met.withColumns({"_e": words(F.coalesce("english", F.lit(""))), "_f": words(F.col("gloss")), "_c": words(F.array_join("_glosses", " "))})
    phrase, component, like = similar(F.col("_e"), F.col("_f")), similar(F.col("_e"), F.col("_c")), similar(F.col("_f"), F.col("_c"))
    return met.withColumn("d", decide(phrase, component, like, F.size("_glosses"), alone, F.col("with_particle"))).select("*", "d.*")


def _bit(surface: str) -> int:
    return zlib.crc32(surface.encode("utf-8", "surrogatepass")) >> (32 - FILTER_BITS)


def surface_filter(lexicon: DataFrame) -> np.ndarray:
    """A bit for each surface of the lexicon; at most 2 ** (FILTER_BITS - 6) words come to the driver."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.array([_bit(x) for x in batch.column(0).to_pylist() if x is not None], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array((np.uint64(1) << (at & 63).astype(np.uint64)).view(np.int64))], ["word", "bit"])

    rows = lexicon.select("surface").mapInArrow(words, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(2 ** (FILTER_BITS - 6), np.uint64)
    out[rows.column("word").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return out


def runs_of_words(text: str, analyze: Callable[[str], list[dict]], bits: np.ndarray) -> list[dict]:
    """expression_candidates() of one text whose surface passes the filter, with the surfaces of the words to learn in them."""
    words, out, held = analyze(text), [], memoryview(bits)
    content = [w["pos"] in CONTENT_POS for w in words]
    for first in range(len(words)):
        for last in range(first, min(first + MOST_WORDS, len(words))):
            if words[last]["pos"] == PUNCTUATION or (last > first and words[last]["start"] != words[last - 1]["end"]):
                break
            n = last - first + 1
            if n < LEAST_WORDS or not any(content[first : last + 1]):
                continue
            surface = text[words[first]["start"] : words[last]["end"]]
            bit = _bit(surface)
            if held[bit >> 6] >> (bit & 63) & 1 and _JAPANESE.search(surface):
                run = words[first : last + 1]
                parts = [w["surface"] for w, c in zip(run, content[first : last + 1], strict=True) if c and _JAPANESE.search(w["surface"])]
                particle = any(w["pos"] == PARTICLE for w in run)
                out.append({"position": first, "n": n, "start": words[first]["start"], "end": words[last]["end"], "surface": surface, "with_particle": particle, "parts": parts})
    return out


def line_analyses(lines: DataFrame, lexicon: DataFrame, words: Callable[[Column], Column],
                  analyze: Callable[[str], list[dict]] = script_runs, similar: Callable[[Column, Column], Column] = likeness) -> DataFrame:
    """analyses() of lines(sentence_id, text, english), where a part has the gloss that the lexicon gives its surface, else the surface.

    Runs of words are looked for while a line is analyzed and leave Python only if a filter of the lexicon's surfaces lets them pass, so neither
    words nor other runs are shuffled. Glosses are met once for each distinct run, not for each place.
    """
    several = materialize(lexicon.join(single_words(lexicon, analyze), "surface", "left_anti"), "several")
    found = analyzed_lines(lines, "sentence_id", "text", partial(runs_of_words, analyze=analyze, bits=surface_filter(several)), ("english",), _RUNS)
    found = found.select("sentence_id", "text", "english", F.explode("tokens").alias("r")).select("sentence_id", "text", "english", "r.*")
    found = materialize(found, "runs")
    phrases = found.select("surface", "parts").distinct().join(several, "surface")
    glossed = phrases.select("surface", "parts", F.posexplode("parts").alias("_p", "_part")).join(lexicon.select(F.col("surface").alias("_part"), F.col("gloss").alias("_g")), "_part", "left")
    glossed = glossed.groupBy("surface", "parts").agg(F.array_sort(F.collect_list(F.struct("_p", F.coalesce("_g", "_part").alias("_g")))).alias("_parts"))
    phrases = phrases.join(glossed, ["surface", "parts"], "left").withColumn("_glosses", F.transform(F.coalesce("_parts", F.array()), lambda x: x["_g"]))
    met = _decided(found.join(phrases.drop("_parts"), ["surface", "parts"]), words, similar)
    return met.select("sentence_id", "position", "n", "start", "end", "surface", "with_particle", "lemma", "reading", "gloss", "decision", "margin", "opacity")


def taken_runs(rows: DataFrame) -> DataFrame:
    """(sentence_id, taken): the runs that selected() takes, an array of (position, n, start, end, surface, lemma, reading) for each sentence."""
    fields = ("position", "less", "n", "start", "end", "surface", "lemma", "reading")
    run = F.struct(*((-F.col("n")).alias(c) if c == "less" else F.col(c) for c in fields))
    lists = rows.filter("decision = 'expression'").groupBy("sentence_id").agg(F.array_sort(F.collect_list(run)).alias("runs"))
    marked = F.transform("runs", lambda r: F.struct(r["position"].alias("position"), r["less"].alias("less"), F.lit(True).alias("accepted")))
    pairs = F.filter(F.arrays_zip(F.col("runs").alias("run"), _taken(marked).alias("is")), lambda x: x["is"])
    return lists.select("sentence_id", F.transform(pairs, lambda x: x["run"]).alias("taken"))


def lines_with_expressions(lines: DataFrame, taken: DataFrame, analyze: Callable[[str], list[dict]] = script_runs) -> DataFrame:
    """with_expressions() of lines(sentence_id, text) and taken_runs(): a line meets its expressions before it is analyzed."""
    columns = ["sentence_id", "position", "surface", "lemma", "reading", "pos", "start", "end"]
    met = analyzed_lines(lines.select("sentence_id", "text").join(taken, "sentence_id", "left"), "sentence_id", "text", analyze, ("taken",))
    rows = met.select("sentence_id", "text", "taken", F.posexplode("tokens").alias("position", "t")).select("sentence_id", "text", "taken", "position", "t.*")
    rows = contextual(rows.withColumn("reading", to_katakana("reading")), "text")
    inside = F.exists("taken", lambda r: (F.col("position") >= r["position"]) & (F.col("position") < r["position"] + r["n"]))
    plain = component_tokens(rows).filter(~F.coalesce(inside, F.lit(False))).select(columns)
    whole = taken.select("sentence_id", F.explode("taken").alias("r")).select("sentence_id", "r.*").withColumn("pos", F.lit(EXPRESSION))
    return plain.unionByName(whole.select(columns))


@F.pandas_udf(T.ArrayType(T.BooleanType()))
def _taken(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in parts:
        out = []
        for runs in part:
            free, taken = 0, []
            for run in runs:  # by position, the longest first
                fits = run["accepted"] and run["position"] >= free
                taken.append(fits)
                free = run["position"] - run["less"] if fits else free
            out.append(taken)
        yield pd.Series(out)


def selected(rows: DataFrame) -> DataFrame:
    """analyses() with taken: whether a reader who goes from the left and tries the longest run first takes it as an expression.

    Inside a taken run nothing else is looked at; such rows are left out.
    """
    run = F.struct("position", (-F.col("n")).alias("less"), (F.col("decision") == "expression").alias("accepted"), F.struct("*").alias("row"))
    lists = rows.groupBy("sentence_id").agg(F.array_sort(F.collect_list(run)).alias("runs"))
    marked = lists.select("runs", _taken(F.transform("runs", lambda r: F.struct(r["position"].alias("position"), r["less"].alias("less"), r["accepted"].alias("accepted")))).alias("taken"))
    met = marked.select(F.explode(F.arrays_zip(F.col("runs.row").alias("row"), "taken")).alias("x")).select("x.row.*", "x.taken")
    claims = met.filter("taken").select("sentence_id", F.col("position").alias("_a"), (F.col("position") + F.col("n")).alias("_b"))
    hidden = met.join(claims, "sentence_id").filter("position >= _a AND position < _b AND NOT taken AND NOT (position = _a AND position + n > _b)")
    return met.join(hidden.select("sentence_id", "position", "n").distinct(), ["sentence_id", "position", "n"], "left_anti")


def with_expressions(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """Tokens (sentence_id, position, surface, lemma, reading, pos, start, end): taken expressions, and the words that are in none."""
    taken = chosen.filter("taken")
    claims = taken.select("sentence_id", F.explode(F.sequence("position", F.col("position") + F.col("n") - 1)).alias("position"))
    columns = ["sentence_id", "position", "surface", "lemma", "reading", "pos", "start", "end"]
    plain = component_tokens(rows).join(claims, ["sentence_id", "position"], "left_anti").select(columns)
    return plain.unionByName(taken.withColumn("pos", F.lit(EXPRESSION)).select(columns))
