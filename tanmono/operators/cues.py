"""Timed cues: continuation merging, interval overlap, and alignment of two tracks by time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tanmono.functions.text import BLANKS
from tanmono.operators.ordered import with_island, with_previous

#: Cues of a source that one window sees at a time.
CHUNK = 2_000
#: Marks at the end of a cue that goes on, and the end of a finished English sentence.
CONTINUES, FINISHED = r"[,;:—\-…]$", r"""[.!?]["”’)]*$"""


def _rstrip(text: Column) -> Column:
    return F.regexp_replace(text, f"{BLANKS}+$", "")


def merge_continuations(cues: DataFrame, max_gap_ms: int = 500) -> DataFrame:
    """(source, cue, start, end, text, n_cues) from cues(source, cue, start, end, text).

    A cue whose text ends with an arrow goes on in the next one if that starts within max_gap_ms; the arrow goes, the texts are
    joined, index and start are the first cue's, the end is the last one's. An arrow on the last cue stays.
    """
    chunk = F.expr(f"cue div {CHUNK}")
    rows = with_previous(cues, ["source"], ["cue"], chunk, ["end", "text"])
    goes_on = _rstrip(F.col("prev.text")).endswith("→") & (F.col("start") - F.col("prev.end") <= max_gap_ms)
    rows = rows.withColumn("new", ~F.coalesce(goes_on, F.lit(False)))
    rows = with_island(rows, ["source"], ["cue"], chunk, F.col("new"), "cue")
    parts = rows.groupBy("source", "island").agg(F.array_sort(F.collect_list(F.struct("cue", "start", "end", "text"))).alias("p"))
    joined = F.expr(
        rf"aggregate(slice(p.text, 2, size(p)), p[0].text, (a, b) -> trim(concat(regexp_replace(regexp_replace(a, '→+$', ''), r'{BLANKS}+$', ''), ' ', b)))"
    )
    return parts.select(
        "source", F.col("island").alias("cue"), F.col("p")[0]["start"].alias("start"), F.element_at("p.end", -1).alias("end"),
        joined.alias("text"), F.size("p").alias("n_cues"),
    )


def translation_groups(cues: DataFrame, max_gap_ms: int = 150) -> DataFrame:
    """cues(source, id, start, end, text) with grp: the id of the first cue of the utterance that a cue belongs to.

    Cues are taken by start, end and id. A cue goes on if it starts within max_gap_ms of the one before and that ends with a
    continuation mark, or is unfinished and the cue starts in lower case.
    """
    chunk, order = F.expr("start div 600000"), ["start", "end", "id"]
    rows = with_previous(cues, ["source"], order, chunk, ["end", "text"])
    left, right = _rstrip(F.col("prev.text")), F.regexp_replace("text", f"^{BLANKS}+", "")
    unfinished = right.rlike(r"^\p{Ll}") & ~left.rlike(FINISHED)
    goes_on = (F.col("start") - F.col("prev.end") <= max_gap_ms) & (left.rlike(CONTINUES) | unfinished)
    rows = rows.withColumn("new", ~F.coalesce(goes_on, F.lit(False))).drop("prev")
    return with_island(rows, ["source"], order, chunk, F.col("new"), "id", "grp").drop("new")


def overlaps(a: DataFrame, b: DataFrame, key: str, bucket_ms: int = 60_000) -> DataFrame:
    """Pairs of intervals of one key that overlap: (key, a, b, overlap) from rows (key, id, start, end).

    Each interval stands in every bucket of time that it touches, which makes the range join an equi-join; a pair counts in the first
    bucket that both touch.
    """

    def buckets(df: DataFrame, side: str) -> DataFrame:
        touched = F.sequence(F.expr(f"start div {bucket_ms}"), F.greatest(F.expr(f"(end - 1) div {bucket_ms}"), F.expr(f"start div {bucket_ms}")))
        rows = df.filter("start < end").select(key, F.col("id").alias(side), F.col("start").alias(f"{side}_start"), F.col("end").alias(f"{side}_end"), F.explode(touched).alias("bucket"))
        return rows

    met = buckets(a, "a").join(buckets(b, "b"), [key, "bucket"])
    met = met.filter(F.col("bucket") == F.expr(f"greatest(a_start, b_start) div {bucket_ms}"))
    overlap = F.least("a_end", "b_end") - F.greatest("a_start", "b_start")
    return met.select(key, "a", "b", overlap.alias("overlap")).filter("overlap > 0")


def aligned_by_time(cues: DataFrame, translations: DataFrame) -> DataFrame:
    """(source, id, translation) for every cue(source, id, start, end) that overlaps an utterance of translations(+ text).

    Utterances covered at least half, or covering at least 0.35 of the cue, are taken in order of time, each text once; if there are none,
    the utterance with the longest overlap, then the nearest middle, then the first.
    """
    lines = translation_groups(translations)
    order = F.struct("start", "end", "id")
    groups = lines.groupBy("source", "grp").agg(
        F.min_by("start", order).alias("g_start"), F.max_by("end", order).alias("g_end"),
        F.array_sort(F.collect_list(F.struct("start", "end", "id", "text"))).alias("items"),
    )
    met = overlaps(cues, lines, "source").join(lines.select(F.col("id").alias("b"), "grp"), "b")
    met = met.groupBy("source", F.col("a").alias("id"), "grp").agg(F.sum("overlap").alias("overlap"))
    met = met.join(groups, ["source", "grp"]).join(cues.select("id", F.col("start").alias("c_start"), F.col("end").alias("c_end")), "id")
    of_group = F.col("overlap") / F.greatest(F.lit(1), F.col("g_end") - F.col("g_start"))
    of_cue = F.col("overlap") / F.greatest(F.lit(1), F.col("c_end") - F.col("c_start"))
    away = F.abs(F.col("c_start") + F.col("c_end") - F.col("g_start") - F.col("g_end"))
    met = met.withColumns({"strong": (of_group >= 0.5) | (of_cue >= 0.35), "away": away, "at": F.col("items")[0]})
    whole, best = Window.partitionBy("id"), Window.partitionBy("id").orderBy(F.col("overlap").desc(), "away", "at")
    met = met.withColumns({"any": F.max("strong").over(whole), "r": F.row_number().over(best)})
    chosen = met.filter("strong OR (NOT any AND r = 1)")
    texts = chosen.groupBy("source", "id").agg(F.array_sort(F.collect_list(F.struct("at", "items"))).alias("g"))
    flat = F.array_distinct(F.flatten(F.transform("g", lambda x: x["items"]["text"])))
    return texts.select("source", "id", F.array_join(flat, " ").alias("translation"))
