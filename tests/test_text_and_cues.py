"""Text functions, subtitle parsing, cue merging and alignment."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tanmono.functions import text as tx
from tanmono.operators import cues, dictionary, ordered, tokens
from tanmono.sources import subtitles


def values(spark, column, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(column).collect()]


def test_clean_text(spark):
    got = values(
        spark, tx.clean_text("t"),
        "<i>走れ</i>　 メロス\\N急げ", "{\\an8}（メロス）（小声で）走る", "((走る))", "(A) yes (no)", "  ", None, "（" + "あ" * 25 + "）走る", "a < b > c",
    )
    assert got == ["走れ メロス 急げ", "走る", "走る", "yes (no)", "", None, "（" + "あ" * 25 + "）走る", "a  c".replace("  ", " ")]


def test_readings_and_words(spark):
    assert values(spark, tx.to_hiragana("t"), "カタカナー", "漢字kana", None) == ["かたかなー", "漢字kana", None]
    assert values(spark, tx.katakana_reading("t"), "かた・カナー1") == ["カタカナー"]
    assert values(spark, tx.english_words("t"), "The cat's paw, and THE paw", "", None) == [["cat's", "paw"], [], None]
    assert values(spark, tx.learner_pos("t"), "動詞", "謎", None) == ["Verb", "謎", None]


def test_marked_targets(spark):
    df = spark.createDataFrame(
        [("彼は走る", "走る", 2, 4), ("走る走る", "走る", None, None), ("a<b", "<", 1, 2), ("無い", "走る", None, None), ("x", "", None, None), ("彼は走る", "走る", 0, 9)],
        "s string, t string, a int, b int",
    )
    cols = [F.col(c) for c in "stab"]
    blank, shown = '<span class="target-blank">（　）</span>', '<span class="target-answer">走る</span>'
    got = [r[0] for r in df.select(tx.blank_target(*cols)).collect()]
    assert got == [f"彼は{blank}", f"{blank}走る", f"a{blank}b", "無い", "x", f"彼は{blank}"]
    assert [r[0] for r in df.select(tx.highlight_target(*cols)).collect()][:2] == [f"彼は{shown}", f"{shown}走る"]


def test_parse_srt(spark):
    raw = "﻿1\r\n00:00:01,000 --> 00:00:02.500\r\n<i>one</i>\r\ntwo\r\n\r\n\r\nnot a number\n0:01:00,000-->0:01:01,000\nthree\n\n7\nno timing\n\n9\n00:00:05,000 --> 00:00:06,000\n\\N\n\n00:00:07,000 --> 00:00:08,000\nfour"
    got = [tuple(r)[2:] for r in subtitles.parse_srt(spark.createDataFrame([(1, raw), (2, None), (3, "")], "k int, t string"), "k", "t").orderBy("block").collect()]
    assert got == [(1, 1000, 2500, "one two"), (2, 60000, 61000, "three"), (5, 7000, 8000, "four")]


def test_parse_episodes():
    assert subtitles.parse_episodes("1-3, 7,2") == [1, 2, 3, 7]
    for wrong in ("", "3-1", "a", "1,,2"):
        with pytest.raises(ValueError):
            subtitles.parse_episodes(wrong)


def test_files_and_manifest(spark, tmp_path):
    for n in (1, 2):
        for ext in ("mkv", "srt"):
            (tmp_path / f"[Subs] Show - {n:02d} [720p].{ext}").write_text("")
    (tmp_path / "notes.txt").write_text("")
    manifest = subtitles.build_manifest(tmp_path, "Show", 1, [1, 2])
    assert [e["episode"] for e in manifest["episodes"]] == [1, 2]
    with pytest.raises(ValueError):
        subtitles.build_manifest(tmp_path, "Show", 1, [3])
    import json

    (tmp_path / "m.json").write_text(json.dumps(manifest))
    rows = subtitles.read_manifest(spark, str(tmp_path / "m.json"), [2])
    assert [(r.series, r.episode) for r in rows.collect()] == [("Show", 2)]
    with pytest.raises(ValueError):
        subtitles.read_manifest(spark, str(tmp_path / "m.json"), [2, 5])
    src = spark.createDataFrame([("Show", 1, 2)], "series string, season int, episode int")
    assert subtitles.not_yet_ingested(subtitles.read_manifest(spark, str(tmp_path / "m.json")), src).count() == 1
    (tmp_path / "Show - 1 [1080p].MKV").write_text("")
    with pytest.raises(ValueError):
        subtitles.discover_episode_files(tmp_path)


def merged(spark, rows):
    df = spark.createDataFrame(rows, "source int, cue int, start long, end long, text string")
    return [tuple(r) for r in cues.merge_continuations(df).orderBy("source", "cue").collect()]


def test_merge_continuations(spark):
    rows = [(1, 1, 0, 1000, "走れ→"), (1, 2, 1400, 2000, "メロス→ "), (1, 3, 2500, 3000, "急げ"), (1, 4, 3000, 4000, "待て→"), (1, 5, 4501, 5000, "よ→")]
    assert merged(spark, rows) == [(1, 1, 0, 3000, "走れ メロス 急げ", 3), (1, 4, 3000, 4000, "待て→", 1), (1, 5, 4501, 5000, "よ→", 1)]


def naive_merge(rows):
    out, pending = [], None
    for source, cue, start, end, text in sorted(rows):
        if pending and pending[0] == source and start - pending[3] <= 500:
            text = f"{pending[4].rstrip('→').rstrip()} {text}".strip()
            cue, start, n = pending[1], pending[2], pending[5] + 1
        else:
            out += [pending] if pending else []
            n = 1
        row = (source, cue, start, end, text, n)
        pending = row if text.rstrip().endswith("→") else None
        out += [] if pending else [row]
    return sorted(out + ([pending] if pending else []))


def test_merging_across_chunks_equals_a_loop(spark, monkeypatch):
    monkeypatch.setattr(cues, "CHUNK", 3)
    rng = random.Random(8)
    rows = []
    for source in (1, 2):
        at = 0
        for cue in sorted(rng.sample(range(90), 60)):
            at += rng.choice([100, 700])
            rows.append((source, cue, at, at + 300, rng.choice(["a→", "b", "c→→ "])))
            at += 300
    assert merged(spark, rows) == naive_merge(rows)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 1), st.integers(0, 40)), unique=True, min_size=1, max_size=40), st.integers(1, 9))
def test_previous_row_over_chunks(spark, rows, size):
    df = spark.createDataFrame(rows, "g int, o int")
    got = {(r.g, r.o): r.prev and r.prev.o for r in ordered.with_previous(df, ["g"], ["o"], F.expr(f"o div {size}"), ["o"]).collect()}
    assert got == {(g, o): max((p for h, p in rows if h == g and p < o), default=None) for g, o in rows}


def aligned(spark, cue, translations):
    a = spark.createDataFrame([(1, 1, *cue)], "source int, id int, start long, end long")
    b = spark.createDataFrame([(1, 10 + i, *t) for i, t in enumerate(translations)], "source int, id int, start long, end long, text string")
    return [r.translation for r in cues.aligned_by_time(a, b).collect()]


def test_alignment(spark):
    assert aligned(spark, (1000, 3000), [(0, 900, "Before."), (1000, 2900, "Same."), (3000, 4000, "After.")]) == ["Same."]
    assert aligned(spark, (1000, 3000), [(900, 1900, "first part,"), (1950, 3000, "second part.")]) == ["first part, second part."]
    assert aligned(spark, (1000, 3000), [(0, 1100, "weak."), (2900, 9000, "Also weak.")]) == ["weak."]
    assert aligned(spark, (1000, 3000), [(1000, 2000, "Twice."), (2200, 3000, "Twice.")]) == ["Twice."]
    assert aligned(spark, (1000, 3000), [(5000, 6000, "far")]) == []


def test_overlaps_equal_brute_force(spark):
    rng = random.Random(3)
    spans = [[(rng.randrange(2), i, s := rng.randrange(5000), s + rng.randrange(0, 900)) for i in range(80)] for _ in range(2)]
    frames = [spark.createDataFrame(x, "k int, id int, start long, end long") for x in spans]
    expected = {(k, i, j, min(b, d) - max(a, c)) for k, i, a, b in spans[0] for h, j, c, d in spans[1] if k == h and min(b, d) > max(a, c) and a < b and c < d}
    got = cues.overlaps(*frames, "k", 300).collect()
    assert {tuple(r) for r in got} == expected and len(got) == len(expected)


def test_default_tokens_and_language_pack(spark):
    df = spark.createDataFrame([(1, "彼はABCで走る"), (2, ""), (3, None)], "id int, t string")
    assert [r.surface for r in tokens.default_tokens(df, "id", "t").orderBy("position").collect()] == ["彼", "は", "ABC", "で", "走", "る"]

    def pack(text):
        return [{"surface": c, "lemma": c, "reading": c, "pos": "名詞", "start": i, "end": i + 1} for i, c in enumerate(text) if c.strip()]

    got = tokens.content_words(tokens.analyzed(df, "id", "t", pack)).orderBy("position").collect()
    assert [(r.surface, r.start) for r in got] == [("彼", 0), ("は", 1), ("で", 5), ("走", 6), ("る", 7)]
    assert {r.surface: r.n for r in tokens.token_counts(tokens.analyzed(df, "id", "t", pack)).collect()}["A"] == 1


def test_expressions():
    assert dictionary.claimed([(0, 2), (0, 3), (1, 2), (3, 2), (4, 2)]) == [(0, 3), (3, 2)]


def test_expression_selection(spark):
    lines = spark.createDataFrame([(1, ["a", "b", "c", "d"]), (2, ["a"]), (3, None)], "k int, w array<string>")
    grams = dictionary.word_ngrams(lines, "k", "w")
    assert {(r.key, r.at, r.n, r.ngram) for r in grams.collect()} == {(1, 0, 2, "a b"), (1, 1, 2, "b c"), (1, 2, 2, "c d"), (1, 0, 3, "a b c"), (1, 1, 3, "b c d"), (1, 0, 4, "a b c d")}
    lexicon = spark.createDataFrame([("a b",), ("a b c",), ("c d",)], "ngram string")
    assert [(r.at, r.ngram) for r in dictionary.expressions(grams, lexicon).collect()] == [(0, "a b c")]
