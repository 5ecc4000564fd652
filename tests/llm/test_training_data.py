"""The training-data operators against brute force, and their defined results for awkward rows."""

import collections
import os
import random
import string
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tanmono.llm import alignment, copies, leaks, lookalikes, packing, queries, spans, term_counts, top_items


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


# Problem 1


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [
        ("ガ", "ｶﾞ", True), ("ガ", "ガ", True), ("ロボ", "口ボ", True), ("A1", "Ａ１", True), ("Répo", "Répo", True),
        ("cafе", "cafe", True), ("x​y", "xy", True), ("a b", "a　b", True), ("a b", "a  b", False), ("a.", "a。", False),
        ("カ", "ガ", False), ("土", "士", False), ("⽵", "竹", True), ("竹\U000e0100", "竹", True), ("べ", "ベ", True),
        ("α", "a", True), ("ı", "i", True), ("ɡ", "g", True), ("l", "I", True), ("0", "O", True), ("丶", "ヽ", True), ("rn", "m", True), ("…", "...", True),
        ("x²", "x2", False), ("①", "1", False), ("一", "ー", True), ("A", "Α", True), ("\t", "\u2007", True), ("a\u00adb", "ab", True), ("⼠", "士", True),
    ],
)
def test_skeleton(a, b, same):
    assert (lookalikes.skeleton(a) == lookalikes.skeleton(b)) is same


@given(st.text())
def test_skeleton_is_stable(text):
    once = lookalikes.skeleton(text)
    assert lookalikes.skeleton(once) == once


def test_public_table_is_that_of_the_library(spark):
    checker = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
    table = lookalikes.public_table()
    chars = sorted(c for c in table if chr(c).isprintable())
    theirs = checker.getSkeleton("\n".join(map(chr, chars))).split("\n")
    seen = (lookalikes._INVISIBLE.sub("", chr(c)) for c in chars)
    ours = [lookalikes._decomposed(lookalikes._decomposed(c).translate(table)) for c in seen]
    assert len(table) > 5000 and sum(a != b for a, b in zip(theirs, ours, strict=True)) == 0


@pytest.mark.parametrize("meet", [1000, 1])
def test_lookalike_pairs(spark, monkeypatch, meet):
    monkeypatch.setattr(lookalikes, "MEET", meet)
    df = spark.createDataFrame(
        [(1, "ガ", 0), (2, "ｶﾞ", 0), (3, "ガ", 0), (3, "ガ", 0), (4, None, 0), (None, "ガ", 0), (5, "", 0), (6, "​", 0), (7, "x" * 50_000, 0)],
        "id long, t string, form int",
    )
    assert rows(lookalikes.lookalike_pairs(df, "id", "t").select("key_a", "key_b")) == [(1, 2), (2, 3)]
    assert rows(lookalikes.lookalike_pairs(df.limit(0), "id", "t")) == []
    forms = {r.text: (r.n_rows, r.n_forms) for r in lookalikes.lookalike_forms(df, "t").collect()}
    assert forms["ガ"] == (4, 2) and forms["ｶﾞ"] == (1, 2) and forms[""] == (1, 2)


# Problem 2


def test_copies(spark):
    df = spark.createDataFrame(
        [
            (5, "Hello, World!", "こんにちは", 1), (3, "hello world", "こん・にちは", 1), (9, "コン", "HELLO", 1), (4, "こんにちは", "HELLO WORLD", 1),
            (5, "Hello, World!", "こんにちは", 1), (6, None, "x", 1), (7, "", "x", 1), (None, "x", "y", 1), (8, "か", "x", 1), (10, "が", "x", 1),
            (11, "!", "?", 1), (12, "...", "-", 1),
        ],
        "id long, a string, b string, bucket int",
    )
    for fits in (50_000, 1):
        assert rows(copies.copy_members(df, "id", "a", "b", fits)) == [(11, 12), (3, 4), (3, 5)]
        assert rows(copies.distinct_records(df, "id", "a", "b", fits)) == [(10, 1), (11, 2), (3, 3), (8, 1), (9, 1)]
        assert rows(copies.copy_members(df.limit(0), "id", "a", "b", fits)) == []


def test_copies_with_a_hot_record(spark):
    df = spark.range(400).selectExpr("id", "IF(id % 3 = 0, 'Same.', concat('t', id)) AS a", "'x' AS b")
    assert len(rows(copies.copy_members(df, "id", "a", "b", 10))) == 133


@given(st.lists(st.tuples(st.binary(max_size=6), st.integers(0, 5))))
def test_trie_is_a_map(pairs):
    trie, plain = copies.Trie(), collections.defaultdict(set)
    for key, record in pairs:
        trie.add(key, record)
        plain[key].add(record)
    assert sorted(map(sorted, trie.terminals())) == sorted(map(sorted, plain.values()))


# Problem 3


def test_terms():
    assert alignment.runs("今日、遅館殻がガトンデサでABP１85した") == ["今日", "遅館殻", "が", "ガトンデサ", "で", "abp185", "した"]
    assert alignment.words("It's the oddly-crisp PATH;") == ["it's", "the", "oddly", "crisp", "path"]
    assert alignment.runs(None) == [] == alignment.words("")
    the, fell = alignment._hashed(["the fell"], alignment.words)[1]
    line, _, at, length = alignment._phrases(["the crisp path fell", None, "the the", "fell"], np.array([the]))
    assert list(zip(line, at, length)) == [(0, 1, 1), (0, 2, 1), (0, 3, 1), (2, 4, 1), (2, 5, 1), (3, 6, 1), (0, 1, 2), (0, 2, 2)]


def test_alignment_finds_shifted_and_merged_lines(spark):
    rng = random.Random(3)
    kanji = [chr(0x4E00 + i) for i in range(0, 3000, 7)]
    words = [("".join(rng.sample(kanji, 3)), "".join(rng.sample(string.ascii_lowercase, 6)) + " " + "".join(rng.sample(string.ascii_lowercase, 5))) for _ in range(60)]
    lines, n = [], 0
    for source in range(1, 8):
        for cue in range(60):
            n += 1
            some = rng.sample(words, 3)
            lines.append((n, source, cue, cue * 3000, cue * 3000 + 2000, "は".join(w[0] for w in some), " of the ".join(w[1] for w in some)))
    expected, en_cue = set(), 200
    for cue in range(40):
        some = rng.sample(words, 4)
        n += 1
        ja_id = n
        lines.append((ja_id, 9, cue, cue * 3000, cue * 3000 + 2000, "は".join(w[0] for w in some), None))
        for part in (some,) if cue % 4 else (some[:2], some[2:]):  # every fourth line is split in two
            n += 1
            at = cue * 3000 + 7000 + (1000 if part != some and part == some[2:] else 0)
            lines.append((n, 9, en_cue, at, at + 900, "", " of the ".join(w[1] for w in part)))
            expected.add((ja_id, n))
            en_cue += 1
    lines += [lines[0], (n + 1, None, None, None, None, None, None), (n + 2, 9, 999, 0, 10, "", "(door closes)")]
    df = spark.createDataFrame(lines, "id long, source long, cue int, start long, end long, ja_text string, en_text string")
    got = {(r.ja, r.en) for r in alignment.translation_pairs(df).collect()}
    assert len(got & expected) >= 0.9 * len(expected) and len(got - expected) <= 3
    assert alignment.translation_pairs(df.limit(0)).count() == 0


def _unaligned(seed: int, cues: int, step: int, length: int, place, order=None, n_words: int = 60):
    """Lines of paired sources and of an unaligned source 9, and its true pairs; place: time to time on the English track."""
    rng = random.Random(seed)
    kanji = [chr(0x4E00 + i) for i in range(0, 3000, 7)]
    letters = string.ascii_lowercase
    words = [("".join(rng.sample(kanji, 3)), "".join(rng.sample(letters, 6)) + " " + "".join(rng.sample(letters, 5))) for _ in range(n_words)]
    said = lambda some: ("は".join(w[0] for w in some), " of the ".join(w[1] for w in some))
    lines = []
    for n in range(1, 401):
        lines.append((n, n // 60, n % 60, n % 60 * 3000, n % 60 * 3000 + 2000, *said(rng.sample(words, 3))))
    texts = [said(rng.sample(words, 4)) for _ in range(cues)]
    for cue, (text, _) in enumerate(texts):
        lines.append((1001 + cue, 9, cue, cue * step, cue * step + length, text, None))
    for cue, i in enumerate(order or range(cues)):
        at = place(cue * step)
        lines.append((5001 + i, 9, cues + 50 + cue, at, at + length, "", texts[i][1]))
    return lines, {(1001 + i, 5001 + i) for i in range(cues)}


_LINES = "id long, source long, cue int, start long, end long, ja_text string, en_text string"


def test_alignment_finds_swapped_long_cues(spark):
    order = list(range(40))
    for i in range(5, 35, 6):  # each misses its place by 8 s
        order[i], order[i + 1] = order[i + 1], order[i]
    lines, expected = _unaligned(5, 40, 12_000, 4_000, lambda at: at + 2_000, order)
    got = {(r.ja, r.en) for r in alignment.translation_pairs(spark.createDataFrame(lines, _LINES)).collect()}
    assert got == expected


def test_alignment_puts_lines_without_terms_in_their_place(spark):
    lines, expected = _unaligned(13, 40, 12_000, 4_000, lambda at: at + 2_000)
    ja, (whole, source, cue, start, _, _, text) = 1021, next(r for r in lines if r[0] == 5021)
    lines = [r if r[0] != whole else (whole, source, cue, start + 2_000, start + 4_000, "", text) for r in lines]
    lines = [r if r[1] != 9 or r[5] or r[2] >= cue else (*r[:2], r[2] - 1, *r[3:]) for r in lines]  # room for the part before
    lines.append((9001, source, cue - 1, start, start + 1_900, "", "they of the"))  # with the rest it fills the Japanese line's time
    lines.append((9002, source, 2_000, 41 * 12_000, 41 * 12_000 + 3_000, "", "♪ la ♪"))  # after all Japanese lines
    got = {(r.ja, r.en) for r in alignment.translation_pairs(spark.createDataFrame(lines, _LINES)).collect()}
    assert got == expected | {(ja, 9001)}


def test_alignment_follows_a_drift_beyond_the_blocks(spark):
    # 10 minutes apart at the start, 13 at the end; both tracks hold each other's blocks, but of other lines.
    lines, expected = _unaligned(7, 150, 24_000, 2_000, lambda at: 600_000 + at * 26 // 25 + at // 100, n_words=250)
    got = {(r.ja, r.en) for r in alignment.translation_pairs(spark.createDataFrame(lines, _LINES)).collect()}
    assert len(got & expected) >= 0.97 * len(expected) and len(got - expected) <= 3


@pytest.mark.parametrize(("least", "listed"), [(alignment.LEAST_COSINE, 100), (alignment.LEAST_COSINE, 5), (0.0, 100)])
def test_term_cosines_are_of_all_lines(spark, monkeypatch, least, listed):
    monkeypatch.setattr(alignment, "LISTED", listed)
    rng = random.Random(11)
    ja, en = [f"{a}{b}" for a in "春夏秋冬" for b in "山川海空"], [f"{c}q" for c in string.ascii_lowercase[:16]]
    docs = []
    for n in range(300):
        some = [i for i in range(16) if rng.random() < (i + 1) / 200]
        docs.append((n, "は".join(ja[i] for i in some), " . of the ".join(en[i] for i in some if rng.random() < 0.7) + " the of the"))
    lines = [collections.defaultdict(set), collections.defaultdict(set)]
    for n, *texts in docs:
        for w in [*texts[0].split("は"), *["は"] * ("は" in texts[0])]:
            lines[0][w].add(n)
        content = [w for w in texts[1].replace(".", "").split() if w not in ("of", "the")]
        for w in content or ["of", "the"]:
            lines[1][w].add(n)
    del lines[0][""]
    exact = {(a, b): len(x & y) / ((len(x) * len(y)) ** 0.5 + 0.5) for a, x in lines[0].items() for b, y in lines[1].items() if x & y}
    hashed = lambda w: alignment._hashed([w], alignment.words)[1]
    df = spark.createDataFrame([*docs, docs[250]], "id long, a string, b string")  # a repeated row counts once
    got, common, lists = alignment.term_cosines(df, least)
    assert sorted(common) == sorted([hashed("of")[0], hashed("the")[0]])
    code = lambda w, side: int(alignment._known(hashed(w), lists[side])[0][0])
    assert {(r.ja, r.en): r.cosine for r in got.collect()} == pytest.approx({(code(a, 0), code(b, 1)): v for (a, b), v in exact.items() if v >= least})


def test_alignment_of_lines_in_hiragana(spark):
    said = [("ありがとう", "Thanks!"), ("おやすみ", "Sleep well."), ("山!", "Mountain!"), ("どうぞ", "Welcome.")]
    lines = [(n, 1, n, n * 3000, n * 3000 + 2000, *said[n % 4]) for n in range(40)]
    for cue, (a, b) in enumerate(said):
        lines.append((101 + cue, 9, cue, cue * 9000, cue * 9000 + 2000, a, None))
        lines.append((201 + cue, 9, cue + 50, cue * 9000 + 100, cue * 9000 + 2100, "", b))
    got = {(r.ja, r.en) for r in alignment.translation_pairs(spark.createDataFrame(lines, _LINES)).collect()}
    assert got == {(101 + i, 201 + i) for i in range(4)}


# Problem 4


def test_top_per_group(spark):
    nan = float("nan")
    data = [(1, 10, 0.5), (1, 10, 0.9), (1, 11, 0.9), (1, 12, None), (1, 13, nan), (1, 14, 0.1), (None, 1, 1.0), (2, None, 1.0), (2, 7, -1.0)]
    df = spark.createDataFrame([(*r, "x") for r in data], "g long, i long, s double, position string")
    got = top_items.top_per_group(df, "g", "i", "s", 2)
    assert rows(got) == [(1, 10, 0.9, 1), (1, 11, 0.9, 2), (2, 7, -1.0, 1)]
    assert rows(top_items.top_per_group(df.limit(0), "g", "i", "s", 2)) == []


def test_top_per_group_against_brute_force(spark):
    rng = random.Random(5)
    data = [(min(rng.randrange(1, 40), 13), rng.randrange(60), rng.randrange(12) / 4) for _ in range(5000)]
    best = {}
    for g, i, s in data:
        best[g, i] = max(s, best.get((g, i), s))
    expected = []
    for g in {g for g, _ in best}:
        ranked = sorted(((-s, i) for (h, i), s in best.items() if h == g))[:5]
        expected += [(g, i, -s, r) for r, (s, i) in enumerate(ranked, 1)]
    got = top_items.top_per_group(spark.createDataFrame(data, "g long, i long, s double"), "g", "i", "s", 5)
    assert rows(got) == sorted(expected, key=repr)


# Problem 5


def test_value_counts(spark):
    data = [(1, "a", 2, "x"), (1, "a", 2, "x"), (1, "a", None, "y"), (2, "a", 1, "x"), (2, "b", 1, "x"), (None, "b", 5, "x"), (3, None, 5, "x"), (3, "", 1, "x")]
    df = spark.createDataFrame([(*r, 0) for r in data], "rec long, v string, c long, k string, suffix int")
    got = term_counts.value_counts(df, "rec", "v", "c", ["k"])
    assert rows(got) == [("", 1, 1), ("a", 4, 2), ("b", 1, 1)]
    marks = {r.value: (r.rare, r.common) for r in term_counts.marked(got, 3, common=0.5).collect()}
    assert marks == {"": (True, False), "a": (False, True), "b": (True, False)}
    assert rows(term_counts.value_counts(df.limit(0), "rec", "v", "c", ["k"])) == []


def test_ngram_counts_against_brute_force(spark):
    rng = random.Random(2)
    records = [[rng.choice("abc") for _ in range(rng.randrange(9))] for _ in range(200)] + [["a"] * 300, None, []]
    total, held = collections.Counter(), collections.Counter()
    for r in records:
        grams = [term_counts.UNIT.join(r[i : i + n]) for n in (1, 2, 3) for i in range(len(r or ()) - n + 1)]
        total.update(grams)
        held.update(set(grams))
    got = term_counts.ngram_counts(spark.createDataFrame([(r,) for r in records], "t array<string>"), "t", 3)
    assert {r.ngram: (r.total, r.records) for r in got.collect()} == {g: (total[g], held[g]) for g in total}


DATA = Path(os.environ.get("TANMONO_TEST_DATA", "/root/testdata/sf0.001"))


@pytest.mark.skipif(not DATA.exists(), reason="the test tables are not here")
def test_ngrams_of_whole_tables(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW sentences AS FROM '{DATA}/sentences.parquet'")
    got = queries.queries()["p5_ngrams"](spark, str(DATA)).select("ngram", "n", "total", "n_sentences")
    assert rows(got) == sorted(con.execute(queries.oracle_sql()["p5_ngrams"]).fetchall(), key=repr)


# Problem 6


def test_packing(spark):
    rng = random.Random(1)
    data = [(i, rng.choice([3, 7, 12, 40, 99, 100, 101, 250])) for i in range(300)] + [(400, None), (401, 0), (None, 5), (0, 1)]
    df = spark.createDataFrame(data, "id long, n long")
    frames = spark.createDataFrame([(1, 100), (2, 1000), (3, None)], "w long, c long")
    got = packing.packed_documents(df, "id", "n", frames, "w", "c").collect()
    sizes = {i: max(n or 1, 1) for i, n in data if i is not None} | {0: max(data[0][1], 1)}
    for window, capacity in ((1, 100), (2, 1000)):
        mine = [r for r in got if r.window == window]
        fill, parts = collections.Counter(), collections.defaultdict(list)
        for r in mine:
            fill[r.container] += r.tokens
            parts[r.id].append(r)
        assert max(fill.values()) <= capacity
        assert {i: sum(r.tokens for r in p) for i, p in parts.items()} == sizes
        assert all(len(p) == -(-sizes[i] // capacity) == p[0].n_pieces for i, p in parts.items())
        assert sorted({r.piece for r in max(parts.values(), key=len)}) == list(range(max(map(len, parts.values()))))
        assert sum(sizes.values()) / (len(fill) * capacity) > 0.97
    assert packing.packed_documents(df.limit(0), "id", "n", frames, "w", "c").count() == 0


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(1, 50), min_size=1, max_size=60), st.integers(0, 9))
def test_evolved_packings_hold_every_item_once(sizes, seed):
    for found in packing.evolved(sizes, 50, [], 6, random.Random(seed)):
        assert sorted(i for g in found for i in g) == list(range(len(sizes)))
        assert all(0 < sum(sizes[i] for i in g) <= 50 for g in found)


def test_search_beats_its_first_packing(spark):
    rng = random.Random(8)
    sizes = []
    for _ in range(60):  # sixty containers without any space left
        cut = sorted(rng.sample(range(1, 1000), 4))
        sizes += [b - a for a, b in zip([0, *cut], [*cut, 1000], strict=True)]
    df = spark.createDataFrame(list(enumerate(sizes)), "id long, n long")
    args = (df, "id", "n", spark.createDataFrame([(1, 1000)], "w long, c long"), "w", "c")
    report = packing.packing_report(packing.packed_documents(*args), packing.packed_documents(*args, search=False)).first()
    assert (report["items"], report["tokens"], report["least"]) == (300, 60_000, 60)
    assert 60 <= report["containers"] <= report["before"]
    one = packing.best_fit(sizes, 1000, [], sorted(range(300), key=lambda i: -sizes[i]))
    found = packing.evolved(sizes, 1000, [[list(g) for g in one]], 150, random.Random(1))[0]
    assert packing.fitness(sizes, 1000, found) > packing.fitness(sizes, 1000, one)


# Problem 7


def test_leaks(spark):
    en = "The quiet harbour keeps seventeen wooden boats beside the northern lighthouse every winter, while nobody counts them aloud."
    ja = "君は針塔わいズミン・ザダを南外ぎようのは所鼓法だが、門場牙なら室色けないと港貝霊が言う。馬砂らい重柱核を湖兎でたのは祖玉牙だ。"
    items = spark.createDataFrame([(1, "en", "Q?", en), (2, "ja", "Q?", ja), (3, "en", "Q?", None), (4, "en", "Q?", "short"), (1, "en", "Q?", en)], "item long, lang string, q string, passage string")
    filler = " ".join(f"Sentence number {i} says nothing of interest at all." for i in range(50))
    docs = spark.createDataFrame(
        [
            (10, filler + en.upper().replace(" ", "\n") + filler), (11, en[: len(en) * 6 // 10] + filler), (12, en[: len(en) * 3 // 10] + filler),
            (13, "前書き" + ja.replace("、", " 、​")), (14, filler), (15, None), (16, ""), (17, en[60:] + filler * 3 + en[:60]),
            (18, "1\n00:00:01,000 --> 00:00:02,000\n" + en[:58] + "\n\n2\n00:00:03,000 --> 00:00:04,000\n" + en[58:]), (None, en), (10, filler),
        ],
        "doc long, text string",
    )
    found = leaks.leaked_passages(docs.withColumnRenamed("doc", "d"), "d", "text", items, "item", "lang", "passage")
    pairs = {(r.doc, r.item) for r in found.collect()}
    assert {(10, 1), (11, 1), (13, 2), (18, 1)} <= pairs and not {(12, 1), (14, 1)} & pairs and len(pairs) <= 5
    assert leaks.leaked_passages(docs.limit(0).withColumnRenamed("doc", "d"), "d", "text", items, "item", "lang", "passage").count() == 0
    assert leaks.leaked_passages(docs.withColumnRenamed("doc", "d"), "d", "text", items.limit(0), "item", "lang", "passage").count() == 0


def test_leaks_in_mixed_scripts_and_whole_test_sets(spark):
    rng = random.Random(6)
    mixed = "".join(c + ("漢字仮名交文章"[i // 15] if i % 15 == 7 else "") for i, c in enumerate("".join(rng.choice(string.ascii_lowercase) for _ in range(104))))
    kanji = [chr(0x4E00 + i) for i in range(2000)]
    passages = [mixed, "".join(rng.choice(kanji) for _ in range(90)) + "latin letters in a row", "あ" * 100, "ab" * 60, "Ｆｕｌｌ ｗｉｄｔｈ " * 9]
    items = spark.createDataFrame([(i, lang, "Q?", p) for i, p in enumerate(passages) for lang in [["en", "ja", "ja", "en", "en"][i]]], "item long, lang string, q string, passage string")
    far = "".join(rng.choice(kanji) for _ in range(4000))
    docs = [(i, "intro, " + p + ". outro") for i, p in enumerate(passages)] + [(10, far.join(passages)), (11, mixed[:70] + " 3 " + mixed[70:]), (12, far)]
    docs = spark.createDataFrame(docs, "d long, text string")
    expected = {(i, i) for i in range(5)} | {(10, i) for i in range(5)} | {(11, 0)}
    found = leaks.leaked_passages(docs, "d", "text", items, "item", "lang", "passage")
    assert {(r.doc, r.item) for r in found.collect()} == expected
    stored = leaks.search(leaks.positional_index(docs, "d", "text"), leaks.passage_terms(items, "item", "lang", "passage"))
    assert rows(stored) == rows(found)


def test_leaks_of_texts_longer_than_a_chunk(spark, monkeypatch):
    monkeypatch.setattr(leaks, "CHUNK", 50)
    batch = pa.RecordBatch.from_pydict({"d": [1, 2, 3], "t": ["".join(random.Random(1).choices(string.ascii_lowercase, k=333)), "short", "x" * 60]})
    cut = pa.concat_tables(pa.Table.from_batches([b]) for b in leaks._index(None)([batch])).to_pylist()
    monkeypatch.setattr(leaks, "CHUNK", 10**6)
    whole = pa.concat_tables(pa.Table.from_batches([b]) for b in leaks._index(None)([batch])).to_pylist()
    assert sorted(map(repr, cut)) == sorted(map(repr, whole)) and len(cut) == 333 - 14 + 333 - 29 + 46 + 31


def test_covered_letters_keeps_order():
    hits = [(i, i + 2) for i in range(22)]
    assert leaks.phrases(hits, 5) == [(0, 2, 26)] and leaks.covered_letters(hits, 5, 26) == 26
    swapped = [(i, i + 13) for i in range(9)] + [(i + 13, i) for i in range(9)]
    assert leaks.covered_letters(swapped, 5, 26) == 13
    assert leaks.covered_letters([], 5, 26) == 0


# Problem 8


def brute_pairs(texts, least):
    held = collections.defaultdict(set)
    for i, t in texts.items():
        for p in range(len(t or "") - least + 1):
            held[t[p : p + least]].add(i)
    return {(a, b) for v in held.values() for a in v for b in v if a < b}


@pytest.mark.parametrize("meet", [1000, 2])
def test_shared_spans(spark, monkeypatch, meet):
    monkeypatch.setattr(spans, "MEET", meet)
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abcdefgh \n") for _ in range(n))
    shared = [word(40), word(39), word(70)]
    texts = {i: word(rng.randrange(0, 120)) for i in range(40)}
    for i in range(0, 40, 3):
        texts[i] = word(9) + shared[i % 2] + word(5) + shared[2][: 30 + i % 40]
    texts |= {50: texts[0], 51: texts[0], 52: "a" * 200, 53: "a" * 300, 54: "ab" * 100, 55: None, 56: "", 57: "short"}
    df = spark.createDataFrame([(i, t, 0) for i, t in texts.items()], "doc_id long, body string, seed int")
    expected = brute_pairs(texts, 40)
    got = rows(spans.sharing_pairs(df, "doc_id", "body", 40))
    assert got == sorted(expected, key=repr)
    held = collections.defaultdict(set)
    for i, t in texts.items():
        for p in range(len(t or "") - 39):
            held[t[p : p + 40]].add(i)
    for r in spans.shared_share(df, "doc_id", "body", 40).collect():
        t = texts[r.doc] or ""
        marked = {q for p in range(len(t) - 39) if len(held[t[p : p + 40]]) > 1 for q in range(p, p + 40)}
        assert (r.n_chars, r.n_shared) == (len(t), len(marked)), r
    assert spans.sharing_pairs(df.limit(0), "doc_id", "body", 40).count() == 0


def test_minimizers_cover_every_window():
    hashes = np.random.default_rng(1).integers(0, 50, 500).astype(np.uint64)
    spots = spans.minimizers(hashes, 20)
    assert all(any(s <= p < s + 20 and hashes[p] == hashes[s : s + 20].min() for p in spots) for s in range(481))
    assert all(any(hashes[p] == hashes[max(0, s) : s + 20].min() for s in range(p - 19, p + 1) if s >= 0 and s + 20 <= 500) for p in spots)


def test_chains_rise_in_both_texts():
    found = spans.chains([(0, 0), (10, 10), (20, 22), (30, 5), (900, 40)], 10)
    assert found[0] == [(0, 0), (10, 10), (20, 22)]
    assert sorted(m for c in found for m in c) == [(0, 0), (10, 10), (20, 22), (30, 5), (900, 40)]
