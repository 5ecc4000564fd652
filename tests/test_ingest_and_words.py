"""Ingestion, words in place, expressions, and the state of cards, batches and reviews."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tanmono.functions.text import english_words
from tanmono.operators import audit, cards, ingest, model, morphs, ranking, semantics, tokens
from tanmono.plans.storage import publish, published
from tanmono.sinks import card_service
from tanmono.sources import subtitles
from tanmono.streaming import state

MORPH = "sentence_id long, position int, surface string, lemma string, reading string, pos string, start int, end int"


def put(spark, text, words):
    """Morph rows of a text from (surface, lemma, reading, pos)."""
    at, rows = 0, []
    for n, (surface, *rest) in enumerate(words):
        at = text.index(surface, at)
        rows.append((1, n, surface, *rest, at, at + len(surface)))
        at += len(surface)
    return spark.createDataFrame(rows, MORPH), spark.createDataFrame([(1, text, "")], "sentence_id long, text string, english string")


def test_words_are_read_in_context(spark):
    cases = [("言い", "いい", "イイ", "形容詞", "言いたい"), ("何", "何", "ナン", "代名詞", "何が"), ("何", "何", "ナン", "代名詞", "何 "), ("何", "何", "ナン", "代名詞", "何？"), ("何", "何", "ナン", "代名詞", "何だ"), ("いい", "いい", "イイ", "形容詞", "いい人")]
    rows = spark.createDataFrame([(n, *c, len(c[0])) for n, c in enumerate(cases)], "n int, surface string, lemma string, reading string, pos string, text string, end int")
    got = {r.n: (r.lemma, r.reading, r.pos) for r in morphs.contextual(rows, "text").collect()}
    assert got == {0: ("いう", "イウ", "動詞"), 1: ("何", "ナニ", "代名詞"), 2: ("何", "ナニ", "代名詞"), 3: ("何", "ナニ", "代名詞"), 4: ("何", "ナン", "代名詞"), 5: ("いい", "イイ", "形容詞")}


def test_inflected_spans(spark):
    rows, lines = put(spark, "彼は食べました。食べ物", [("彼", "彼", "カレ", "代名詞"), ("は", "は", "ハ", "助詞"), ("食べ", "食べる", "タベル", "動詞"), ("まし", "ます", "マス", "助動詞"), ("た", "た", "タ", "助動詞"), ("食べ", "食べる", "タベル", "動詞"), ("物", "物", "モノ", "名詞")])
    asked = [("食べる", "タベル", "食べ"), ("物", "ブツ", "物"), ("食べる", "タベル", "食う"), ("彼", "カレ", "彼"), ("鳥", "トリ", "鳥")]
    targets = spark.createDataFrame([(1, *a) for a in asked], "sentence_id long, lemma string, reading string, surface string")
    got = {(r.lemma, r.surface): (r.start, r.end) for r in morphs.inflected_spans(targets, rows, lines).collect()}
    assert got == {("食べる", "食べ"): (2, 7), ("物", "物"): (10, 11), ("食べる", "食う"): (None, None), ("彼", "彼"): (0, 1), ("鳥", "鳥"): (None, None)}


def test_readings_of_spans(spark):
    df = spark.sql("SELECT array(named_struct('start', 0, 'end', 2, 'reading', 'きょう'), named_struct('start', 2, 'end', 3, 'reading', 'は'), named_struct('start', 4, 'end', 5, 'reading', 'め')) AS t")
    ask = lambda a, b: df.select(morphs.span_reading(F.col("t"), F.lit(a), F.lit(b))).first()[0]
    assert [ask(0, 3), ask(0, 2), ask(0, 1), ask(2, 5), ask(1, 3), ask(4, 5), ask(7, 9)] == ["キョウハ", "キョウ", None, None, None, "メ", None]
    nodes = [("目", "メ"), ("を", "ヲ"), ("目", "モク"), ("的", "テキ")]
    assert morphs.nth_reading(nodes, "目を目的", 0, 1) == "メ" and morphs.nth_reading(nodes, "目を目的", 2, 3) == "モク"
    assert morphs.nth_reading(nodes, "目を目的", 2, 4) == "モクテキ" and morphs.nth_reading(nodes, "目を耳", 2, 3) is None and morphs.nth_reading(nodes, "目", 0, 0) is None
    rows = spark.createDataFrame([("目を目的", 2, 4), (None, 0, 1), ("目を目的", None, 1)], "text string, start int, end int")
    assert [r[0] for r in rows.select(morphs.node_readings(rows, lambda t: nodes)).collect()] == ["モクテキ", None, None]


def test_analyzers_without_places(spark):
    analyze = morphs.plain_analyzer(lambda t: [{"surface": w, "pos": "名詞"} for w in t.split()])
    assert [(w["surface"], w["start"], w["end"], w["lemma"], w["pos"]) for w in analyze("水 を 水")] == [("水", 0, 1, "水", "名詞"), ("を", 2, 3, "を", "名詞"), ("水", 4, 5, "水", "名詞")]
    lines = spark.createDataFrame([(1, "水 を"), (2, None)], "id long, text string")
    assert [(r.sentence_id, r.position, r.reading) for r in morphs.morphs(lines, "id", "text", analyze).orderBy("position").collect()] == [(1, 0, "水"), (1, 1, "ヲ")]


def test_expressions_take_the_place_of_their_parts(spark):
    text = "腹が立つ、馬鹿"
    rows, lines = put(spark, text, [("腹", "腹", "ハラ", "名詞"), ("が", "が", "ガ", "助詞"), ("立つ", "立つ", "タツ", "動詞"), ("、", "、", "、", "補助記号"), ("馬鹿", "馬鹿", "バカ", "名詞")])
    lines = lines.withColumn("english", F.lit("I am angry, fool"))
    found = morphs.expression_candidates(rows, lines)
    assert sorted((r.position, r.n, r.surface, r.with_particle) for r in found.collect()) == [(0, 2, "腹が", True), (0, 3, "腹が立つ", True), (1, 2, "が立つ", True)]
    lexicon = spark.createDataFrame([("腹が立つ", "腹が立つ", "ハラガタツ", "angry"), ("が立つ", "が立つ", "ガタツ", "angry"), ("腹が", "腹が", "ハラガ", "belly")], "surface string, lemma string, reading string, gloss string")
    parts = spark.createDataFrame([(1, 0, "belly"), (1, 2, "stand")], "sentence_id long, position int, gloss string")
    analyses = morphs.analyses(found, lexicon, parts, lines, english_words)
    assert {r.surface: r.decision for r in analyses.collect()} == {"腹が立つ": "expression", "が立つ": "expression", "腹が": "ambiguous"}
    chosen = morphs.selected(analyses)
    assert sorted((r.surface, r.taken) for r in chosen.collect()) == [("腹が立つ", True)]
    got = sorted((r.position, r.surface, r.pos) for r in morphs.with_expressions(rows, chosen).collect())
    assert got == [(0, "腹が立つ", "表現"), (4, "馬鹿", "名詞")]
    alone = morphs.analyses(found, lexicon, parts, lines, english_words, analyze=lambda t: [{"surface": t, "lemma": t, "reading": t, "pos": "名詞", "start": 0, "end": len(t)}])
    assert alone.count() == 0  # one word when it stands alone


def test_proper_nouns_are_no_words_to_learn(spark):
    rows = spark.createDataFrame([(1, 0, "東京", "名詞", "固有名詞"), (1, 1, "駅", "名詞", None), (1, 2, "は", "助詞", None), (1, 3, "abc", "名詞", None)], "sentence_id long, position int, surface string, pos string, pos2 string")
    assert [r.position for r in morphs.component_tokens(rows).collect()] == [1]


def test_ingestion_replaces_sources(spark):
    sen = spark.createDataFrame([(1, 1, 1, 0, 1000, "赤い", "red"), (2, 2, 1, 0, 1000, "青い", "blue")], "id long, source_id long, cue_index int, start_ms long, end_ms long, japanese string, english string")
    occ = spark.createDataFrame([(10, 1, "赤", 1), (11, 1, "い", 4), (12, 2, "青", 2), (10, 2, "赤", 5), (13, 1, "黄", 1), (14, 1, "黒", 1)], "lexeme_id long, sentence_id long, surface string, n long")
    known = dt.datetime(2024, 1, 1)
    lex = [(10, "赤", None), (11, "い", None), (12, "青", None), (13, "黄", known), (14, "黒", None)]
    lex = spark.createDataFrame([(i, x, x, "名詞", 99, k, "g") for i, x, k in lex], "id long, lemma string, reading string, part_of_speech string, corpus_count long, known_at timestamp, gloss string")
    lex = lex.withColumn("lexeme_key", F.substring(F.sha2(F.concat_ws("\x1f", "lemma", "reading"), 256), 1, 24))
    held = spark.createDataFrame([(14, 1), (12, 2)], "lexeme_id long, sentence_id long")
    planned = spark.createDataFrame([(1, 1), (1, 2), (2, 2)], "batch_id long, sentence_id long")
    cue = "source_id long, cue_index int, start_ms long, end_ms long, text string"
    ja = spark.createDataFrame([(1, 1, 0, 1000, "赤と白"), (1, 2, 2000, 3000, "白")], cue)
    en = spark.createDataFrame([(1, 7, 0, 900, "Red and white."), (1, 8, 9000, 9900, "Later.")], cue)
    fresh = ingest.fresh_sentences(ja, en)
    assert {r.japanese: r.english for r in fresh.collect()} == {"赤と白": "Red and white.", "白": ""}
    after = ingest.ingested(ingest.Tables(sen, occ, lex, held, planned), fresh, lambda rows, key, text: tokens.content_words(tokens.default_tokens(rows, key, text)))
    assert after.sentences.count() == 3 and after.sentences.filter("id = 1").count() == 0
    counts = {r.lemma: r.corpus_count for r in after.lexemes.collect()}
    assert counts == {"赤": 6, "青": 2, "と": 1, "白": 2, "黄": 0, "黒": 0}  # known or on a card; "い" is gone
    assert after.lexemes.filter("lemma = '白'").first().part_of_speech == "名詞"
    assert sorted(map(tuple, after.cards.select("lexeme_id", "sentence_id").collect())) == [(12, 2), (14, None)]
    assert [tuple(r) for r in after.planned.collect()] == [(2, 2)]
    assert ingest.totals(after, fresh) == (2, 4)
    again = ingest.ingested(after, fresh, lambda rows, key, text: tokens.content_words(tokens.default_tokens(rows, key, text)))
    assert {r.lemma: r.corpus_count for r in again.lexemes.collect()} == counts


def test_vectors_are_encoded_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def encode(parts):
        for part in parts:
            seen.add(len(part))
            yield part.map(lambda t: [float(len(t))])

    texts = spark.createDataFrame([("m", "q", "ab"), ("m", "q", "ab"), ("m", "q", "abc"), ("m", "q", None)], "model string, role string, text string")
    cache = spark.createDataFrame([], "model string, role string, text_hash string, vector array<float>")
    got, cache = semantics.cached_vectors(texts, cache, encode)
    assert sorted((r.text, r.vector) for r in got.collect()) == [("ab", [2.0]), ("ab", [2.0]), ("abc", [3.0])] and seen.value == 2
    got, cache = semantics.cached_vectors(texts, cache, encode)
    assert got.count() == 3 and cache.count() == 2 and seen.value == 2


def test_cards_batches_and_reviews(spark):
    old, new = dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2)
    schema = "lexeme_id long, note_id long, card_id long, source_id long, sentence_id long, synced_at timestamp"
    held = spark.createDataFrame([(1, 1, 1, 1, 1, old, 4), (2, 2, 2, 1, 2, old, 0)], schema + ", reps long")
    now = cards.recorded(held, spark.createDataFrame([(1, 7, 8, 2, None, new), (1, 6, 6, 6, 6, old), (3, 9, 9, 2, 9, new)], schema))
    assert sorted(map(tuple, now.drop("synced_at").collect())) == [(1, 7, 8, 2, None, 4), (2, 2, 2, 1, 2, 0), (3, 9, 9, 2, 9, 0)]
    plan = spark.createDataFrame([(1, 5), (2, 6)], "position int, lexeme_id long")
    assert {(r.complete, tuple(r.sources)) for r in cards.batch("b", plan, 2, [9, 3], "hybrid").collect()} == {(True, (3, 9))}
    assert not cards.batch("b", plan, 3, [1], "hybrid").first().complete
    review = "card int, code string, verdict string, note string, at int"
    stored = spark.createDataFrame([(1, "gloss_support", "pass", None, 1)], review)
    fresh = spark.createDataFrame([(1, "gloss_support", "flag", "no", 2), (2, "gloss_support", "flag", None, 1), (1, "gloss_support", "perhaps", None, 9)], review)
    criteria = spark.createDataFrame([(1, "gloss_support")], "card int, code string")
    assert [tuple(r) for r in cards.recorded_reviews(stored, fresh, criteria).collect()] == [(1, "gloss_support", "flag", "no", 2)]
    clean = spark.createDataFrame([(1, 1, 1), (1, 2, None), (2, 3, 1)], "plan long, lexeme_id long, clean_position int")
    none = spark.createDataFrame([], "plan long, lexeme_id long")
    assert cards.checked_selection(clean, none, 1).count() == 2
    for findings, limit in ((none, 2), (spark.createDataFrame([(2, 3)], none.schema), 1)):
        with pytest.raises(ValueError):
            cards.checked_selection(clean, findings, limit)


def test_alternatives_that_a_gate_can_come_to(spark):
    rows = spark.createDataFrame([(1, 1, n, 0, n, [] if n % 2 else [7]) for n in range(10)], "source_id long, lexeme_id long, length int, cue_index int, sentence_id long, needs array<long>")
    assert sorted(r.sentence_id for r in cards.first_alternatives(rows, 2).collect()) == [0, 1, 2, 3, 4, 5]


def test_synchronisation(spark):
    old, new = dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2)
    held = spark.createDataFrame([(1, 10, 100, 1, 5, old, 0), (2, 20, 200, 1, 6, old, 0), (3, 30, 300, 1, 7, old, 2)], "lexeme_id long, note_id long, card_id long, source_id long, sentence_id long, synced_at timestamp, reps long")
    calls = []

    def invoke(action, **params):
        calls.append(action)
        return {"cardsInfo": [{"cardId": 100, "reps": 3}, {"cardId": 200, "reps": 0}, {"cardId": 300, "reps": 4}], "addNote": 40, "findCards": [400], "storeMediaFile": "a.mp3"}.get(action)

    def plan(taught):
        assert [r.lexeme_id for r in taught.collect()] == [1]
        return spark.createDataFrame([(2, 2, 8), (3, 2, 9), (4, 2, 11)], "lexeme_id long, source_id long, sentence_id long")

    now, taught, done = card_service.synchronise(invoke, held, plan, lambda row: {"Front": str(row["sentence_id"])}, "D", "M", new)
    assert done == {"add": 1, "move": 1, "learned": 1, "batch": 2}
    assert sorted(map(tuple, now.drop("synced_at").collect())) == [(1, 10, 100, 1, 5, 3), (2, 20, 200, 2, 8, 0), (3, 30, 300, 1, 7, 4), (4, 40, 400, 2, 11, 0)]
    assert calls.count("addNote") == 1 and calls.count("changeDeck") == 1


def test_frequencies_from_outside(spark):
    lex = spark.createDataFrame([(1, "k1", "水", "みず", "名詞", "water", "matched", None)], "id long, lexeme_key string, lemma string, reading string, part_of_speech string, gloss string, dictionary_status string, known_at timestamp")
    occ = spark.createDataFrame([(1, 1, "水", 1)], "lexeme_id long, sentence_id long, surface string, n long")
    sen = spark.createDataFrame([(1, 4, 0, "水", "Water.")], "id long, source_id long, cue_index int, japanese string, english string")
    for prior, zipf in ((None, 9.0), ([("水", 5.5)], 5.5), ([("火", 5.5)], 0.0)):
        prior = prior and spark.createDataFrame(prior, "lemma string, zipf double")
        assert ranking.candidates(occ, sen, lex, prior).first().zipf == zipf


def test_review_sheet_has_21_columns(spark):
    cards_ = spark.createDataFrame([("c", 1, "k", "l", "r", None, None, "s", 1, 2, 3, "j", None, 4.5)], "card string, position int, lexeme_key string, lemma string, reading string, gloss string, part_of_speech string, series string, season int, episode int, sentence_id long, japanese string, english string, difficulty_score double")
    rows = spark.createDataFrame([("c", "gloss_support", "flagged", "medium", 0.5, 0.7), ("c", "unique_example", "passed", None, None, None)], "card string, code string, status string, severity string, score double, threshold double")
    reviews = spark.createDataFrame([("c", "gloss_support", "flag", None)], "card string, code string, verdict string, note string")
    sheet = audit.review_sheet(cards_, rows, reviews)
    assert len(sheet.columns) == 21
    got = [(r.criterion, r.threshold_distance, r.review_priority, r.review_verdict, r.review_note, r.gloss) for r in sheet.collect()]
    assert got == [("gloss_support", -0.2, "flagged", "flag", "", ""), ("unique_example", None, "pass_control", "", "", "")]
    found = audit.findings(rows, cards_.select("card", F.lit(None).cast("string").alias("expression")))
    assert [(r.finding, r.severity) for r in found.collect()] == [("weak_gloss_support", "medium")]


def test_the_analysis_that_most_needs_a_look(spark):
    rows = [(1, "expression", 0.2, 0.5), (1, "expression", 0.05, 0.5), (1, "ambiguous", 0.3, 0.1), (2, "expression", 0.2, 0.5), (2, "expression", 0.3, 0.1), (3, "components", -0.1, 0.5)]
    got = audit.worst_analyses(spark.createDataFrame(rows, "card int, decision string, margin double, opacity double"))
    assert {r.card: (r.expression, r.margin) for r in got.collect()} == {1: ("ambiguous", 0.3), 2: ("expression", 0.3), 3: ("components", -0.1)}


def test_excluded_lexemes(spark):
    lex = spark.createDataFrame([(1, "k1", "え", "感動詞", "oh", "matched"), (2, "k2", "走る", "動詞", None, "missing"), (3, "k3", "水", "名詞", "water", "matched")], "id long, lexeme_key string, lemma string, part_of_speech string, gloss string, dictionary_status string")
    occ = spark.createDataFrame([(i, 1, "x", i) for i in (1, 2, 3)], "lexeme_id long, sentence_id long, surface string, n long")
    sen = spark.createDataFrame([(1, 4, 0, "あ", None)], "id long, source_id long, cue_index int, japanese string, english string")
    got = [(r.lexeme_id, r.reason, r.position) for r in model.excluded_lexemes(occ, sen, lex).orderBy("position").collect()]
    assert got == [(2, "missing_definition", 1), (1, "reaction_fragment", 2)]


def test_episode_numbers(spark, tmp_path):
    names = ["[Group] Show - 07 [720p].mkv", "Show - 2 - 13 [x].SRT", "Show - 5.srt", "Show 12.mkv", "Show - 07 [a] b.mkv"]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    assert [r[0] for r in df.select(subtitles.episode_of(F.col("name"))).collect()] == [7, 13, 5, None, None]
    for n in names:
        (tmp_path / n).write_text("x")
    assert sorted(subtitles.discover_episode_files(tmp_path)) == [(5, ".srt"), (7, ".mkv"), (13, ".srt")]
    assert sorted((r.episode, r.extension) for r in subtitles.episode_files(spark, str(tmp_path)).collect()) == [(5, "srt"), (7, "mkv"), (13, "srt")]
    (tmp_path / "Show - 7.srt").write_text("")
    manifest = subtitles.build_manifest(tmp_path, "Show", 1, [7], english_track=2)
    assert manifest["episodes"][0]["english"] == {"track": 2} and manifest["episodes"][0]["video"].startswith(str(tmp_path.resolve()))
    streams = [{"index": 3, "tags": {"language": "jpn"}}, {"index": 4, "tags": {"language": "eng"}}]
    assert subtitles.chosen_stream(streams) == 4 and subtitles.chosen_stream(streams, track=0) == 3
    for wrong in ({"track": 2}, {"language": "fra"}):
        with pytest.raises(ValueError):
            subtitles.chosen_stream(streams, **wrong)
    src = spark.createDataFrame([(5, "Show", 1, 7)], "id long, series string, season int, episode int")
    assert subtitles.source_id(src, "Show", 1, 7) == 5
    with pytest.raises(KeyError):
        subtitles.source_id(src, "Show", 1, 8)


def test_streams_in_many_batches(spark, tmp_path):
    for n, rows in enumerate(["('a', timestamp'2024-01-01 00:10:00', 1, '1\n00:00:01,000 --> 00:00:02,000\none')", "('a', timestamp'2024-01-01 00:50:00', 2, '1\n00:00:01,000 --> 00:00:02,000\ntwo')", "('b', timestamp'2024-01-01 02:00:00', 1, 'nothing')"]):
        spark.sql(f"SELECT * FROM VALUES {rows} AS v(k, t, id, text)").coalesce(1).write.parquet(str(tmp_path / f"d{n}"))
    stream = lambda: spark.readStream.schema("k string, t timestamp, id int, text string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "d*"))
    got = {(r.kind, r.start.hour): r.n for r in state.window_counts(stream(), "k", "t").collect()}
    assert got == {("a", 0): 2, ("b", 2): 1}
    assert [(r.key, r.text) for r in state.ingested_cues(stream(), "id", "text").collect()] == [(2, "two")]  # document 1 came again without cues


def test_published_tables_are_always_whole(spark, tmp_path):
    path = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        published(spark, path)
    publish(spark.range(3), path)
    reader = published(spark, path)
    for n in (2, 5):
        publish(spark.range(n), path)
        assert published(spark, path).count() == n
        if n == 2:
            assert reader.count() == 3  # a reader that had begun
    assert len([p for p in (tmp_path / "t").iterdir() if p.name.startswith("v-")]) == 2


def test_words_of_lines_come_without_a_shuffle(spark):
    lines = spark.createDataFrame([(1, "水を飲んだ"), (2, "水を飲んだ"), (2, "水を飲んだ"), (3, None)], "id long, text string")
    found = morphs.morphs(lines, "id", "text")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("MapInArrow") == 1 and "ArrowEvalPython" not in plan
    got = sorted((r.sentence_id, r.position, r.surface, r.pos) for r in found.collect())
    words = [(0, "水", "名詞"), (1, "を", "助詞"), (2, "飲", "名詞"), (3, "んだ", "助動詞")]
    assert got == sorted((n, *w) for n in (1, 2, 2) for w in words)


def test_only_the_lexicon_is_analyzed_alone(spark, tmp_path):
    rows = spark.createDataFrame([(n, k, w, w, w, "名詞", k, k + 1) for n in range(40) for k, w in enumerate("水火土")], MORPH)
    lines = spark.createDataFrame([(n, "水火土", "water fire") for n in range(40)], "sentence_id long, text string, english string")
    lexicon = spark.createDataFrame([("水火", "水火", "スイカ", "water fire")], "surface string, lemma string, reading string, gloss string")
    parts = rows.select("sentence_id", "position", F.col("surface").alias("gloss"))
    asked = str(tmp_path / "asked")

    def analyze(text):
        with open(asked, "a", encoding="utf-8") as out:
            out.write(text + "\n")
        return [{"surface": c, "lemma": c, "reading": c, "pos": "名詞", "start": i, "end": i + 1} for i, c in enumerate(text)]

    found = morphs.analyses(morphs.expression_candidates(rows, lines), lexicon, parts, lines, english_words, analyze)
    assert found.count() == 40 and {r.decision for r in found.collect()} == {"expression"}
    assert open(asked, encoding="utf-8").read().split() == ["水火"]


def test_texts_of_cards_are_met_last(spark, monkeypatch):
    from tanmono.plans import audit_queries

    seen = []
    monkeypatch.setattr(audit_queries, "materialize", lambda df, tag: seen.append((tag, df)) or df)
    monkeypatch.setattr(audit_queries, "expression_rows", lambda *_: spark.createDataFrame([], "sentence_id long, start int, end int, decision string, margin double, opacity double"))
    audit_queries._cards(spark, "/root/testdata/sf0.001")
    plan = dict(seen)["cards"]._jdf.queryExecution().optimizedPlan().toString()
    last = next(x for x in plan.splitlines() if "Join Inner" in x)
    assert "sentence_id" in last and "lexeme_id" not in last
    assert "occurrences" in dict(seen)


def test_words_of_targets_are_no_rows(spark):
    from tanmono.plans import morph_queries

    text = "彼は食べました。何が食べ物"
    words = [("彼", "彼", "かれ", "代名詞"), ("は", "は", "は", "助詞"), ("食べ", "食べる", "タベ", "動詞"), ("まし", "ます", "マシ", "助動詞"), ("た", "た", "タ", "助動詞"), ("何", "何", "ナン", "代名詞"), ("食べ", "食べる", "タベ", "動詞"), ("物", "物", "モノ", "名詞")]
    spans = tokens.located([w[0] for w in words], text)
    analyze = lambda t: [dict(zip(("surface", "lemma", "reading", "pos"), w, strict=True), start=a, end=b) for w, (a, b) in zip(words, spans, strict=True)]
    lines = spark.createDataFrame([(1, text)], "sentence_id long, text string")
    readings = F.create_map(*(F.lit(x) for pair in {"彼": "カレ", "食べ": "タベ", "何": "ナニ", "物": "ブツ", "鳥": "トリ"}.items() for x in pair))
    asked = [(1, 7, "食べる", "食べ"), (1, 8, "物", "物"), (1, 9, "彼", "彼"), (1, 10, "何", "何"), (1, 11, "鳥", "鳥"), (2, 7, "食べる", "食べ")]
    targets = spark.createDataFrame(asked, "sentence_id long, id int, lemma string, surface string")
    found = morphs.inflected_targets(targets, lines, lambda surface: F.try_element_at(readings, surface), analyze)
    assert {r.id: (r.start, r.end) for r in found.collect()} == {7: (2, 7), 8: (12, 13), 9: (0, 1), 10: (8, 9), 11: (None, None)}
    plan = morph_queries.inflected_targets(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and plan.index("MapInArrow") < plan.index("Join")  # a line meets its targets before it is analyzed


def test_expressions_are_found_while_lines_are_analyzed(spark, monkeypatch):
    from tanmono.plans import morph_queries

    texts = ["水火土、水火土", "ああ水火 土", "水火", "水火土水が立つ", "東京水火、、", "", None, "abc水を飲む水火"]
    lines = spark.createDataFrame([(n, t, "Water fire stands." if n % 2 else "A flood.") for n, t in enumerate(texts)], "sentence_id long, text string, english string")

    def analyze(text):
        return [{"surface": c, "lemma": c, "reading": c, "pos": "補助記号" if c == "、" else "助詞" if c in "がを" else "助動詞" if c == "つ" else "名詞", "start": i, "end": i + 1} for i, c in enumerate(text) if c != " "]

    words = [("水火", "flood"), ("水火土", "water fire"), ("火土", "ash"), ("が立", "stand"), ("水", "water"), ("火", "fire"), ("水火土水", "water fire stands"), ("飲", "drink"), ("bc", "letters")]
    lexicon = spark.createDataFrame([(w, w, w, g) for w, g in words], "surface string, lemma string, reading string, gloss string")
    rows = morphs.morphs(lines, "sentence_id", "text", analyze)
    parts = morphs.component_tokens(rows).join(lexicon.select("surface", "gloss"), "surface", "left").select("sentence_id", "position", F.coalesce("gloss", "surface").alias("gloss"))
    old = morphs.analyses(morphs.expression_candidates(rows, lines), lexicon, parts, lines, english_words, analyze)
    new = morphs.line_analyses(lines, lexicon, english_words, analyze)
    assert sorted(map(tuple, new.select(old.columns).collect())) == sorted(map(tuple, old.collect())) and {r.decision for r in new.collect()} >= {"expression", "components"}
    chosen = morphs.with_expressions(rows, morphs.selected(old))
    assert sorted(map(tuple, morphs.lines_with_expressions(lines, morphs.taken_runs(new), analyze).collect())) == sorted(map(tuple, chosen.collect()))

    written = {}
    for module in (morphs, morph_queries):
        monkeypatch.setattr(module, "materialize", lambda df, tag, keep=module.materialize: written.setdefault(tag, keep(df, tag)))
    morph_queries.words_with_expressions(spark, "/root/testdata/sf0.001")
    assert "runs" in written and "morphs" not in written  # neither words nor runs that no form spells are kept or shuffled
    assert written["runs"].count() < 2 * written["lines"].count()


def test_many_surfaces_pass_the_filter(spark):
    surfaces = [f"水{n}" for n in range(5000)]
    bits = morphs.surface_filter(spark.createDataFrame([(s,) for s in surfaces], "surface string").repartition(3))
    word = lambda s: [{"surface": s[:1], "pos": "名詞", "start": 0, "end": 1}, {"surface": s[1:], "pos": "名詞", "start": 1, "end": len(s)}]
    assert all(morphs.runs_of_words(s, word, bits) for s in surfaces)
    assert sum(bool(morphs.runs_of_words(f"火{n}", word, bits)) for n in range(5000)) < 50


def test_analyses_meet_occurrences_once(spark):
    from tanmono.plans import morph_queries

    plan = morph_queries.overlapping_analyses(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "english" not in plan  # lines carry their analyses, so neither is joined with occurrences by itself


@pytest.fixture(scope="module")
def audited(spark):
    from tanmono.plans import audit_queries

    return audit_queries._audited(spark, "/root/testdata/sf0.001")


def audit_plan(monkeypatch, spark, audited, name):
    from tanmono.plans import audit_queries

    monkeypatch.setattr(audit_queries, "_audited", lambda *_: audited)
    return audit_queries.QUERIES[name][0](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()


def test_cards_are_kept_without_texts(spark, audited, monkeypatch):
    assert not {"english", "gloss", "japanese", "text"} & set(audited[0].columns)
    plan = audit_plan(monkeypatch, spark, audited, "audit_criteria")
    assert "Join" not in plan and "Window" not in plan
    found = [(0, 2, "components", 0.5, 0.5), (1, 3, "ambiguous", 0.2, 0.5), (5, 8, "expression", 0.05, 0.5)]
    spans = [(1, 0, 2), (2, 4, 6), (3, 8, 9), (4, None, None)]
    rows = spark.createDataFrame([(*s, found) for s in spans], "card int, start int, end int, found array<struct<start:int,end:int,decision:string,margin:double,opacity:double>>")
    got = {r.card: r.w and (r.w.decision, r.w.margin) for r in rows.select("card", audit.worst_of("found").alias("w")).collect()}
    assert got == {1: ("ambiguous", 0.2), 2: ("expression", 0.05), 3: None, 4: ("ambiguous", 0.2)}


def test_totals_read_occurrences_once(spark, audited, monkeypatch):
    assert audit_plan(monkeypatch, spark, audited, "audit_totals").count("Join") == 1  # the examples with the excluded lexemes


def test_findings_need_no_join(spark, audited, monkeypatch):
    plan = audit_plan(monkeypatch, spark, audited, "audit_findings")
    assert "Join" not in plan and "Window" not in plan


def test_agreement_needs_no_join(spark, audited, monkeypatch):
    plan = audit_plan(monkeypatch, spark, audited, "review_agreement")
    assert "Join" not in plan and "Window" not in plan


def test_priorities_need_no_join(spark, audited, monkeypatch):
    plan = audit_plan(monkeypatch, spark, audited, "audit_priorities")
    assert "Join" not in plan and "Window" not in plan


def test_clean_cards_need_no_join(spark, audited, monkeypatch):
    plan = audit_plan(monkeypatch, spark, audited, "clean_cards")
    assert "Join" not in plan and "Window" not in plan
