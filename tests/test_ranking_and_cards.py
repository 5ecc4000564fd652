"""Difficulty, plans, decisions, votes, audits, cards, sinks and streams."""

import csv
import datetime as dt
import os
import json
import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tanmono.operators import audit, cards, dictionary, model, ranking, semantics, tokens
from tanmono.plans import flow_queries
from tanmono.plans.storage import materialize, release, shared_dir
from tanmono.sinks import card_service, reports
from tanmono.sources import subtitles
from tanmono.streaming import state


def test_fixed_curves():
    assert [ranking.desired_words(p) for p in (0, 5, 30, 100)] == [2, 3, 8, 8]
    assert ranking.context_weight(0) == 3.0 and ranking.context_weight(30) == 0.6
    with pytest.raises(ValueError):
        ranking.difficulty("other")


def naive_plan(rows, limit, window=500):
    known, used, plan, left = set(), set(), [], list(enumerate(rows))
    for position in range(limit):
        options = []
        for part in (left[:window], left[window:]):
            for rank, row in part:
                for e in row["examples"]:
                    if e["sentence_id"] in used:
                        continue
                    gaps = [o["gap"] for o in e["others"] if o["id"] not in known]
                    score = e["fixed"] + sum(10 + (8 if g is None or g > 0 else 0) + (g or 0) for g in gaps)
                    score += 1.25 * abs(e["n_words"] - ranking.desired_words(position)) + (max(0, 5 - 0.15 * position) if e["colloquial"] else 0)
                    score = round(score, 9)
                    options.append((round(row["difficulty"] + ranking.context_weight(position) * score, 9), row["difficulty"], rank, score, e["sentence_id"], e["surface"]))
            if options:
                break
        if not options:
            break
        joint, _, rank, score, sentence, surface = min(options)
        left = [x for x in left if x[0] != rank]
        known.add(rows[rank]["lexeme_id"])
        used.add(sentence)
        plan.append((rows[rank]["lexeme_id"], sentence, surface, joint))
    return plan


@pytest.mark.parametrize("seed", range(6))
def test_plan_equals_a_naive_one(seed):
    rng = random.Random(seed)
    rows = []
    for lexeme in range(25):
        examples = [
            {
                "sentence_id": rng.randrange(40), "surface": rng.choice("ab"), "n_words": rng.randrange(1, 9), "fixed": rng.randrange(40) / 4, "colloquial": rng.random() < 0.3,
                "others": [{"id": o, "gap": rng.choice([None, 0.0, 3.5])} for o in rng.sample(range(30), rng.randrange(4)) if o != lexeme],
            }
            for _ in range(rng.randrange(4))
        ]
        rows.append({"lexeme_id": lexeme, "difficulty": rng.randrange(100) / 2, "examples": examples})
    got = ranking.plan_greedily(rows, 15, 6)
    assert [(r["lexeme_id"], r["sentence_id"], r["surface"], r["joint_score"]) for r in got] == naive_plan(rows, 15, 6)
    assert len({r["sentence_id"] for r in got}) == len(got)


def test_plan_without_examples():
    assert ranking.plan_greedily([{"lexeme_id": 1, "difficulty": 1.0, "examples": []}], 5) == [] and ranking.plan_greedily([], 5) == []


def test_components_of_noise_and_quality(spark):
    rows = [("うん", "副詞", "うん…", None, 1, 1, 1), ("走る", "動詞", "彼は走る", "He runs", 3, 2, 100), ("あ", "名詞", "あ", "", 1, 1, 1)]
    df = spark.createDataFrame([(*r, 3.0) for r in rows], "lemma string, part_of_speech string, japanese string, english string, n_words int, n_unknown int, source_count long, zipf double")
    got = {r.lemma: r for r in ranking.components(df).collect()}
    assert got["うん"].c_noise == 1.0 and got["あ"].c_noise == 0.8 and got["走る"].c_noise == 0.0
    assert got["うん"].c_quality == 0.8 and got["走る"].c_quality == 0.0
    assert got["走る"].c_source == 0.1 and got["走る"].c_sentence == round(0.7 * 0.5 + 0.3 * 0.1, 6)


def test_upserts(spark):
    df = spark.createDataFrame([(1, "a", 5), (1, "b", 9), (1, None, 7), (2, None, 1)], "id int, title string, at int")
    got = model.upserted(df, ["id"], [F.col("at")], "at").orderBy("id").collect()
    assert [tuple(r) for r in got] == [(1, "b", 5), (2, None, 1)]


def test_labels_keep_order_and_repeats(spark):
    lex = spark.createDataFrame([(1, "走る", "はしる"), (2, "水", "みず")], "id long, lemma string, reading string")
    asked = spark.createDataFrame([(7, [2, 9, 1, 2]), (8, [])], "key int, ids array<long>")
    got = {r.key: r.labels for r in model.lexeme_labels(asked, lex).collect()}
    assert got == {7: ["水（みず）", "走る（はしる）", "水（みず）"], 8: []}


def decided(spark, *row):
    df = spark.createDataFrame([row], "p double, c double, w double, n int, alone boolean, particle boolean")
    return df.select(semantics.decide(*(F.col(x) for x in df.columns)).alias("d")).first().d.decision


def test_decisions(spark):
    assert decided(spark, 0.85, 0.80, 0.8, 2, False, False) == "expression"
    assert decided(spark, 0.85, 0.82, 0.8, 2, False, False) == "ambiguous"
    assert decided(spark, 0.85, 0.82, 0.8, 2, True, False) == "expression"
    assert decided(spark, 0.80, 0.85, 0.8, 2, False, False) == "components"
    assert decided(spark, 0.90, 0.80, 0.85, 2, False, True) == "expression"
    assert decided(spark, 0.90, 0.80, 0.99, 1, False, False) == "expression"
    assert decided(spark, None, 0.8, 0.8, 2, False, False) == "insufficient_evidence"


def test_reading_votes(spark):
    df = spark.createDataFrame([("はし", ["ハシ", "キョウ"], True), ("はし", ["キョウ", "キョウ"], True), ("はし", [None, ""], True), ("はし", ["ハシ"], False), ("", ["ハシ"], True)], "e string, v array<string>, s boolean")
    got = [r[0] for r in df.select(semantics.reading_consensus(F.col("e"), F.col("v"), F.col("s"))).collect()]
    assert got == ["agreement", "disagreement", "unresolved", "unresolved", "unresolved"]


def test_nearest_in_rounds(spark, monkeypatch):
    rng = random.Random(1)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(4)]) for i in range(60)] + [(60, None)]
    df = spark.createDataFrame(rows, "id long, vector array<float>")
    plain = sorted(map(tuple, semantics.nearest(df.filter("id % 10 = 0"), df, 3).collect()))
    monkeypatch.setattr(semantics, "QUERIES_AT_ONCE", 2)
    assert sorted(map(tuple, semantics.nearest(df.filter("id % 10 = 0"), df, 3).collect())) == plain and len(plain) == 18


def test_dictionary_overrides_and_order(spark):
    words = spark.createDataFrame([(1, "ない", "ナイ", "形容詞", None), (2, "橋", "ハシ", "名詞", "a bridge"), (3, "箸", "ハシ", "感動詞", None), (4, "無", None, None, None)], "id long, lemma string, reading string, pos string, context string")
    entries = spark.createDataFrame([(10, ["ichi1"], False), (11, [], False)], "entry_id long, tags array<string>, kana_usual boolean")
    forms = spark.createDataFrame([(10, "kanji", "橋"), (10, "kana", "はし"), (11, "kanji", "箸"), (11, "kana", "はし")], "entry_id long, kind string, text string")
    senses = spark.createDataFrame([(10, 0, "noun", False, ["bridge", "bridge", "span"]), (10, 1, "noun", False, ["link"]), (11, 0, "noun", False, ["chopsticks"])], "entry_id long, sense_index int, sense_pos string, kana_usual boolean, glosses array<string>")
    got = {r.id: (r.entry_id, r.sense_index, r.gloss) for r in dictionary.resolve(words, entries, forms, senses).collect()}
    assert got == {1: (1529520, 3, "not; nonexistent; without"), 2: (10, 0, "bridge; span")}


def audited(spark, rows):
    schema = "card int, english string, gloss string, pos string, sentence_id int, alignment double, support double, n_harder int, reading_status string, reading_decisive boolean, expression string, margin double, opacity double"
    return audit.criteria(spark.createDataFrame(rows, schema))


def test_audit(spark):
    fine = ("Good.", "good", "名詞", 1, 0.9, 0.8, 0, "agreement", False, None, None, None)
    bad = (None, "", "動詞", 2, 0.1, 0.1, 2, "disagreement", True, "expression", 0.05, 0.5)
    weak = ("Hm.", "hm", "名詞", 2, 0.70, 0.69, 0, "disagreement", True, "ambiguous", 0.01, 0.5)
    rows = audited(spark, [(1, *fine), (2, *bad), (3, *weak)])
    got = {(r.card, r.code): (r.status, r.severity) for r in rows.collect()}
    assert len(got) == 24 and all(got[1, c][0] == "passed" for _, c in got if _ == 1)
    assert got[2, "translation_available"] == ("flagged", "high") and got[2, "translation_alignment"][0] == "not_checked" and got[2, "contextual_reading"][0] == "not_checked"
    assert got[3, "translation_alignment"] == ("flagged", "high") and got[3, "contextual_reading"] == ("flagged", "high") and got[3, "unique_example"][0] == "flagged"
    assert [r.card for r in audit.clean_cards(rows).collect()] == [1]
    near = {(r.card, r.code): r.priority for r in audit.review_priority(rows).collect()}
    assert near[1, "gloss_support"] == "pass_control" and near[3, "gloss_support"] == "flagged"
    reviews = spark.createDataFrame([(1, "gloss_support", "flag"), (3, "gloss_support", "flag"), (2, "gloss_support", "uncertain"), (9, "gloss_support", "flag"), (1, "nonsense", "flag"), (1, "gloss_support", "maybe")], "card int, code string, verdict string")
    valid, wrong = cards.valid_reviews(reviews, rows)
    assert valid.count() == 3 and wrong.count() == 3
    assert tuple(audit.agreement(rows, valid).first()) == ("gloss_support", 3, 1, 1, 0, 1)


def test_gate():
    card = lambda i, s, d, words, faults=(), other=(): {"lexeme_id": i, "sentence_id": s, "difficulty": d, "words": words, "findings": list(faults), "alternatives": list(other)}
    other = lambda s, needs, findings=(): {"sentence_id": s, "needs": needs, "findings": list(findings)}
    rows = [
        card(1, 1, 10.0, [1]), card(2, 2, 50.0, [2], ["x"]), card(3, 3, 20.0, [2, 3]), card(4, 4, 60.0, [2, 4]),
        card(5, 5, 30.0, [5, 9], ["x"], [other(1, []), other(5, []), other(6, [8]), other(8, [], ["y"]), other(7, [1])]), card(6, 7, 10.0, [6]),
        card(7, 9, 10.0, [7], ["x", "x"], [other(10, [])]),
    ]
    accepted, rejected = cards.gate(rows, 9)
    # A word known before the plan is no need, so card 7 takes its alternative; a planned sentence is no fault even where another card shows it.
    assert [(c["lexeme_id"], c["sentence_id"], c.get("replaced"), c["unknown_again"]) for c in accepted] == [
        (1, 1, None, []), (4, 4, None, [2]), (5, 7, 5, []), (6, 7, None, []), (7, 10, 9, []),
    ]
    assert {c["lexeme_id"]: c["reasons"] for c in rejected} == {2: ["x"], 3: ["rejected_word_became_harder_context"]}
    assert len(cards.gate(rows, 1)[0]) == 1 and cards.gate(rows, 0) == ([], [])


def test_bounded_examples_keep_the_plan(spark):
    rng = random.Random(4)
    pool, parts = [], []
    for lexeme in range(30):
        pool.append((1, lexeme, lexeme + 1, rng.randrange(100) / 2))
        for sentence in rng.sample(range(200), 40 if lexeme % 3 else 2):
            others = [(o, rng.choice([None, 0.0, 3.5])) for o in rng.sample(range(60), rng.randrange(5)) if o != lexeme]
            for surface in "ab"[: rng.randrange(1, 3)]:
                parts.append((1, lexeme, sentence, surface, 0, 1.0, rng.randrange(1, 9), rng.randrange(60) / 4, rng.random() < 0.3, others))
    pool = spark.createDataFrame(pool, "source_id long, lexeme_id long, rank int, difficulty double")
    schema = "source_id long, lexeme_id long, sentence_id long, surface string, cue_index int, difficulty double, n_words int, fixed double, colloquial boolean, others array<struct<id:long,gap:double>>"
    parts = spark.createDataFrame(parts, schema)
    kept = ranking.bounded_examples(parts, pool, 6)
    assert 0 < kept.count() < 0.8 * parts.count()
    group = lambda df: {r.lexeme_id: [e.asDict(True) for e in r.examples] for r in df.groupBy("lexeme_id").agg(F.collect_list(F.struct("*")).alias("examples")).collect()}
    rows = [r.asDict() for r in pool.orderBy("rank").collect()]
    plans = [ranking.plan_greedily([r | {"examples": held.get(r["lexeme_id"], [])} for r in rows], 6) for held in (group(parts), group(kept))]
    assert plans[0] == plans[1] and len(plans[0]) == 6


def test_reserved_sentences_belong_to_their_cards(spark):
    parts = spark.createDataFrame([(1, 1, 10), (1, 2, 10), (1, 2, 11), (1, 3, 12)], "source_id long, lexeme_id long, sentence_id long")
    reserved = spark.createDataFrame([(10, 1), (12, 9), (None, 5)], "sentence_id long, lexeme_id long")
    assert sorted((r.lexeme_id, r.sentence_id) for r in ranking.unreserved(parts, reserved).collect()) == [(1, 10), (2, 11)]


def test_scopes_add_up_their_sources(spark):
    occ = spark.createDataFrame([(1, 1, "a", 2), (1, 2, "a", 3), (2, 2, "b", 1), (1, 3, "a", 1)], "lexeme_id long, sentence_id long, surface string, n long")
    sen = spark.createDataFrame([(i, i, 0, "あ" * 14, "x") for i in (1, 2, 3)], "id long, source_id long, cue_index long, japanese string, english string")
    lex = spark.createDataFrame([(1, "k1", "a", "名詞", "g", None, None), (2, "k2", "b", "名詞", "g", None, None)], "id long, lexeme_key string, lemma string, part_of_speech string, gloss string, dictionary_status string, known_at timestamp")
    lex = lex.withColumn("reading", F.lit("あ"))
    scopes = spark.createDataFrame([(7, 1), (7, 2), (8, 1), (7, 1), (9, 4)], "scope_id long, source_id long")
    rows = ranking.ranked(ranking.candidates(occ, ranking.scoped(sen, scopes), lex), ["hybrid"])
    got = {(r.source_id, r.lexeme_id): (r.source_count, r.sentence_id) for r in rows.collect()}
    assert got == {(7, 1): (5, 2), (7, 2): (1, 2), (8, 1): (2, 1)}  # two words in sentence 2 are better than one


def test_card_actions(spark):
    held = spark.createDataFrame([(1, 10, 0), (2, 20, 0), (3, 30, 4)], "lexeme_id long, card_id long, reps long")
    pulled = spark.createDataFrame([(10, 2), (30, 5)], "card_id long, reps long")
    now = cards.learned(held, pulled)
    assert {r.lexeme_id: (r.reps, r.learned) for r in now.collect()} == {1: (2, True), 2: (0, False), 3: (5, False)}
    plan = spark.createDataFrame([(1, 5), (2, 6), (4, 7)], "lexeme_id long, sentence_id long")
    assert {r.lexeme_id: r.action for r in cards.actions(plan, now).collect()} == {2: "move", 4: "add"}


def test_card_service():
    calls = []

    def invoke(action, **params):
        calls.append(action)
        return {"modelNames": ["M"], "modelFieldNames": ["A"], "cardsInfo": [{"cardId": 1, "reps": 2}, {}]}.get(action)

    card_service.ensure_model(invoke, "M", ["A", "B"], {"T": {"Front": "", "Back": ""}}, "")
    assert calls == ["modelNames", "modelFieldNames", "modelFieldAdd", "updateModelTemplates", "updateModelStyling"]
    assert card_service.pulled_reviews(invoke, [1, 2]) == [(1, 2)]
    rows = [{"action": "add", "fields": {}}, {"action": "move", "card_id": 1, "note_id": 2, "fields": {}}]
    assert card_service.push(invoke, "D", "M", rows) == {"add": 1, "move": 1}


def test_snapshots(spark, tmp_path):
    df = spark.range(3)
    cards.snapshot(df, str(tmp_path / "a"))
    with pytest.raises(Exception, match="(?i)exist"):
        cards.snapshot(df, str(tmp_path / "a"))
    cards.snapshot(spark.range(2), str(tmp_path / "a"), replace=True)
    assert spark.read.parquet(str(tmp_path / "a")).count() == 2


def test_reports(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([(1, "<走る>", [1, 2])], "card int, t string, a array<int>")
    reports.write_json(df, tmp_path / "r.json", metric="hybrid")
    assert json.loads((tmp_path / "r.json").read_text())["rows"][0]["a"] == [1, 2]
    reports.write_csv(df, str(tmp_path / "c"))
    assert spark.read.csv(str(tmp_path / "c"), header=True).first().a == "[1,2]"
    reports.render_table(df, "T", tmp_path / "t.html")
    assert "&lt;走る&gt;" in (tmp_path / "t.html").read_text()
    reports.render_cards(df.select(F.lit("f").alias("front"), F.lit("b").alias("back")), "T", tmp_path / "p.html")
    assert "<summary>f</summary>" in (tmp_path / "p.html").read_text()
    sheet = spark.createDataFrame([(1, "gloss_support"), (2, "gloss_support")], "position int, criterion string")
    assert reports.write_review_sheet(sheet, tmp_path / "s.csv") == 2
    with (tmp_path / "s.csv").open() as file:
        rows = list(csv.DictReader(file))
    rows[0] |= {"verdict": " Flag ", "note": " "}
    with (tmp_path / "s.csv").open("w") as file:
        out = csv.DictWriter(file, rows[0])
        out.writeheader()
        out.writerows(rows)
    assert [tuple(r) for r in subtitles.read_reviews(spark, str(tmp_path / "s.csv")).collect()] == [(1, "gloss_support", "flag", None)]
    monkeypatch.setattr(reports, "PAGE_ROWS", 0)
    with pytest.raises(ValueError):
        reports.write_json(df, tmp_path / "r.json")


def test_streams_keep_first_events_over_batches(spark, tmp_path):
    schema = "u long, t timestamp"
    for n, rows in enumerate(["(1, timestamp'2024-01-02'), (2, timestamp'2024-01-05')", "(1, timestamp'2024-01-01'), (null, timestamp'2024-01-01')"]):
        spark.sql(f"SELECT * FROM VALUES {rows} AS v(u, t)").coalesce(1).write.parquet(str(tmp_path / f"d{n}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "d*"))
    got = {r.key: str(r.first_at)[:10] for r in state.first_events(stream, "u", "t").collect()}
    assert got == {1: "2024-01-01", 2: "2024-01-05"}


def test_storage(spark):
    df = materialize(spark.range(5), "t")
    folder = df.inputFiles()[0].rsplit("/", 1)[0].replace("file://", "")
    assert df.count() == 5 and folder.startswith(shared_dir(spark).replace("file://", ""))
    release(spark, df)
    assert not os.path.exists(folder)


def test_table_maintenance(spark):
    df = spark.createDataFrame([(1, 5), (2, None), (3, 9)], "id long, s long")
    assert model.migrated(df, {"s": "long", "new": "string"}).columns == ["id", "s", "new"]
    there = spark.createDataFrame([(5,), (5,)], "k long")
    assert {tuple(r) for r in model.cleared_references(df, "s", there, "k").collect()} == {(1, 5), (2, None), (3, None)}
    cards_ = spark.createDataFrame([(1, 5), (2, 5), (3, None), (4, None)], "lexeme_id long, sentence_id long")
    assert [tuple(r) for r in model.shared_examples(cards_).collect()] == [(5, 2)]
    stored = spark.createDataFrame([(1, "a", 0.5), (2, "b", None), (3, "c", 0.9)], "id long, gloss string, conf double")
    fresh = spark.createDataFrame([(1, "x", 0.5, 1), (2, "y", 0.1, 2), (2, "z", 0.1, 3), (3, "w", 0.95, 4)], "id long, gloss string, conf double, at int")
    got = {r.id: r.gloss for r in model.more_confident(stored, fresh, "id", "gloss", "conf", "at").collect()}
    assert got == {1: "a", 2: "y", 3: "w"}


def test_identity_of_tokens(spark):
    assert tokens.located(["走", "る", "走", "x"], "走る 走") == [(0, 1), (1, 2), (3, 4), (4, 4)]
    rows = spark.createDataFrame([("a", "b"), ("c", "b"), ("a", "c"), ("x", "y")], "f string, s string")
    forms = spark.createDataFrame([("b",), ("c",)], "text string")
    got = {(r.f, r.s): r.lemma for r in tokens.dictionary_forms(rows, forms, "f", "s").collect()}
    assert got == {("a", "b"): "b", ("c", "b"): "c", ("a", "c"): "c", ("x", "y"): "x"}
    one = tokens.single_words(spark.createDataFrame([("ab",), ("a",), ("a.",)], "surface string"), lambda x: [{"surface": c} for c in x])
    assert {r.surface for r in one.collect()} == {"a", "a."}


def test_event_windows_do_not_depend_on_the_number_of_files(spark, tmp_path):
    folder = tmp_path / "events.parquet"
    folder.mkdir()
    for i in range(101):  # the last file is a third batch and holds the earliest event
        ts = dt.datetime(2024, 1, 2, 12) if i < 100 else dt.datetime(2024, 1, 1, 3)
        table = pa.table({"event_type": ["click"], "ts": pa.array([ts], pa.timestamp("us"))})
        pq.write_table(table, folder / f"{i:03}.parquet")
        os.utime(folder / f"{i:03}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    got = {(r.event_type, r.start_s): r.n for r in flow_queries.stream_event_windows(spark, str(tmp_path)).collect()}
    assert got == {("click", 1704196800): 100, ("click", 1704078000): 1}
