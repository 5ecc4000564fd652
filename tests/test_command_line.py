import json
from pathlib import Path

import pytest

from tanmono.__main__ import main
from tanmono.plans.storage import published

DATA = Path("/root/testdata/sf0.001")


def test_list(capsys):
    main(["list"])
    assert "unseen_queue" in capsys.readouterr().out.split()


def test_manifest_and_ingest(spark, tmp_path):
    (tmp_path / "Show - 01.mkv").write_text("")
    (tmp_path / "Show - 01.srt").write_text("1\n00:00:01,000 --> 00:00:02,000\nhello\n")
    main(["build-manifest", str(tmp_path), "Show", "1", "1", "--out", str(tmp_path / "m.json")])
    assert json.loads((tmp_path / "m.json").read_text())["episodes"][0]["episode"] == 1
    main(["ingest", str(tmp_path / "Show - 01.srt"), "--out", str(tmp_path / "cues")])
    assert [r.text for r in spark.read.parquet(str(tmp_path / "cues")).collect()] == ["hello"]


@pytest.mark.skipif(not DATA.exists(), reason="the test tables are not here")
def test_queries_go_to_files(spark, tmp_path):
    main(["stats", "--data", str(DATA), "--out", str(tmp_path / "s.json")])
    assert {r["name"] for r in json.loads((tmp_path / "s.json").read_text())["rows"]} == {"sources", "sentences", "lexemes", "known"}
    src = spark.read.parquet(f"{DATA}/sources.parquet").orderBy("id").first()
    scope = ["--series", src.series, "--season", str(src.season), "--episodes", str(src.episode)]
    main(["candidates", "--data", str(DATA), *scope, "--out", str(tmp_path / "q")])
    assert {r.source_id for r in spark.read.parquet(str(tmp_path / "q")).select("source_id").distinct().collect()} == {src.id}
    with pytest.raises(SystemExit):
        main(["candidates", "--data", str(DATA), "--series", src.series, "--episodes", "9999"])


@pytest.mark.skipif(not DATA.exists(), reason="the test tables are not here")
def test_plans_over_episodes_and_calibration_batches(spark, tmp_path):
    src = spark.read.parquet(f"{DATA}/sources.parquet").orderBy("id").first()
    scope = ["--data", str(DATA), "--series", src.series, "--season", str(src.season)]
    main(["plan", *scope, "--limit", "5", "--out", str(tmp_path / "p")])
    plan = spark.read.parquet(str(tmp_path / "p")).collect()
    assert sorted(r.position for r in plan) == [1, 2, 3, 4, 5] and {r.source_id for r in plan} == {0}
    main(["plan-calibration", *scope, "--limit", "5", "--name", "b", "--out", str(tmp_path / "b")])
    assert {(r.batch, r.complete) for r in spark.read.parquet(str(tmp_path / "b")).collect()} == {("b", True)}
    with pytest.raises(Exception, match="(?i)exist"):
        main(["plan-calibration", *scope, "--limit", "5", "--name", "b", "--out", str(tmp_path / "b")])


@pytest.mark.skipif(not DATA.exists(), reason="the test tables are not here")
def test_ingestion_and_known_words(spark, tmp_path, capsys):
    for name, text in (("ja", "水を飲む"), ("en", "Drink water.")):
        (tmp_path / f"{name}.srt").write_text(f"1\n00:00:01,000 --> 00:00:02,000\n{text}\n")
    out = str(tmp_path / "m")
    main(["ingest-model", "--data", str(DATA), "--source-id", "1", "--japanese", str(tmp_path / "ja.srt"), "--english", str(tmp_path / "en.srt"), "--out", out])
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1]) == {"sentences": 1, "occurrences": 4}
    assert [(r.japanese, r.english) for r in published(spark, f"{out}/sentences").filter("source_id = 1").collect()] == [("水を飲む", "Drink water.")]
    (tmp_path / "known.txt").write_text("本当\n\n本当\n")
    before = spark.read.parquet(f"{DATA}/lexemes.parquet").filter("lemma = '本当' OR known_at IS NOT NULL").select("id").distinct().count()
    main(["mark-known", "--data", str(DATA), "--lemmas", str(tmp_path / "known.txt"), "--out", str(tmp_path / "lex")])
    assert published(spark, str(tmp_path / "lex")).filter("known_at IS NOT NULL").count() == before


@pytest.mark.skipif(not DATA.exists(), reason="the test tables are not here")
def test_manifests_are_ingested_at_once(spark, tmp_path, capsys):
    episodes = []
    for n in (1, 2):
        for side, text in (("ja", "水を飲む"), ("en", "Drink water.")):
            (tmp_path / f"{n}.{side}.srt").write_text(f"1\n00:00:01,000 --> 00:00:02,000\n{text}\n")
        episodes.append({"episode": n, "video": f"{n}.mkv", "japanese": {"srt": f"{n}.ja.srt"}, "english": {"srt": f"{n}.en.srt"}})
    (tmp_path / "m.json").write_text(json.dumps({"series": "New", "season": 1, "episodes": episodes}))
    out = str(tmp_path / "m")
    main(["ingest-manifest", str(tmp_path / "m.json"), "--data", str(DATA), "--out", out])
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1]) == {"episodes": [1, 2], "sentences": 2, "occurrences": 8}
    new = published(spark, f"{out}/sources").filter("series = 'New'").orderBy("episode").collect()
    assert [r.episode for r in new] == [1, 2]
    lines = published(spark, f"{out}/sentences").filter(f"source_id >= {new[0].id}")
    assert {(r.source_id, r.japanese, r.english) for r in lines.collect()} == {(r.id, "水を飲む", "Drink water.") for r in new}
