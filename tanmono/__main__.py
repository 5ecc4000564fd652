"""Command line: python -m tanmono COMMAND. Tables are read from --data, results go to --out or to the terminal."""

from __future__ import annotations

import argparse
import json
import sys
from datetime import datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tanmono.operators import cards, ingest, model, ranking, tokens
from tanmono.plans import audit_queries, flow_queries, meaning_queries, model_queries, morph_queries, text_queries
from tanmono.session import local_session
from tanmono.plans.storage import publish, published
from tanmono.sinks import card_service, reports
from tanmono.sources import subtitles

QUERIES = {name: query for m in (text_queries, model_queries, meaning_queries, morph_queries, audit_queries, flow_queries) for name, (query, _) in m.QUERIES.items()}
#: Commands that are one query each.
COMMANDS = {
    "stats": "corpus_stats", "coverage": "vocabulary_growth", "compare-difficulty": "metric_comparison", "candidates": "unseen_queue", "queue": "planned_batch",
    "audit": "audit_criteria", "audit-findings": "audit_findings", "audit-summary": "audit_totals", "enrich-dictionary": "resolved_words", "excluded": "excluded_lexemes",
    "clean-preview": "clean_selection", "sync-actions": "card_actions",
}


def _chosen(spark: SparkSession, args: argparse.Namespace) -> DataFrame | None:
    """(id, episode) of the asked episodes, all of which must exist; None if no series was named."""
    if not args.series:
        return None
    episodes = subtitles.parse_episodes(args.episodes) if args.episodes else None
    chosen = subtitles.selected_sources(model.sources(spark, args.data), args.series, args.season, episodes)
    have = {r.episode for r in chosen.collect()}
    if episodes is not None and (lacking := sorted(set(episodes) - have)):
        sys.exit(f"no source for episodes {lacking}")
    return chosen


def _scoped(df: DataFrame, spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """Only the rows of the asked episodes."""
    chosen = _chosen(spark, args)
    if chosen is None:
        return df
    if "source_id" in df.columns:
        return df.join(chosen.select(F.col("id").alias("source_id")), "source_id", "left_semi")
    return df.filter((F.col("series") == args.series) & (F.col("season") == args.season)) if "series" in df.columns else df


def _plan(spark: SparkSession, args: argparse.Namespace, known: DataFrame | None = None) -> DataFrame:
    """One plan over all asked episodes together; without a series, one for each source."""
    occ, sen, lex = model_queries.kept_model(spark, args.data)
    if known is not None:
        met = lex.join(known.select(F.col("lexeme_id").alias("id"), F.lit(True).alias("_now")).distinct(), "id", "left")
        lex = met.withColumn("known_at", F.coalesce("known_at", F.when(F.col("_now"), F.current_timestamp()))).drop("_now")
    chosen = _chosen(spark, args)
    if chosen is not None:
        sen = ranking.scoped(sen, chosen.select(F.lit(0).cast("bigint").alias("scope_id"), F.col("id").alias("source_id")))
    rows = model_queries.materialize(ranking.scored(ranking.candidates(occ, sen, lex), [args.metric]), "scored")
    pool = model_queries.materialize(ranking.with_ranks(rows, ranking.pool_size(args.limit)), "pool")
    reserved = spark.read.parquet(args.state).select("sentence_id", "lexeme_id") if getattr(args, "state", None) else None
    return ranking.planned(pool, ranking.example_parts(rows, occ, sen, lex, pool), args.limit, reserved)


def _into_model(spark: SparkSession, args: argparse.Namespace, japanese: DataFrame, english: DataFrame) -> dict[str, int]:
    """Cues of sources into the model; the new tables go below --out. Sentences and occurrences of these sources."""
    occ, sen, lex = model.occurrences(spark, args.data), model.sentences(spark, args.data), model.lexemes(spark, args.data)
    held = spark.createDataFrame([], "lexeme_id long, sentence_id long")
    planned = spark.createDataFrame([], "batch_id long, sentence_id long")
    fresh = ingest.fresh_sentences(japanese, english)
    after = ingest.ingested(ingest.Tables(sen, occ, lex, held, planned), fresh, lambda rows, key, text: tokens.content_words(tokens.default_tokens(rows, key, text)))
    for name in ("sentences", "occurrences", "lexemes"):
        publish(getattr(after, name), f"{args.out.rstrip('/')}/{name}")
    lines = published(spark, f"{args.out.rstrip('/')}/sentences").join(japanese.select("source_id").distinct(), "source_id", "left_semi")
    sentences, words = ingest.totals(after, lines)
    return {"sentences": sentences, "occurrences": int(words)}


def _ingest(spark: SparkSession, args: argparse.Namespace) -> None:
    """Subtitle files of one source into the model."""
    cue = [F.lit(args.source_id).cast("bigint").alias("source_id"), F.col("cue").alias("cue_index"), F.col("start").alias("start_ms"), F.col("end").alias("end_ms"), "text"]
    japanese = subtitles.read_srt(spark, args.japanese).select(*cue)
    english = subtitles.read_srt(spark, args.english).select(*cue) if args.english else japanese.limit(0)
    print(json.dumps(_into_model(spark, args, japanese, english)))


def _ingest_manifest(spark: SparkSession, args: argparse.Namespace) -> None:
    """The episodes of a manifest that the sources lack, all at once; English comes from a file or from a track of the video."""
    episodes = subtitles.parse_episodes(args.episodes) if args.episodes else None
    src = model.sources(spark, args.data)
    lacking = subtitles.not_yet_ingested(subtitles.read_manifest(spark, args.manifest, episodes), src).orderBy("series", "season", "episode").collect()
    first = (src.agg(F.max("id")).first()[0] or 0) + 1
    texts: dict[str, list] = {"japanese": [], "english": []}
    added = []
    for n, row in enumerate(r.asDict(recursive=True) for r in lacking):
        paths = {"japanese": subtitles.resolve_path(row["japanese"]["srt"], args.manifest)}
        english, video = row.get("english") or {}, subtitles.resolve_path(row["video"], args.manifest)
        if english.get("srt"):
            paths["english"] = subtitles.resolve_path(english["srt"], args.manifest)
        elif english.get("track") is not None:
            paths["english"] = Path(f"{args.out.rstrip('/')}-{row['episode']}.srt")
            subtitles.extract_stream(video, subtitles.chosen_stream(subtitles.probe_streams(video), track=int(english["track"])), paths["english"])
        for side, path in paths.items():
            texts[side].append((first + n, path.read_text(encoding="utf-8")))
        added.append((first + n, row["series"], row["season"], row["episode"], str(video), *(str(paths.get(side, "")) or None for side in texts)))
    read = {side: subtitles.parse_srt(spark.createDataFrame(rows, "id long, text string"), "id", "text") for side, rows in texts.items()}
    cues = {side: df.select(F.col("key").alias("source_id"), F.col("cue").alias("cue_index"), F.col("start").alias("start_ms"), F.col("end").alias("end_ms"), "text") for side, df in read.items()}
    after = _into_model(spark, args, cues["japanese"], cues["english"])
    schema = "id long, series string, season int, episode int, video_path string, japanese_subtitle_path string, english_subtitle_path string"
    publish(src.unionByName(spark.createDataFrame(added, schema).withColumn("imported_at", F.current_timestamp()), allowMissingColumns=True), f"{args.out.rstrip('/')}/sources")
    print(json.dumps({"episodes": [r.episode for r in lacking], **after}))


def _sync(spark: SparkSession, args: argparse.Namespace) -> None:
    """Pull reviews, add and move the planned cards, and keep the new state."""
    held = spark.read.parquet(args.state)
    lines = model.sentences(spark, args.data).select(F.col("id").alias("sentence_id"), F.col("source_id").alias("of"), "japanese", "english")

    def plan(known: DataFrame) -> DataFrame:
        rows = _plan(spark, args, known.unionByName(held.filter("reps > 0").select("lexeme_id"))).join(lines, "sentence_id")
        return rows.drop("source_id").withColumnRenamed("of", "source_id").orderBy("position")

    names = ["Target", "Sentence", "Translation"]
    fields = lambda row: dict(zip(names, (row["surface"], row["japanese"], row["english"] or ""), strict=True))
    invoke = card_service.http_client(args.url)
    card_service.ensure_model(invoke, args.note_type, names, {"Card": {"Front": "{{Sentence}}", "Back": "{{Target}}<hr>{{Translation}}"}}, "")
    after, taught, done = card_service.synchronise(invoke, held, plan, fields, args.deck, args.note_type, datetime.now())
    publish(after, args.out)
    print(json.dumps(done))


def _mark_known(spark: SparkSession, args: argparse.Namespace) -> None:
    """The lexemes of the lemmas in a file, one a line, become known; the first time stays."""
    lemmas = spark.read.text(args.lemmas).select(F.trim("value").alias("lemma")).filter("lemma <> ''").distinct().withColumn("_now", F.lit(True))
    rows = model.lexemes(spark, args.data).join(lemmas, "lemma", "left")
    rows = rows.withColumn("known_at", F.coalesce("known_at", F.when(F.col("_now"), F.current_timestamp()))).drop("_now")
    publish(rows, args.out)
    print(published(spark, args.out).filter("known_at IS NOT NULL").count(), "known lexemes")


def _deliver(df: DataFrame, args: argparse.Namespace) -> None:
    if not args.out:
        df.show(args.rows, truncate=60)
    elif args.out.endswith(".json"):
        reports.write_json(df, args.out, command=args.command)
    elif args.out.endswith(".html"):
        reports.render_table(df, args.command, args.out)
    elif args.out.endswith(".csv"):
        reports.write_csv(df, args.out)
    else:
        df.write.mode("overwrite").parquet(args.out)


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="tanmono", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("list", help="names of all queries")
    for name in [*COMMANDS, "query", "export-preview", "plan", "plan-calibration", "sync"]:
        p = commands.add_parser(name)
        p.add_argument("--data", required=True)
        p.add_argument("--series")
        p.add_argument("--season", type=int, default=1)
        p.add_argument("--episodes")
        p.add_argument("--out")
        p.add_argument("--rows", type=int, default=20)
        if name == "query":
            p.add_argument("name", choices=sorted(QUERIES))
        if name in ("plan", "plan-calibration", "sync"):
            p.add_argument("--metric", choices=sorted(ranking.WEIGHTS), default="hybrid")
            p.add_argument("--limit", type=int, default=20)
            p.add_argument("--state", required=name == "sync", help="table of the cards, whose sentences are reserved for them")
        if name == "plan-calibration":
            p.add_argument("--name", required=True)
            p.add_argument("--replace", action="store_true")
        if name == "sync":
            p.add_argument("--url", default="http://127.0.0.1:8765")
            p.add_argument("--deck", required=True)
            p.add_argument("--note-type", required=True)
    p = commands.add_parser("ingest-model", help="subtitle files of one source into the tables of the model")
    p.add_argument("--data", required=True)
    p.add_argument("--source-id", type=int, required=True)
    p.add_argument("--japanese", required=True)
    p.add_argument("--english")
    p.add_argument("--out", required=True)
    p = commands.add_parser("mark-known", help="lemmas of a file, one a line, as known words")
    p.add_argument("--data", required=True)
    p.add_argument("--lemmas", required=True)
    p.add_argument("--out", required=True)
    p = commands.add_parser("ingest", help="subtitle files to cues")
    p.add_argument("path")
    p.add_argument("--out", required=True)
    p = commands.add_parser("build-manifest")
    p.add_argument("folder")
    p.add_argument("series")
    p.add_argument("season", type=int)
    p.add_argument("episodes")
    p.add_argument("--english-track", type=int)
    p.add_argument("--out", required=True)
    p = commands.add_parser("ingest-manifest", help="episodes of a manifest that the sources lack, into the tables of the model")
    p.add_argument("manifest")
    p.add_argument("--data", required=True)
    p.add_argument("--episodes")
    p.add_argument("--out", required=True)
    p = commands.add_parser("probe", help="subtitle streams of a video")
    p.add_argument("video")
    p = commands.add_parser("extract", help="one subtitle stream of a video as a file")
    p.add_argument("video")
    p.add_argument("--language", default="eng")
    p.add_argument("--track", type=int)
    p.add_argument("--out", required=True)
    p = commands.add_parser("import-reviews")
    p.add_argument("sheet")
    p.add_argument("--out", required=True)
    args = parser.parse_args(argv)
    if args.command == "list":
        print("\n".join(sorted(QUERIES)))
        return
    if args.command == "build-manifest":
        manifest = subtitles.build_manifest(args.folder, args.series, args.season, subtitles.parse_episodes(args.episodes), args.english_track)
        Path(args.out).write_text(json.dumps(manifest, ensure_ascii=False, indent=2) + "\n", encoding="utf-8")
        return
    if args.command == "probe":
        print(json.dumps(subtitles.probe_streams(args.video), indent=2))
        return
    if args.command == "extract":
        subtitles.extract_stream(args.video, subtitles.chosen_stream(subtitles.probe_streams(args.video), args.language, args.track), args.out)
        return
    spark = local_session()
    if args.command == "ingest":
        subtitles.read_srt(spark, args.path).write.mode("overwrite").parquet(args.out)
    elif args.command == "import-reviews":
        rows = subtitles.read_reviews(spark, args.sheet)
        rows.write.mode("overwrite").parquet(args.out)
        print(f"{rows.count()} reviews")
    elif args.command == "ingest-manifest":
        _ingest_manifest(spark, args)
    elif args.command == "plan":
        _deliver(_plan(spark, args), args)
    elif args.command == "plan-calibration":
        chosen = _chosen(spark, args)
        scope = [r.id for r in chosen.collect()] if chosen is not None else []
        cards.snapshot(cards.batch(args.name, _plan(spark, args), args.limit, scope, args.metric), args.out or args.name, args.replace)
    elif args.command == "sync":
        _sync(spark, args)
    elif args.command == "ingest-model":
        _ingest(spark, args)
    elif args.command == "mark-known":
        _mark_known(spark, args)
    elif args.command == "export-preview":
        cloze, shown = (_scoped(QUERIES[q](spark, args.data), spark, args) for q in ("cloze_text", "highlight_text"))
        first = QUERIES["planned_batch"](spark, args.data).select("source_id", "lexeme_id", "sentence_id", "surface")
        keys = ["lexeme_id", "sentence_id", "surface"]
        pages = _scoped(first, spark, args).join(cloze, keys, "left").join(shown, keys, "left")
        reports.render_cards(pages.select(F.col("cloze").alias("front"), F.col("highlighted").alias("back")), "Preview", args.out or "preview.html")
    else:
        name = args.name if args.command == "query" else COMMANDS[args.command]
        _deliver(_scoped(QUERIES[name](spark, args.data), spark, args), args)


if __name__ == "__main__":
    main()
