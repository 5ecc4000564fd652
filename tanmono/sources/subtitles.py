"""Reading timed text: SubRip documents, manifests, episode files and review sheets."""

from __future__ import annotations

import json
import re
import subprocess
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tanmono.functions.text import clean_text, millis, strip

_TIME = r"(\d{1,2}):(\d{2}):(\d{2})[,.](\d{3})"
TIMING = rf"{_TIME}\s*-->\s*{_TIME}"


def parse_srt(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, block, cue, start, end, text): one row per cue of every document.

    Blocks stand between empty lines; the first line with an arrow is the timing, the lines after it are the text. The cue's number is the
    block's first line, if that is a number above the timing, else the block's ordinal. Blocks without timing or text drop out.
    """
    raw = F.regexp_replace(F.replace(F.col(text), F.lit("﻿"), F.lit("")), "\r\n?", "\n")
    blocks = docs.select(F.col(key).alias("key"), F.posexplode(F.split(strip(raw), r"\n\s*\n")).alias("at", "block"))
    blocks = blocks.withColumn("lines", F.filter(F.split("block", "\n"), lambda x: strip(x) != ""))
    blocks = blocks.withColumn("timing", F.array_position(F.transform("lines", lambda x: F.contains(x, F.lit("-->"))), True))
    blocks = blocks.filter("timing > 0").withColumn("line", F.expr("lines[CAST(timing - 1 AS INT)]")).filter(F.col("line").rlike(TIMING))
    part = lambda i: F.regexp_extract("line", TIMING, i)
    number = strip(F.expr("lines[0]"))
    cue = F.when((F.col("timing") > 1) & number.rlike(r"^[+-]?[0-9]{1,9}$"), number.try_cast("int")).otherwise(F.col("at") + 1)
    rows = blocks.select(
        "key", (F.col("at") + 1).alias("block"), cue.cast("int").alias("cue"),
        millis(*(part(i) for i in (1, 2, 3, 4))).alias("start"), millis(*(part(i) for i in (5, 6, 7, 8))).alias("end"),
        clean_text(F.array_join(F.expr("slice(lines, CAST(timing + 1 AS INT), size(lines))"), " ")).alias("text"),
    )
    return rows.filter("text <> ''")


def read_srt(spark: SparkSession, path: str) -> DataFrame:
    """parse_srt() of every file under a path; key is the file's name."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    return parse_srt(files, "file", "value")


def parse_episodes(text: str) -> list[int]:
    """'1-3,7' to [1, 2, 3, 7], sorted, each once; empty and reversed ranges are errors."""
    out: set[int] = set()
    for part in text.split(","):
        bounds = re.fullmatch(r"\s*(\d+)\s*(?:-\s*(\d+)\s*)?", part)
        if not bounds:
            raise ValueError(f"not an episode or range: {part!r}")
        first, last = int(bounds[1]), int(bounds[2] or bounds[1])
        if first > last:
            raise ValueError(f"range runs backwards: {part!r}")
        out.update(range(first, last + 1))
    return sorted(out)


def selected_sources(src: DataFrame, series: str, season: int, episodes: list[int] | None = None) -> DataFrame:
    """(id, episode) of the asked episodes, by episode; all of the season for None, none for []."""
    rows = src.filter((F.col("series") == series) & (F.col("season") == season)).select("id", "episode")
    if episodes is not None:
        rows = rows.filter(F.col("episode").isin(episodes)) if episodes else rows.limit(0)
    return rows.orderBy("episode")


def source_id(src: DataFrame, series: str, season: int, episode: int) -> int:
    """The id of one episode; it is an error if there is none."""
    found = selected_sources(src, series, season, [episode]).limit(1).collect()
    if not found:
        raise KeyError(f"no source for {series} S{season:02d}E{episode:02d}")
    return found[0]["id"]


def missing_episodes(src: DataFrame, asked: DataFrame) -> DataFrame:
    """asked(series, season, episode) that the sources lack."""
    return asked.join(src, ["series", "season", "episode"], "left_anti")


def read_manifest(spark: SparkSession, path: str, episodes: list[int] | None = None) -> DataFrame:
    """One row per episode of a manifest; asking for an episode that it lacks is an error, raised before anything is read."""
    rows = spark.read.json(path, multiLine=True).select("series", "season", F.explode("episodes").alias("e"))
    if episodes is not None:
        have = {r[0] for r in rows.select("e.episode").collect()}
        if lacking := sorted(set(episodes) - have):
            raise ValueError(f"the manifest has no episodes {lacking}")
        rows = rows.filter(F.col("e.episode").isin(episodes))
    return rows.select("series", "season", "e.*")


def not_yet_ingested(manifest: DataFrame, src: DataFrame) -> DataFrame:
    return manifest.join(src.select("series", "season", "episode"), ["series", "season", "episode"], "left_anti")


#: A title, the episode after the last " - ", and what some groups put in brackets; titles may hold numbers themselves.
_EPISODE = r"(?i)^.+ - (\d+)(?: \[[^\]]+\])?\.([a-z0-9]+)$"


def episode_of(name: Column) -> Column:
    """The episode number of a file name like '[Group] Show - 07 [720p].mkv', null if it has none."""
    return F.regexp_extract(name, _EPISODE, 1).try_cast("int")


def episode_files(spark: SparkSession, folder: str) -> DataFrame:
    """(episode, extension, path) of a folder's files on any file system, by name alone; contents are not read, and empty files are not listed."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(folder).select("path")
    name = F.element_at(F.split("path", "/"), -1)
    rows = files.select(episode_of(name).alias("episode"), F.lower(F.regexp_extract(name, _EPISODE, 2)).alias("extension"), "path")
    return rows.filter("episode IS NOT NULL")


def discover_episode_files(folder: str | Path, extensions: tuple[str, ...] = (".mkv", ".srt")) -> dict[tuple[int, str], Path]:
    """(episode, extension) to file; two files for one key are an error."""
    found: dict[tuple[int, str], Path] = {}
    for path in sorted(Path(folder).iterdir()):
        name = re.match(_EPISODE, path.name)
        key = (int(name[1]), f".{name[2].lower()}") if name else None
        if key is None or key[1] not in extensions:
            continue
        if key in found:
            raise ValueError(f"two files for episode {key[0]}: {found[key].name}, {path.name}")
        found[key] = path
    return found


def build_manifest(folder: str | Path, series: str, season: int, episodes: list[int], english_track: int | None = None) -> dict:
    """A manifest of the folder's files; every asked episode needs a video and a subtitle file, and takes English from that track of the video."""
    files = discover_episode_files(folder)
    lacking = [e for e in episodes if (e, ".mkv") not in files or (e, ".srt") not in files]
    if lacking:
        raise ValueError(f"files are missing for episodes {lacking}")
    rows = [
        {"episode": e, "video": str(files[e, ".mkv"].resolve()), "japanese": {"srt": str(files[e, ".srt"].resolve())}, "english": {"track": english_track}}
        for e in episodes
    ]
    return {"series": series, "season": season, "episodes": rows}


def resolve_path(value: str, manifest: str | Path) -> Path:
    """A path of a manifest, relative to the manifest's folder."""
    return Path(value) if Path(value).is_absolute() else Path(manifest).parent / value


def read_reviews(spark: SparkSession, path: str) -> DataFrame:
    """(position, criterion, verdict, note) of a review sheet's rows with a verdict."""
    rows = spark.read.csv(path, header=True)
    return rows.filter(F.trim(F.coalesce("verdict", F.lit(""))) != "").select(
        F.col("position").try_cast("int").alias("position"), "criterion", F.lower(F.trim("verdict")).alias("verdict"), F.nullif(F.trim("note"), F.lit("")).alias("note")
    )


def probe_streams(video: str | Path) -> list[dict]:
    """Subtitle streams of a video, by ffprobe where that is installed."""
    command = ["ffprobe", "-v", "error", "-select_streams", "s", "-show_entries", "stream=index,codec_name:stream_tags=language,title", "-of", "json", str(video)]
    return json.loads(subprocess.run(command, check=True, capture_output=True, text=True).stdout or "{}").get("streams", [])


def chosen_stream(streams: list[dict], language: str = "eng", track: int | None = None) -> int:
    """Index of the asked subtitle track among a video's streams, else of the first one in that language; an error if there is none."""
    if track is not None:
        if not 0 <= track < len(streams):
            raise ValueError(f"there is no subtitle track {track}, only {len(streams)}")
        return streams[track]["index"]
    fits = [s["index"] for s in streams if s.get("tags", {}).get("language", "").lower() == language]
    if not fits:
        raise ValueError(f"no subtitles in {language}")
    return fits[0]


def extract_stream(video: str | Path, index: int, target: str | Path) -> None:
    """One subtitle stream of a video as a file, by ffmpeg."""
    subprocess.run(["ffmpeg", "-v", "error", "-y", "-i", str(video), "-map", f"0:{index}", str(target)], check=True)
