"""Problem 3: sentences of two tracks that translate each other, by similarity to shared paired documents.

The aligned lines of the collection are paired documents, and each is a concept. A term is a vector over all concepts
that hold it; a sentence is the weighted sum of its terms' vectors, that is, of its similarities to the concepts.
As the dot product of two such sums is the sum over pairs of terms, the cosine of two sentences is a sparse
join of their terms through the cosines of terms, which are counted once, over all concepts. Mutual best spans, one line
to one or to a window of neighbours merged into one vector, are the result. The time by which they miss the place that
the source's surest pairs foretell only lowers their score, so reordered lines are found.

Within a language different terms count as orthogonal, and so do two terms of the two languages whose cosine
is under LEAST_COSINE.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tanmono.plans.storage import materialize, release

#: Least cosine of two terms that translate each other; 0 keeps every pair of terms that meet.
LEAST_COSINE = 0.4
#: Least cosine of two lines of which one may translate a part of the other, and of two spans that translate each other.
LEAST_PART, LEAST_SPAN = 0.15, 0.3
#: Words in more than this share of the lines are the language's function words: they part phrases.
FUNCTION_SHARE = 0.1
#: The most frequent terms of each language whose frequencies every task knows, so that pairs that cannot reach
#: LEAST_COSINE are not counted. Any number gives the same cosines.
LISTED = 100_000
#: Width of the blocks of time in which lines meet; a line meets those of its own and the two neighbouring blocks, at its
#: own time and at the time that the drift of its source gives.
BLOCK_MS = 180_000
#: Step of the drifts that are told apart, and the votes that a drift needs.
DRIFT_MS = 30_000
LEAST_VOTES = 3
#: Lines of a merged window; score lost for each line beyond the first, and for each millisecond off its place.
MOST_LINES, LINE_COST, MS_COST = 3, 0.03, 1 / 50_000
#: Of a line without a pair: the share of it, or of the line that it is put to, that they have in common in time, and by how much more
#: of that line's time is met with it than without.
LEAST_OVERLAP, LEAST_FILL = 0.5, 0.3
#: Width of the blocks of time in and around which a line's neighbours tell its place exactly.
NEAR_MS = 20_000
#: Pairs of terms that a task adds up before it hands them on.
COMBINED = 1_500_000

#: Unspaced text is cut where the script changes.
_RUN = re.compile("[一-鿿㐀-䶿豈-﫿々〆]+|[ァ-ヺー・]+|[ぁ-ゖー]+|[^\\W_ぁ-ヿ㐀-鿿豈-﫿]+")
_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
_LETTERS = bytes(c if chr(c).isalnum() else 32 for c in range(128)) + bytes(128)


def _flat(text: str | None) -> str:
    text = text or ""
    return (text if text.isascii() or unicodedata.is_normalized("NFKC", text) else unicodedata.normalize("NFKC", text)).lower()


def runs(text: str | None) -> list[str]:
    """Terms of unspaced text: its runs of one script."""
    return _RUN.findall(_flat(text))


def words(text: str | None) -> list[str]:
    """Words of spaced text, in order."""
    if text and text.isascii() and "'" not in text:
        return text.encode().translate(_LETTERS).decode().lower().split()  # the same, faster
    return _WORD.findall(_flat(text))


def _hashed(texts: list, cut: Callable) -> tuple[np.ndarray, np.ndarray]:
    """(line, hash) of every term of every text, in order."""
    terms = [cut(t) for t in texts]
    line = np.repeat(np.arange(len(terms)), [len(t) for t in terms])
    flat = np.array([x for t in terms for x in t], object)
    return line, pd.util.hash_array(flat).view(np.int64) if len(flat) else np.empty(0, np.int64)


def _phrases(texts: list, function_words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(line, hash, position, length): content words and pairs of neighbouring ones; of a line without any, all its words."""
    line, word = _hashed(texts, words)
    content = ~np.isin(word, function_words)
    bare = np.bincount(line, content, minlength=len(texts)) == 0
    first = np.flatnonzero((line[1:] == line[:-1]) & content[1:] & content[:-1]) if len(word) else np.empty(0, np.int64)
    pair = (word[first].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ (word[first + 1].view(np.uint64) >> np.uint64(7))) * np.uint64(0xBF58476D1CE4E5B9)
    pair = (pair + word[first + 1].view(np.uint64)).view(np.int64)
    one = np.flatnonzero(content | bare[line])
    at = np.concatenate([one, first])
    return line[at], np.concatenate([word[one], pair]), at, np.repeat([1, 2], [len(one), len(first)])


def _batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


_WORDS = pa.schema([("word", pa.int64()), ("n", pa.int64())])


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, lines) of the spaced language; word 0 counts the lines."""
    for batch in batches:
        line, word = _hashed(batch.column(1).to_pylist(), words)
        held = pd.DataFrame({"line": line, "word": word}).drop_duplicates()["word"].value_counts()
        yield _batch(_WORDS, np.append(held.index.to_numpy(np.int64), 0), np.append(held.to_numpy(np.int64), batch.num_rows))


_SIZES = pa.schema([("spaced", pa.bool_()), ("term", pa.int64()), ("n", pa.int64())])


def _distinct_terms(batch: pa.RecordBatch, function_words: np.ndarray) -> list[pd.DataFrame]:
    """(line, term) of both languages, each once, by line."""
    spaced = _phrases(batch.column(1).to_pylist(), function_words)[:2]
    sides = [pd.DataFrame({"line": a, "term": b}).drop_duplicates() for a, b in (_hashed(batch.column(0).to_pylist(), runs), spaced)]
    return [side.iloc[np.argsort(side["line"].to_numpy(), kind="stable")] for side in sides]


def _term_counts(function_words: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for spaced, held in enumerate(_distinct_terms(batch, function_words)):
                sizes = held["term"].value_counts()
                yield _batch(_SIZES, np.full(len(sizes), bool(spaced)), sizes.index.to_numpy(np.int64), sizes.to_numpy(np.int64))

    return run


_MET = pa.schema([("ja", pa.int64()), ("en", pa.int64()), ("n", pa.int64())])


Listed = tuple[np.ndarray, np.ndarray, int]


def _known(terms: np.ndarray, listed: Listed) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code of each term, and the least and greatest number of lines it can be in, by the list (sorted terms, sizes, most of any other term).

    A listed term has its place in the list as its code, which takes few bytes; any other its hash.
    """
    names, sizes, most = listed
    if not len(names):
        return terms, np.ones(len(terms)), np.full(len(terms), np.inf)
    at = np.minimum(np.searchsorted(names, terms), len(names) - 1)
    known = names[at] == terms
    return np.where(known, at, terms), np.where(known, sizes[at], 1), np.where(known, sizes[at], most)


def _coded(listed: list[Listed]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spaced, term = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy()
            yield _batch(_SIZES, spaced, np.where(spaced, _known(term, listed[1])[0], _known(term, listed[0])[0]), batch.column(2))

    return run


def _crossed(sides: list[pd.DataFrame], listed: list[Listed], least: float) -> pd.DataFrame:
    """(ja, en, n) for terms that meet in n lines and may have the least cosine: that is at most the root of the ratio of sizes."""
    lines = [side["line"].to_numpy() for side in sides]
    (ja, lo_a, hi_a), (en, lo_b, hi_b) = (_known(side["term"].to_numpy(), x) for side, x in zip(sides, listed, strict=True))
    per_line = np.bincount(lines[1], minlength=lines[0].max(initial=-1) + 1)
    start, many = np.cumsum(per_line) - per_line, per_line[lines[0]]
    a = np.repeat(np.arange(len(ja)), many)
    b = np.arange(len(a)) - np.repeat(np.cumsum(many) - many - start[lines[0]], many)
    may = np.minimum(hi_a[a], hi_b[b]) >= least * least * np.maximum(lo_a[a], lo_b[b])
    a, b = a[may], b[may]
    (code_a, name_a), (code_b, name_b) = pd.factorize(ja), pd.factorize(en)
    pair, n = np.unique(code_a[a] * max(1, len(name_b)) + code_b[b], return_counts=True)
    return pd.DataFrame({"ja": name_a[pair // max(1, len(name_b))], "en": name_b[pair % max(1, len(name_b))], "n": n})


def _met(function_words: np.ndarray, listed: list[Listed], least: float):
    """_crossed() of all lines, added up over up to COMBINED pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0

        def added() -> pa.RecordBatch:
            both = pd.concat(parts).groupby(["ja", "en"], sort=True)["n"].sum().reset_index()
            parts.clear()
            return _batch(_MET, both["ja"].to_numpy(), both["en"].to_numpy(), both["n"].to_numpy())

        for batch in batches:
            parts.append(_crossed(_distinct_terms(batch, function_words), listed, least))
            held += len(parts[-1])
            if held > COMBINED:
                yield added()
                held = 0
        if parts:
            yield added()

    return run


def _once(docs: DataFrame) -> DataFrame:
    """(a, b) of docs(id, a, b), rows that are stored several times once. While few are, no text is shuffled."""
    twice = materialize(docs.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select("id"), "twice")
    again = materialize(docs.join(twice, "id", "left_semi").distinct().select("a", "b"), "again")
    return docs.join(twice, "id", "left_anti").select("a", "b").unionByName(again)


def _listed(sizes: DataFrame, spaced: bool) -> Listed:
    top = sizes.filter(F.col("spaced") == spaced).select("term", "n").orderBy(F.col("n").desc()).limit(LISTED).toArrow().sort_by("term")
    n = top.column("n").to_numpy()
    return top.column("term").to_numpy(), n, int(n.min()) if len(n) == LISTED else 1


def term_cosines(pairs: DataFrame, least: float = LEAST_COSINE) -> tuple[DataFrame, np.ndarray, list[Listed]]:
    """(ja, en, cosine, w_ja, w_en) of terms from paired documents (id, a, b), the function words, and the lists that give codes.

    ja and en are codes, function words hashes. A cosine is n / (sqrt(size_ja size_en) + 0.5) for n common concepts, the half
    for the doubt of rare terms; a weight is the logarithm of the concepts for each that holds the term. All concepts count.
    """
    docs, spark = pairs.transform(_once), pairs.sparkSession
    counts = docs.mapInArrow(_word_counts, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = materialize(counts, "words")
    lines = counts.filter("word = 0").agg(F.max("n")).first()[0] or 0
    common = [r.word for r in counts.filter((F.col("word") != 0) & (F.col("n") > FUNCTION_SHARE * lines)).collect()]
    function_words = np.array(sorted(common), np.int64)
    sizes = docs.mapInArrow(_term_counts(function_words), "spaced boolean, term long, n long")
    sizes = materialize(sizes.groupBy("spaced", "term").agg(F.sum("n").alias("n")), "sizes")
    listed = [_listed(sizes, spaced) for spaced in (False, True)]
    met = docs.mapInArrow(_met(function_words, listed, least), "ja long, en long, n long").repartition("ja").groupBy("ja", "en").agg(F.sum("n").alias("n"))
    weight, coded = F.log((F.lit(lines) + 1) / F.col("n")), sizes.mapInArrow(_coded(listed), sizes.schema)
    of = {side: coded.filter(F.col("spaced") == (side == "en")).select(F.col("term").alias(side), F.col("n").alias(f"size_{side}"), weight.alias(f"w_{side}")) for side in ("ja", "en")}
    # A term has at least the n concepts of its pair, which bounds the cosine before the other size is known.
    met = met.join(of["ja"], "ja").filter(F.col("n") / (F.sqrt(F.col("size_ja") * F.col("n")) + 0.5) >= least)
    cosine = F.col("n") / (F.sqrt(F.col("size_ja") * F.col("size_en")) + 0.5)
    met = met.join(of["en"], "en").select("ja", "en", cosine.alias("cosine"), "w_ja", "w_en").filter(F.col("cosine") >= least)
    out = materialize(met, "cosines")
    release(spark, counts, sizes)
    return out, function_words, listed


_TRACK = "source long, line long, cue long, start long, stop long, terms array<struct<term:long,at:int,length:int>>"
_TRACK_SCHEMA = pa.schema(
    [(c, pa.int64()) for c in ("source", "line", "cue", "start", "stop")]
    + [("terms", pa.list_(pa.struct([("term", pa.int64()), ("at", pa.int32()), ("length", pa.int32())])))]
)


def _track_terms(spaced: bool, function_words: np.ndarray, listed: Listed):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(5).to_pylist()
            if spaced:
                line, term, at, length = _phrases(texts, function_words)
            else:
                line, term = _hashed(texts, runs)
                at, length = np.arange(len(term)), np.ones(len(term), np.int64)
            order = np.argsort(line, kind="stable")
            fields = [pa.array(x[order], t) for x, t in ((_known(term, listed)[0], pa.int64()), (at, pa.int32()), (length, pa.int32()))]
            offsets = np.append(0, np.cumsum(np.bincount(line, minlength=len(texts)))).astype(np.int32)
            terms = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(fields, ["term", "at", "length"]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], terms], schema=_TRACK_SCHEMA)

    return run


def _track(rows: DataFrame, text: str, spaced: bool, function_words: np.ndarray, listed: Listed) -> DataFrame:
    """(source, line, cue, start, stop, term, at, length): the terms of a track's lines."""
    rows = rows.filter(F.col(text) != "").select(*(F.col(c).cast("long").alias(d) for c, d in (("source", "source"), ("id", "line"), ("cue", "cue"), ("start", "start"), ("end", "stop"))), text)
    return rows.mapInArrow(_track_terms(spaced, function_words, listed), _TRACK).select("source", "line", "cue", "start", "stop", F.inline("terms"))


def _vectors(track: DataFrame, cosines: DataFrame, side: str) -> DataFrame:
    """(source, side, cue_side, from_side, to_side, term, ...): the terms of lines that the other language has a word for, of unit length.

    A word inside a pair of words that is itself such a term is left to the pair. On the ja side each term comes with each of
    its translations; x is its share of the line's vector times their cosine.
    """
    if side == "ja":
        many = cosines.groupBy("ja").agg(F.count("*").alias("many"))
        known = cosines.join(many, "ja").select(F.col("ja").alias("term"), "en", "cosine", F.col("w_ja").alias("w"), "many")
    else:
        known = cosines.select(F.col("en").alias("term"), F.col("w_en").alias("w")).distinct()
    met = track.join(known, "term")
    if side == "en":
        pair = F.max(F.when(F.col("length") == 2, 1)).over(Window.partitionBy("line").orderBy("at").rangeBetween(-1, 0))
        met = met.withColumn("pair", pair).filter("length = 2 OR pair IS NULL").withColumn("many", F.lit(1))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w") / F.col("many")).over(Window.partitionBy("line")))
    share = F.col("w") / F.col("norm")
    return met.withColumn("norm", norm).filter("norm > 0").select(
        "source", F.col("line").alias(side), F.col("cue").alias(f"cue_{side}"), F.col("start").alias(f"from_{side}"), F.col("stop").alias(f"to_{side}"),
        F.col("norm").alias(f"norm_{side}"), F.col("term").alias(side[0]), *([F.col("en").alias("e"), (share * F.col("cosine")).alias("x")] if side == "ja" else [share.alias("y")]),
    )


def _lines(vectors: DataFrame, side: str) -> DataFrame:
    return vectors.select("source", side, f"cue_{side}", f"from_{side}", f"to_{side}", f"norm_{side}").distinct()


def _rare(vectors: DataFrame, side: str) -> DataFrame:
    """(source, term, from_side): the times of the terms that one or two lines of a source's track hold."""
    terms = vectors.select("source", side[0], side, f"from_{side}").distinct().groupBy("source", side[0])
    times = terms.agg(F.count("*").alias("n"), F.min(f"from_{side}").alias("a"), F.max(f"from_{side}").alias("b"))
    return times.filter("n <= 2").select("source", side[0], F.explode(F.array_distinct(F.array("a", "b"))).alias(f"from_{side}"))


def _drifts(ja: DataFrame, en: DataFrame, lines: DataFrame, cosines: DataFrame) -> DataFrame:
    """(source, block, drifts): by how much the lines of a block of the English track are later than their Japanese lines.

    Rare terms that translate each other meet anywhere in a source and vote for a drift, in the block of the English time
    and its neighbours. A block without a drift of LEAST_VOTES takes those of the nearest blocks before and after.
    """
    met = _rare(ja, "ja").join(cosines.select(F.col("ja").alias("j"), F.col("en").alias("e")), "j").join(_rare(en, "en"), ["source", "e"])
    drift, block = F.col("from_en") - F.col("from_ja"), F.expr(f"from_en div {BLOCK_MS}")
    step = F.floor(drift / DRIFT_MS)
    votes = met.select("source", F.explode(F.array(block - 1, block, block + 1)).alias("block"), drift.alias("drift"), F.array(step - 1, step).alias("steps"))
    votes = votes.select("source", "block", "drift", F.explode("steps").alias("step")).groupBy("source", "block", "step")
    votes = votes.agg(F.count("*").alias("n"), F.avg("drift").cast("long").alias("drift")).filter(F.col("n") >= LEAST_VOTES)
    best = votes.groupBy("source", "block").agg(F.max(F.struct("n", "drift")).getField("drift").alias("drift"))
    order = Window.partitionBy("source").orderBy("block")
    before = F.last("drift", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("drift", ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))
    blocks = lines.select("source", block.alias("block")).distinct().join(best, ["source", "block"], "left")
    return blocks.select("source", "block", F.array_compact(F.array(F.lit(0).cast("long"), before, after)).alias("drifts"))


def _similar(ja: DataFrame, en: DataFrame, cosines: DataFrame) -> DataFrame:
    """(source, ja, en, cosine, times, cues, norms): lines of a source with a cosine of at least LEAST_PART, near each other in time."""
    near = F.flatten(F.transform("drifts", lambda d: F.sequence(F.floor((F.col("from_en") - d) / BLOCK_MS) - 1, F.floor((F.col("from_en") - d) / BLOCK_MS) + 1)))
    lines = {"ja": _lines(ja, "ja"), "en": materialize(_lines(en, "en"), "lines")}
    drifts = _drifts(ja, en, lines["en"], cosines)
    right = en.withColumn("block", F.expr(f"from_en div {BLOCK_MS}")).join(drifts, ["source", "block"])
    right = right.select("source", F.explode(F.array_distinct(near)).alias("block"), "en", "e", "y")
    left = ja.select("source", F.expr(f"from_ja div {BLOCK_MS}").alias("block"), "ja", "e", "x")
    met = left.join(right, ["source", "block", "e"]).groupBy("ja", "en").agg(F.sum(F.col("x") * F.col("y")).alias("cosine"))
    met = met.filter(F.col("cosine") >= LEAST_PART)
    out = materialize(met.join(lines["ja"], "ja").join(lines["en"].drop("source"), "en"), "similar")
    release(ja.sparkSession, lines["en"])
    return out


def _places(pairs: DataFrame) -> DataFrame:
    """(source, b, middle, slope, base, n): where the surest pairs in and around a block of time put its lines.

    Sure pairs are mutual best ones of high cosine. In every block of time, those of the block and its neighbours give
    a median shift, and those near the median a straight line.
    """
    best = {side: pairs.groupBy(side).agg(F.max_by(other, F.struct("cosine", other)).alias(other)) for side, other in (("ja", "en"), ("en", "ja"))}
    sure = pairs.filter("cosine >= 0.6").join(best["ja"], ["ja", "en"], "left_semi").join(best["en"], ["ja", "en"], "left_semi")
    block = F.expr(f"from_ja div {BLOCK_MS}")
    sure = sure.select(
        "source", F.explode(F.array(block - 1, block, block + 1)).alias("b"),
        F.col("from_ja").cast("double").alias("x"), (F.col("from_en") - F.col("from_ja")).cast("double").alias("shift"),
    )
    middle = sure.groupBy("source", "b").agg(F.percentile_approx("shift", 0.5, 1000).alias("middle"))
    near = sure.join(middle, ["source", "b"]).filter("abs(shift - middle) <= 20000")
    return near.groupBy("source", "b").agg(
        F.first("middle").alias("middle"), F.regr_slope("shift", "x").alias("slope"), F.regr_intercept("shift", "x").alias("base"), F.count("*").alias("n")
    )


def _shifted(rows: DataFrame, places: DataFrame, how: str) -> DataFrame:
    """rows(source, from_ja, ...) with shift, by which the English line is later there."""
    placed = rows.withColumn("b", F.expr(f"from_ja div {BLOCK_MS}")).join(places, ["source", "b"], how)
    shift = F.when((F.col("n") >= 6) & (F.abs("slope") <= 0.2), F.col("base") + F.col("slope") * F.col("from_ja")).otherwise(F.col("middle"))
    return placed.withColumn("shift", shift).drop("b", "middle", "slope", "base", "n")


def _foretold(pairs: DataFrame, places: DataFrame) -> DataFrame:
    """pairs with late: the time by which the English line misses the place that _places() foretells."""
    placed = _shifted(pairs, places, "left")
    late = F.greatest(F.col("from_en") - F.col("to_ja") - F.col("shift"), F.col("from_ja") + F.col("shift") - F.col("to_en"), F.lit(0.0))
    return placed.withColumn("late", F.coalesce(late, F.lit(0.0))).drop("shift")


def filled(pairs: DataFrame, lines: DataFrame, places: DataFrame) -> DataFrame:
    """(ja, en, cosine, late) of lines(source, line, cue, start, stop, spaced) that are in none of the pairs, by their place.

    A part of a cut sentence may hold function words only, and a line only terms that no paired document has; their vectors are empty.
    Such a line belongs to the line that a neighbour of its track is paired with, or to the one beyond that if this one has no pair either,
    if they share time where the surest pairs put them and that line's time is met by its pairs and this line far better than by its pairs alone.
    """
    ja = lines.filter("NOT spaced").withColumnsRenamed({"start": "from_ja"})
    ja = _shifted(ja, places, "inner").select("source", F.col("line").alias("ja"), "cue", (F.col("from_ja") + F.col("shift")).alias("start"), (F.col("stop") + F.col("shift")).alias("stop"))
    en = lines.filter("spaced").select(F.col("line").alias("en"), F.col("cue").alias("cue_en"), *(F.col(c).cast("double").alias(f"{c}_en") for c in ("start", "stop")))
    met = materialize(pairs.select("ja", "en").join(ja, "ja").join(en, "en"), "met")
    # The straight line misses single places by what the lines that are cut or swapped there add; the median of the lines around does not.
    near = F.floor(F.col("start") / NEAR_MS)
    miss = met.select("source", F.explode(F.array(near - 1, near, near + 1)).alias("near"), (F.col("start_en") - F.col("start")).alias("miss"))
    miss = materialize(miss.groupBy("source", "near").agg(F.percentile_approx("miss", 0.5, 1000).alias("miss")), "miss")
    moved = lambda rows: rows.withColumn("near", near).join(miss, ["source", "near"], "left").withColumns({c: F.col(c) + F.coalesce("miss", F.lit(0.0)) for c in ("start", "stop")}).drop("near", "miss")
    met = moved(met)
    to_ja = met.groupBy(F.col("ja").alias("line")).agg(F.min("cue_en").alias("cue_lo"), F.max("cue_en").alias("cue_hi"), F.min("start_en").alias("lo"), F.max("stop_en").alias("hi"))
    to_en = met.groupBy(F.col("en").alias("line")).agg(F.min("cue").alias("cue_lo"), F.max("cue").alias("cue_hi"), F.min("start").alias("lo"), F.max("stop").alias("hi"))
    at = moved(ja).withColumnsRenamed({"ja": "line"}).withColumn("spaced", F.lit(False))
    at = at.unionByName(lines.filter("spaced").withColumns({c: F.col(c).cast("double") for c in ("start", "stop")}))
    met = to_ja.unionByName(to_en)
    known = materialize(at.join(met, "line", "left"), "known")
    bare = known.filter("lo IS NULL").select("source", "spaced", "cue", "line", "start", "stop", F.explode(F.array(F.lit(-1), F.lit(1))).alias("step"))
    beside = known.filter("lo IS NOT NULL").select("source", "spaced", F.col("cue").alias("beside"), "cue_lo", "cue_hi")
    bare = bare.withColumn("beside", F.col("cue") + F.col("step")).join(beside, ["source", "spaced", "beside"])
    near = F.when(F.col("step") < 0, F.col("cue_hi")).otherwise(F.col("cue_lo"))
    tried = F.explode(F.array(F.struct(near.alias("cue"), F.lit(True).alias("paired")), F.struct((near - F.col("step")).alias("cue"), F.lit(False).alias("paired")))).alias("o")
    bare = bare.select("source", "line", "start", "stop", (~F.col("spaced")).alias("spaced"), tried).select("source", "spaced", "line", "start", "stop", "o.*")
    own = known.select("source", "spaced", "cue", F.col("line").alias("other"), F.col("start").alias("a"), F.col("stop").alias("b"), "lo", "hi", F.col("lo").isNotNull().alias("paired"))
    found = bare.join(own, ["source", "spaced", "cue", "paired"])

    def share(lo, hi):
        return F.greatest(F.lit(0.0), F.least("b", hi) - F.greatest("a", lo)) / (F.greatest("b", hi) - F.least("a", lo))

    lo, hi = F.least("start", "lo"), F.greatest("stop", "hi")  # nulls count for nothing
    overlap = F.least("b", "stop") - F.greatest("a", "start")
    found = found.filter(overlap >= F.least(F.col("b") - F.col("a"), F.col("stop") - F.col("start")) * LEAST_OVERLAP)
    found = found.filter((overlap > 0) & (share(lo, hi) - F.coalesce(share(F.col("lo"), F.col("hi")), F.lit(0.0)) >= LEAST_FILL))
    side = lambda a, b: F.when(F.col("spaced"), F.col(a)).otherwise(F.col(b))
    return found.select(side("line", "other").alias("ja"), side("other", "line").alias("en"), F.lit(0.0).alias("cosine"), F.lit(0.0).alias("late")).distinct()


def translation_pairs(lines: DataFrame) -> DataFrame:
    """(ja, en, cosine, late) from lines (id, source, cue, start, end, ja_text, en_text) of the unaligned and aligned sources.

    Sources with a line that has no Japanese but English text are unaligned; their rows are the tracks. Lines with both texts,
    wherever they are, are the paired documents. Repeated rows count once; null texts count as empty; lines without
    terms pair with nothing; without any paired document the result is empty.
    """
    lines, spark = lines.fillna("", ["ja_text", "en_text"]).filter("id IS NOT NULL"), lines.sparkSession
    paired = lines.filter("ja_text <> '' AND en_text <> ''").select("id", F.col("ja_text").alias("a"), F.col("en_text").alias("b"))
    cosines, function_words, listed = term_cosines(paired)
    sources = lines.filter("ja_text = '' AND en_text <> ''").select("source").distinct()
    rows = lines.filter("ja_text = '' OR en_text = ''").join(sources, "source", "left_semi").distinct()
    rows = materialize(rows, "tracks")
    ja = materialize(_vectors(_track(rows, "ja_text", False, function_words, listed[0]), cosines, "ja"), "ja")
    en = materialize(_vectors(_track(rows, "en_text", True, function_words, listed[1]), cosines, "en"), "en")
    pairs = _similar(ja, en, cosines)
    release(spark, ja, en, cosines)
    places = materialize(_places(pairs), "places")
    placed = materialize(_foretold(pairs, places), "placed")
    release(spark, pairs)
    spans = materialize(_spans(placed, "en", 1).unionByName(_spans(placed, "ja", 2)), "spans")
    release(spark, placed)
    found = materialize(best_spans(spans), "found")
    release(spark, spans)
    track = rows.filter("ja_text <> '' OR en_text <> ''").select("source", F.col("id").alias("line"), "cue", "start", F.col("end").alias("stop"), (F.col("ja_text") == "").alias("spaced"))
    return found.unionByName(filled(found, track, places))


def _spans(pairs: DataFrame, side: str, least_lines: int) -> DataFrame:
    """Spans that begin with a pair: its line of the other side, and least_lines to MOST_LINES neighbouring lines of side."""
    other = "en" if side == "ja" else "ja"
    order = Window.partitionBy(other).orderBy(f"cue_{side}", side)
    fields = {"cue": f"cue_{side}", "line": side, "cosine": "cosine", "norm": f"norm_{side}", "late": "late"}
    ahead = {(k, f): F.lead(c, k).over(order) for f, c in fields.items() for k in range(1, MOST_LINES)}
    rows = pairs.select(F.col(other).alias("one"), *(F.col(c).alias(f"{f}0") for f, c in fields.items()), *(x.alias(f"{f}{k}") for (k, f), x in ahead.items()))
    follow = F.array(*(F.struct(*(F.col(f"{f}{k}").alias(f) for f in fields)) for k in range(MOST_LINES)))
    rows = rows.select("one", follow.alias("follow")).select("one", "follow", F.explode(F.sequence(F.lit(least_lines), F.lit(MOST_LINES))).alias("k"))
    rows = rows.select("one", "k", F.expr("slice(follow, 1, k)").alias("many"))
    # A null at the end of a track and a gap between cues both end a window.
    rows = rows.filter("NOT exists(transform(many, (x, i) -> x.cue = many[0].cue + i), y -> NOT coalesce(y, false))")
    norm = "sqrt(aggregate(many, 0D, (n, x) -> n + x.norm * x.norm))"
    rows = rows.withColumn("cosine", F.expr(f"aggregate(many, 0D, (n, x) -> n + x.cosine * x.norm) / {norm}"))
    score = F.col("cosine") - F.expr("array_max(transform(many, x -> x.late))") * MS_COST - LINE_COST * (F.col("k") - 1)
    kind = F.col("k") if side == "en" else -F.col("k")
    span = F.struct(kind.alias("kind"), "one", F.col("many")[0]["line"].alias("first")).alias("span")
    return rows.select(span, F.transform("many", lambda x: F.struct(x["line"].alias("line"), x["cosine"].alias("cosine"), x["late"].alias("late"))).alias("many"), "cosine", score.alias("score"))


def best_spans(spans: DataFrame) -> DataFrame:
    """Pairs inside those of _spans() that are each other's best: one line to one, or to a window of up to MOST_LINES neighbours.

    A window's vector is the sum of its lines' vectors. A span scores its cosine, less a little for the time it is off and
    for each further line. It stays if it is the best one of a line on either side and has a cosine of LEAST_SPAN.
    """
    ja, en = F.lit(0), F.lit(1)
    one = F.array(F.struct(F.when(F.col("span.kind") > 0, ja).otherwise(en).alias("side"), F.col("span.one").alias("line")))
    many = F.transform("many", lambda x: F.struct(F.when(F.col("span.kind") > 0, en).otherwise(ja).alias("side"), x["line"].alias("line")))
    members = spans.select("span", "score", F.explode(F.concat(one, many)).alias("m"))
    best = members.groupBy("m").agg(F.max(F.struct("score", "span")).getField("span").alias("span"), F.first("m.side").alias("side"))
    mutual = best.groupBy("span").agg(F.min("side").alias("lo"), F.max("side").alias("hi")).filter("lo < hi").select("span")
    chosen = spans.filter(F.col("cosine") >= LEAST_SPAN).join(mutual, "span", "left_semi").select("span", F.explode("many").alias("x"))
    side = lambda a, b: F.when(F.col("span.kind") > 0, a).otherwise(b)
    one, line = F.col("span.one"), F.col("x.line")
    return chosen.select(side(one, line).alias("ja"), side(line, one).alias("en"), "x.cosine", "x.late").distinct()
