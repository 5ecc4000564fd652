"""Problem 7: held-out passages in a training corpus, by a distributed positional inverted index.

Texts are reduced to their letters and digits. A token is a run of as many letters as the shortest stretch that counts, and
every position of a document starts one, so the positions in the posting lists say all that is asked: the lists
of a passage's terms, each moved back by the term's offset, meet in one number exactly where document and passage agree,
and a run of neighbouring offsets is a phrase. Phrases that follow each other in the passage's order, with gaps up to
its length, are proximity matches. Lists are intersected from the rarest term on: only places that hold a term beyond the
few most frequent ones, without which no passage is half there, look into the long lists at all.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tanmono.llm.hashing import codes_of, gram_hashes
from tanmono.plans.storage import materialize, release

#: Letters of the shortest stretch that counts, in passages of East Asian scripts and of others.
JA, EN = 15, 30
#: From here on, characters belong to East Asian scripts.
WIDE = 0x2E80
#: Bits of the filter of terms, 8 MB whatever the number of passages; what passes it by chance is left out by the join.
FILTER_BITS = 26
#: Letters that are hashed at once.
CHUNK = 1_000_000
_NO_LETTER = re.compile(r"[\W_]+")


def letters(text: str | None) -> str:
    """The letters and digits of a text in one width and case."""
    return _NO_LETTER.sub("", unicodedata.normalize("NFKC", text or "").casefold())


def tokens(codes: np.ndarray, size: int) -> np.ndarray:
    """A hash of the size letters at every position."""
    return gram_hashes(codes, size) ^ np.uint64(size)


_POSTINGS = pa.schema([("token", pa.int64()), ("doc", pa.int64()), ("at", pa.int64())])


def _pieces(batch: pa.RecordBatch) -> Iterator[tuple[list[int], list[int], list[str]]]:
    """Documents, offsets and letters, together up to CHUNK letters; a longer text comes in pieces that overlap by EN - 1."""
    docs, offsets, parts, held = [], [], [], 0
    for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
        body = letters(text.as_py())
        for at in range(0, max(1, len(body) - JA + 1), CHUNK):
            docs.append(doc), offsets.append(at), parts.append(body[at : at + CHUNK + EN - 1])
            held += len(parts[-1])
            if held >= CHUNK:
                yield docs, offsets, parts
                docs, offsets, parts, held = [], [], [], 0
    yield docs, offsets, parts


def _index(bits: np.ndarray | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for docs, offsets, parts in _pieces(batch):
                codes = codes_of("\0".join(parts))
                starts = np.cumsum([0, *(len(p) + 1 for p in parts)])
                columns = []
                for size in (JA, EN):
                    hashes = tokens(codes, size)
                    if bits is None:
                        at = np.arange(len(hashes))
                    else:
                        spot = hashes >> np.uint64(64 - FILTER_BITS)
                        at = np.flatnonzero((bits[spot >> np.uint64(6)] >> (spot & np.uint64(63))) & np.uint64(1))
                    of = np.searchsorted(starts, at, "right") - 1
                    place = at - starts[of]
                    whole = (at + size < starts[of + 1]) & (place < CHUNK)
                    of, place = of[whole], place[whole]
                    columns.append((hashes[at[whole]].view(np.int64), np.array(docs, np.int64)[of], place + np.array(offsets, np.int64)[of]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*columns, strict=True)], schema=_POSTINGS)

    return run


def positional_index(docs: DataFrame, key: str, text: str, bits: np.ndarray | None = None) -> DataFrame:
    """(token, doc, at): the postings of documents; with bits, only of tokens that pass this filter.

    Written as a table without a filter, it serves any number of searches.
    """
    rows = docs.select(F.col(key).cast("bigint").alias("doc"), F.col(text).alias("text")).filter("doc IS NOT NULL AND text <> ''")
    return rows.mapInArrow(_index(bits), "token long, doc long, at long")


_TERMS = pa.schema([(c, pa.int64()) for c in ("token", "item", "part", "of", "n", "size")])


def _size(lang: str | None, codes: np.ndarray) -> int:
    return EN if lang == "en" or (lang != "ja" and not (codes >= WIDE).any()) else JA


def _passage_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for item, part, lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            codes = codes_of(letters(text))
            size = _size(lang, codes)
            hashes = tokens(codes, size).view(np.int64)
            item, part, n, size = (np.full(len(hashes), x) for x in (item, part, len(codes), size))
            columns = [hashes, item, part, np.arange(len(hashes)), n, size]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=_TERMS)


def passage_terms(items: DataFrame, item: str, lang: str, passage: str) -> DataFrame:
    """(token, item, part, of, n, size): the terms of passages with their offsets, letters of the passage and of a term.

    An id with several texts has as many parts, which count apart.
    """
    rows = items.select(F.col(item).cast("bigint").alias("item"), F.col(lang).alias("lang"), F.col(passage).alias("passage"))
    rows = rows.filter("item IS NOT NULL AND passage <> ''").distinct().select("item", F.xxhash64("passage", "lang").alias("part"), "lang", "passage")
    return rows.mapInArrow(_passage_terms, "token long, item long, part long, of long, n long, size long")


def term_filter(terms: DataFrame) -> np.ndarray:
    """A bit for each leading FILTER_BITS of a term's hash; at most 2 ** (FILTER_BITS - 6) words come to the driver."""
    spot = F.shiftrightunsigned("token", 64 - FILTER_BITS)
    words = terms.select(F.shiftright(spot, 6).alias("word"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(token, {64 - FILTER_BITS}) & 63 AS int))").alias("bit"))
    words = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(2 ** (FILTER_BITS - 6), np.uint64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return out


def candidate_places(postings: DataFrame, terms: DataFrame, share: float) -> DataFrame:
    """(doc, item, n, size, hits): the hits (of, at) in a place of a document that may hold that share of a passage.

    A place is as wide as the stretches of a passage can lie apart, and places overlap by half, so none is cut. Stretches
    of a share of n letters hold at least share * n / size distinct terms. So a place must hold one of the rarest terms
    of its passage, all but as many as that number less one, and places without them are not looked for in
    the lists of the others.
    """
    least = F.ceil(F.ceil(F.lit(share) * F.col("n")) / F.col("size"))
    df = postings.groupBy("token").agg(F.count("*").alias("df"))
    common = Window.partitionBy("item", "part").orderBy(F.col("df").desc(), "of")
    ranked = terms.join(df, "token").withColumn("rare", F.row_number().over(common) >= least)
    # Letters between the first and the last stretch: n for the stretches and n for each gap.
    width = F.expr("n + (n div size + 1) * n")
    hits = postings.join(ranked, "token").select("doc", "item", "part", "n", "size", "of", "at", "rare", F.floor(F.col("at") / width).alias("p"))
    hits = materialize(hits.select(*hits.columns[:-1], F.explode(F.array(F.col("p"), F.col("p") - 1)).alias("place")), "hits")
    place = ["doc", "item", "part", "n", "size", "place"]
    wanted = hits.filter("rare").select(place).distinct()
    near = hits.join(wanted, place, "left_semi").groupBy(place).agg(F.collect_set(F.struct("of", "at")).alias("hits"))
    out = near.filter(F.size(F.array_distinct("hits.of")) >= least).select("doc", "item", "n", "size", "hits")
    out = materialize(out, "places")
    release(terms.sparkSession, hits)
    return out


def phrases(hits: list[tuple[int, int]], size: int) -> list[tuple[int, int, int]]:
    """(offset, position, letters) of the longest stretches that hits of size letters add up to."""
    hits = np.array(sorted(hits, key=lambda h: (h[1] - h[0], h[0])), np.int64).reshape(-1, 2)
    if not len(hits):
        return []
    new = np.append(True, (np.diff(hits[:, 0]) != 1) | (np.diff(hits[:, 1]) != 1))
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(hits)))
    return sorted(zip(hits[first, 0].tolist(), hits[first, 1].tolist(), (n + size - 1).tolist(), strict=True))


def covered_letters(hits: list[tuple[int, int]], size: int, n: int) -> int:
    """Letters of a passage of n letters that its best chain of phrases covers, in order, with gaps up to n."""
    found = np.array(phrases(hits, size), np.int64).reshape(-1, 3)
    end_a, end_b, score = found[:, 0] + found[:, 2], found[:, 1] + found[:, 2], np.zeros(len(found), np.int64)
    for k, (i, j, length) in enumerate(found):
        over = np.maximum(0, np.maximum(end_a[:k] - i, end_b[:k] - j))
        fits = (found[:k, 0] < i) & (found[:k, 1] < j) & (over < length) & (j - end_b[:k] <= n)
        score[k] = length + max(0, int((score[:k] - over)[fits].max(initial=0)))
    return int(score.max(initial=0))


_FOUND = pa.schema([("doc", pa.int64()), ("item", pa.int64()), ("share", pa.float64())])


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        shares = []
        for n, size, hits in zip(*(c.to_pylist() for c in batch.columns[2:]), strict=True):
            shares.append(covered_letters([(h["of"], h["at"]) for h in hits], size, n) / n)
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(shares, pa.float64())], schema=_FOUND)


def search(postings: DataFrame, terms: DataFrame, share: float = 0.5) -> DataFrame:
    """(doc, item, share): documents of an index that hold at least that share of a passage's letters in one place."""
    found = candidate_places(postings, terms, share).mapInArrow(_chained, "doc long, item long, share double")
    return found.groupBy("doc", "item").agg(F.max("share").alias("share")).filter(F.col("share") >= share)


def leaked_passages(docs: DataFrame, key: str, text: str, items: DataFrame, item: str, lang: str, passage: str, share: float = 0.5) -> DataFrame:
    """(doc, item, share): documents that hold at least that share of a passage's letters in one place.

    Counted are stretches of 15 (ja) or 30 (en) letters in the passage's order. Rows with a null key or a null or empty
    text take no part; passages too short for a stretch cannot be found; repeated rows give one result row; documents
    with the same key are one index entry each, told apart only by their positions.
    """
    terms = materialize(passage_terms(items, item, lang, passage), "terms")
    postings = materialize(positional_index(docs, key, text, term_filter(terms)), "postings")
    found = search(postings, terms, share)
    release(docs.sparkSession, terms, postings)
    return found
