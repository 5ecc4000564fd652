"""Problem 8: long exact spans that records share, by collinear chaining of k-mer seeds.

Seeds are minimizers: in every window of W neighbouring K-mers the one with the least hash. A span of K + W - 1
characters that two texts share holds the same minimizer in both. Around seeds that several texts hold, the spans of the
least length are hashed; those that the same set of documents holds belong to one class, and a class has a
representative and members, however many they are. Each member's seeds are joined with those of its representative,
the matches are chained with gap costs through a Fenwick tree, and the chains are aligned with the texts, which gives
fuzzy passages and the exact spans inside them. Of texts that are equal in full, one represents all.
"""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tanmono.llm.hashing import codes_of, gram_hashes
from tanmono.plans.storage import materialize, release

#: Cost of a chain for each character between two seeds, in characters; longest gap that is aligned.
GAP_COST, GAP = 0.1, 400
#: Members of a class that meet all others in one task.
MEET = 1_000


def _sliding(values: np.ndarray, w: int, pick: np.ufunc, worst: np.uint64) -> np.ndarray:
    """pick over every window of w values, from running picks within blocks in both directions."""
    rows = -(-len(values) // w)
    block = np.full(rows * w, worst, np.uint64)
    block[: len(values)] = values
    block = block.reshape(rows, w)
    ahead = pick.accumulate(block, axis=1).ravel()
    behind = pick.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(values) - w + 1
    return pick(behind[:n], ahead[w - 1 : w - 1 + n])


def minimizers(hashes: np.ndarray, w: int) -> np.ndarray:
    """Positions whose hash is the least of some window of w; of all, if there are fewer."""
    if not len(hashes):
        return np.empty(0, np.int64)
    w = min(w, len(hashes))
    low, top = np.uint64(0), np.uint64(2**64 - 1)
    least = _sliding(hashes, w, np.minimum, top)
    padded = np.concatenate([np.zeros(w - 1, np.uint64), least, np.zeros(w - 1, np.uint64)])
    return np.flatnonzero(_sliding(padded, w, np.maximum, low) == hashes)


_SEEDS = pa.schema([("seed", pa.int64()), ("doc", pa.int64()), ("at", pa.int32())])


def _seed_batch(seeds: list, docs: list, at: list) -> pa.RecordBatch:
    columns = [np.concatenate([np.empty(0, t), *c]).astype(t) for c, t in ((seeds, np.int64), (docs, np.int64), (at, np.int32))]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=_SEEDS)


def _seeds(least: int):
    k = least // 2
    w = least - k + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seeds, docs, at = [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                hashes = gram_hashes(codes_of(text), k)
                spots = minimizers(hashes, w)
                if len(np.unique(hashes[spots])) < len(spots):  # the text repeats itself: one seed for each surrounding
                    around = {text[max(0, p - least + k) : p + least]: p for p in reversed(spots.tolist())}
                    spots = np.array(sorted(around.values()))
                seeds.append(hashes[spots].view(np.int64)), at.append(spots), docs.append(np.full(len(spots), doc))
            yield _seed_batch(seeds, docs, at)

    return run


_SPANS = pa.schema([("span", pa.int64()), ("doc", pa.int64()), ("at", pa.int64()), ("first", pa.bool_())])


def _around(least: int):
    """All spans of the least length that hold a shared seed; first is true at a text's first place with that span."""
    k = least // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, text, seeds in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                codes = codes_of(text)
                hashes, held = gram_hashes(codes, least), np.isin(gram_hashes(codes, k), np.array(seeds, np.int64).view(np.uint64))
                # A span at s holds a seed if one starts in s ... s + least - k.
                count = np.append(0, np.cumsum(held))
                at = np.flatnonzero(count[least - k + 1 :][: len(hashes)] > count[: len(hashes)])
                values, first = np.unique(hashes[at], return_index=True)
                is_first = np.zeros(len(at), bool)
                is_first[first] = True
                columns = (hashes[at].view(np.int64), np.full(len(at), doc), at, is_first)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SPANS, strict=True)], schema=_SPANS)

    return run


class Fenwick:
    """Greatest value over a prefix of positions, with what it stands for."""

    def __init__(self, n: int) -> None:
        self.best: list[tuple[float, int]] = [(float("-inf"), -1)] * (n + 1)

    def put(self, at: int, value: tuple[float, int]) -> None:
        at += 1
        while at < len(self.best):
            if self.best[at] < value:
                self.best[at] = value
            at += at & -at

    def top(self, before: int) -> tuple[float, int]:
        found = self.best[0]
        while before:
            found = max(found, self.best[before])
            before -= before & -before
        return found


def chains(matches: list[tuple[int, int]], weight: float, cost: float = GAP_COST) -> list[list[tuple[int, int]]]:
    """Matches (position in a, position in b) as chains that rise in both, the best chain first.

    A chain's score is weight for each match less cost for each character between neighbours, in a and in b.
    Matches are used once; each round chains what is left.
    """
    out, left = [], sorted(set(matches))
    while left:
        rank = {b: r for r, b in enumerate(sorted({b for _, b in left}))}
        tree, score, before = Fenwick(len(rank)), [], []
        pending: list[int] = []
        for n, (a, b) in enumerate(left):
            if pending and left[pending[0]][0] < a:
                for m in pending:
                    tree.put(rank[left[m][1]], (score[m] + cost * sum(left[m]), m))
                pending = []
            value, m = tree.top(rank[b])
            gain = value - cost * (a + b)
            score.append(weight + max(0.0, gain))
            before.append(m if gain > 0 else -1)
            pending.append(n)
        n = max(range(len(left)), key=lambda m: (score[m], -m))
        chain = []
        while n >= 0:
            chain.append(n)
            n = before[n]
        out.append([left[m] for m in reversed(chain)])
        used = set(chain)
        left = [x for m, x in enumerate(left) if m not in used]
    return out


def _equal_run(a: str, b: str) -> int:
    """Length of the common prefix."""
    lo, step, most = 0, 64, min(len(a), len(b))
    while lo < most and a[lo : lo + step] == b[lo : lo + step] and lo + step <= most:
        lo += step
        step *= 2
    hi = min(most, lo + step)
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[lo:mid] == b[lo:mid] else (lo, mid - 1)
    return lo


def exact_span(a: str, b: str, i: int, j: int) -> tuple[int, int, int]:
    """The longest span around a[i], b[j] that is equal in both: start in a, start in b, length."""
    back = min(i, j)
    left = _equal_run(a[i - back : i][::-1], b[j - back : j][::-1])
    return i - left, j - left, left + _equal_run(a[i:], b[j:])


def aligned(a: str, b: str, chain: list[tuple[int, int]]) -> list[dict]:
    """A chain's passages, each with its bounds in a and b, the equal characters and the longest exact span."""
    out: list[dict] = []
    for i, j in chain:
        last = out[-1] if out else None
        if last and i - last["a"] < last["length"] and i - j == last["a"] - last["b"]:
            continue  # inside the span at hand
        x, y, n = exact_span(a, b, i, j)
        span = {"a": x, "b": y, "length": n}
        if last and 0 <= x - last["end_a"] <= GAP and 0 <= y - last["end_b"] <= GAP:
            gap = SequenceMatcher(None, a[last["end_a"] : x], b[last["end_b"] : y], False)
            equal = sum(m.size for m in gap.get_matching_blocks())
            last |= span | {"end_a": x + n, "end_b": y + n, "equal": last["equal"] + equal + n, "spans": [*last["spans"], (x, y, n)]}
        else:
            out.append(span | {"start_a": x, "start_b": y, "end_a": x + n, "end_b": y + n, "equal": n, "spans": [(x, y, n)]})
    return out


_PASSAGES = pa.schema(
    [(c, pa.int64()) for c in ("a", "b", "start_a", "end_a", "start_b", "end_b", "equal", "longest")]
    + [(c, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))) for c in ("spans_a", "spans_b")]
)
_PASSAGES_DDL = (
    "a long, b long, start_a long, end_a long, start_b long, end_b long, equal long, longest long, "
    "spans_a array<struct<start:long,end:long>>, spans_b array<struct<start:long,end:long>>"
)


def _everywhere(codes: np.ndarray, spans: list[tuple[int, int]], least: int) -> list[dict]:
    """The spans of a text, together with all other places where it repeats a part of them of the least length."""
    hashes = gram_hashes(codes, least)
    starts = np.unique(np.concatenate([np.arange(a, b - least + 1) for a, b in spans]))
    at = np.flatnonzero(np.isin(hashes, hashes[starts]))
    breaks = np.flatnonzero(np.diff(at) > 1)
    first, last = at[np.append(0, breaks + 1)], at[np.append(breaks, len(at) - 1)]
    return [{"start": int(a), "end": int(b) + least} for a, b in zip(first, last, strict=True)]


def _passages(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for a, b, matches, text_a, text_b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                codes_a, codes_b = codes_of(text_a), codes_of(text_b)
                for chain in chains([(m["at_a"], m["at_b"]) for m in matches], least // 2):
                    for p in aligned(text_a, text_b, chain):
                        long = [s for s in p["spans"] if s[2] >= least]
                        if long:
                            rows.append({
                                "a": a, "b": b, "start_a": p["start_a"], "end_a": p["end_a"], "start_b": p["start_b"], "end_b": p["end_b"],
                                "equal": p["equal"], "longest": max(s[2] for s in long),
                                "spans_a": _everywhere(codes_a, [(x, x + n) for x, _, n in long], least),
                                "spans_b": _everywhere(codes_b, [(y, y + n) for _, y, n in long], least),
                            })
            yield pa.RecordBatch.from_pylist(rows, schema=_PASSAGES)

    return run


def representatives(docs: DataFrame, key: str, text: str, least: int) -> DataFrame:
    """(doc, rep): the ids of texts that stand there more than once, with the smallest id of each such group."""
    rows = docs.select(F.col(key).cast("bigint").alias("doc"), F.unhex(F.md5(text)).alias("digest"), F.char_length(text).alias("n"))
    rows = rows.filter(F.col("doc").isNotNull() & (F.col("n") >= least)).select("doc", "digest")
    groups = rows.groupBy("digest").agg(F.min("doc").alias("rep"), F.max("doc").alias("top")).filter("rep < top")
    return rows.join(groups, "digest").select("doc", "rep").distinct()


def _texts(docs: DataFrame, key: str, text: str, least: int, copies: DataFrame) -> DataFrame:
    """(doc, text): one of every group of equal texts."""
    rows = docs.select(F.col(key).cast("bigint").alias("doc"), F.col(text).alias("text"))
    rows = rows.filter(F.col("doc").isNotNull() & (F.char_length("text") >= least))
    return rows.join(copies.filter("doc <> rep").select("doc"), "doc", "left_anti")


def shared_spans(rows: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """Shared seeds (seed, doc, at) and shared spans (span, class, rep, doc, at, first) of rows(doc, text).

    Spans are all places of texts where a span of the least length starts that another document holds too. class tells the set
    of documents that hold the span, by the sum of their hashes; rep is the smallest of them.
    """
    seeds = materialize(rows.mapInArrow(_seeds(least), "seed long, doc long, at int"), "seeds")
    both = seeds.groupBy("seed").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).filter("lo < hi").select("seed")
    found = materialize(seeds.join(both, "seed", "left_semi"), "found")
    wanted = found.groupBy("doc").agg(F.collect_set("seed").alias("seeds"))
    spans = rows.join(wanted, "doc").select("doc", "text", "seeds").mapInArrow(_around(least), "span long, doc long, at long, first boolean")
    spans = materialize(spans, "around")
    member = F.when(F.col("first"), F.xxhash64("doc").cast("decimal(20,0)"))
    held = spans.groupBy("span").agg(F.min("doc").alias("rep"), F.max("doc").alias("hi"), F.sum(member).alias("class")).filter("rep < hi")
    shared = materialize(spans.join(held.select("span", "class", "rep"), "span"), "shared")
    release(rows.sparkSession, seeds, spans)
    return found, shared


def shared_passages(rows: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """Passages of representatives and members of classes, and the members (class, rep, doc) with such a passage.

    A passage is a row (a, b, start_a, end_a, start_b, end_b, equal, longest, spans_a, spans_b) with at least one exact
    span of least characters, a being the representative.
    """
    found, shared = shared_spans(rows, least)
    one = shared.groupBy("class").agg(F.min("span").alias("span"))
    members = materialize(shared.filter("first").join(one, ["class", "span"], "left_semi").select("class", "rep", "doc"), "members")
    pairs = members.filter("rep <> doc").select(F.col("rep").alias("a"), F.col("doc").alias("b")).distinct()
    b = found.select("seed", F.col("doc").alias("b"), F.col("at").alias("at_b"))
    a = found.select("seed", F.col("doc").alias("a"), F.col("at").alias("at_a"))
    matches = pairs.join(b, "b").join(a, ["a", "seed"]).groupBy("a", "b").agg(F.collect_set(F.struct("at_a", "at_b")).alias("matches"))
    both = matches.join(rows.select(F.col("doc").alias("a"), F.col("text").alias("text_a")), "a")
    both = both.join(rows.select(F.col("doc").alias("b"), F.col("text").alias("text_b")), "b")
    passages = both.select("a", "b", "matches", "text_a", "text_b").mapInArrow(_passages(least), _PASSAGES_DDL)
    passages = materialize(passages, "passages")
    true = passages.select(F.col("a").alias("rep"), F.col("b").alias("doc")).distinct()
    members = members.filter("rep = doc").unionByName(members.join(true, ["rep", "doc"], "left_semi"))
    release(rows.sparkSession, found, shared)
    return passages, members


def _meetings(members: DataFrame, group: str) -> DataFrame:
    """(doc_a, doc_b), doc_a < doc_b: all pairs of members of a group, a large group spread over many tasks."""
    sizes = members.groupBy(group).agg(F.ceil(F.count("*") / MEET).alias("parts"))
    rows = members.join(sizes, group)
    a = rows.select(group, F.col("doc").alias("doc_a"), F.pmod(F.xxhash64("doc"), "parts").alias("part"))
    b = rows.select(group, F.col("doc").alias("doc_b"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    return a.join(b, [group, "part"]).filter("doc_a < doc_b").select("doc_a", "doc_b").distinct()


def span_passages(docs: DataFrame, key: str, text: str, least: int = 240) -> DataFrame:
    """Passages (see shared_passages) of each document with the representatives of the classes it is in, copies by their first."""
    rows = _texts(docs, key, text, least, materialize(representatives(docs, key, text, least), "copies"))
    return shared_passages(rows, least)[0]


def sharing_pairs(docs: DataFrame, key: str, text: str, least: int = 240) -> DataFrame:
    """(doc_a, doc_b), doc_a < doc_b: documents that share a span of at least least characters, copies included.

    Rows with null id or text take no part, nor do texts shorter than least. The members of a class and the copies of a
    text are pairwise results; everything up to there is one row for each member.
    """
    copies = materialize(representatives(docs, key, text, least), "copies")
    _, members = shared_passages(_texts(docs, key, text, least, copies), least)
    pairs = _meetings(members, "class").toDF("a", "b")
    pairs = pairs.join(copies.toDF("doc_a", "a"), "a", "left").withColumn("doc_a", F.coalesce("doc_a", "a"))
    pairs = pairs.join(copies.toDF("doc_b", "b"), "b", "left").withColumn("doc_b", F.coalesce("doc_b", "b"))
    between = pairs.select(F.least("doc_a", "doc_b").alias("doc_a"), F.greatest("doc_a", "doc_b").alias("doc_b"))
    return between.unionByName(_meetings(copies, "rep"))


def shared_share(docs: DataFrame, key: str, text: str, least: int = 240) -> DataFrame:
    """(doc, n_chars, n_shared): for each document, how many of its characters stand in spans that others hold too.

    Overlapping spans count once; a text that has copies is shared as a whole. Texts shorter than least share nothing.
    Documents never meet in pairs: a span says by itself whether another document holds it.
    """
    copies = materialize(representatives(docs, key, text, least), "copies")
    found, shared = shared_spans(_texts(docs, key, text, least, copies), least)
    release(docs.sparkSession, found)
    following = F.lead("at").over(Window.partitionBy("doc").orderBy("at"))
    length = F.least(F.lit(least), F.coalesce(following - F.col("at"), F.lit(least)))
    covered = shared.select("doc", length.alias("n")).groupBy(F.col("doc").alias("rep")).agg(F.sum("n").alias("covered"))
    rows = docs.select(F.col(key).cast("bigint").alias("doc"), F.char_length(text).cast("bigint").alias("n_chars")).filter("doc IS NOT NULL")
    rows = rows.join(copies.withColumn("copied", F.lit(True)), "doc", "left").withColumn("rep", F.coalesce("rep", "doc"))
    rows = rows.join(covered, "rep", "left")
    shared = F.when(F.col("copied"), F.col("n_chars")).otherwise(F.coalesce("covered", F.lit(0)))
    return rows.select("doc", F.coalesce("n_chars", F.lit(0)).alias("n_chars"), F.coalesce(shared, F.lit(0)).alias("n_shared"))
