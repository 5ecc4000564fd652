"""Problem 2: records that differ only in formatting, collapsed by recursive radix partitioning into tries.

A record's canonical bytes are the letters, digits and combining marks of its two texts, in lower case, the lesser
text first. Buckets are the records whose bytes begin alike. A bucket with more rows than fit is split by further
bytes, twice as many each time, until each bucket fits. What cannot be split is one record with very many copies;
its rows are spread by id instead. Each bucket then goes into one trie whose terminal nodes hold the ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tanmono.plans.storage import materialize, release

#: Rows of a bucket that one task may hold.
FITS = 50_000
#: Bytes that the first split looks at.
FIRST_BYTES = 4
_DROPPED = r"[^\p{L}\p{N}\p{M}]|[\x{fe00}-\x{fe0f}\x{e0100}-\x{e01ef}]"


def canonical_bytes(first: Column, second: Column) -> Column:
    """The bytes that formatting and the order of the two fields do not change."""
    a, b = (F.regexp_replace(F.lower(x), _DROPPED, "") for x in (first, second))
    return F.concat_ws("\x1f", F.least(a, b), F.greatest(a, b)).cast("binary")


class _Node:
    __slots__ = ("edges", "ids")

    def __init__(self) -> None:
        self.edges: dict[int, tuple[bytes, _Node]] = {}
        self.ids: set[int] = set()


class Trie:
    """Byte strings with the ids that carry them; chains without a branch are one edge."""

    def __init__(self) -> None:
        self.root = _Node()

    def add(self, key: bytes, record: int) -> None:
        node, at = self.root, 0
        while at < len(key):
            edge = node.edges.get(key[at])
            if edge is None:
                leaf = _Node()
                node.edges[key[at]] = (key[at:], leaf)
                node = leaf
                break
            label, child = edge
            if not key.startswith(label, at):
                lo, hi = 1, min(len(label), len(key) - at)
                while lo < hi:
                    mid = (lo + hi + 1) // 2
                    lo, hi = (mid, hi) if key.startswith(label[:mid], at) else (lo, mid - 1)
                fork = _Node()
                fork.edges[label[lo]] = (label[lo:], child)
                node.edges[key[at]] = (label[:lo], fork)
                label, child = label[:lo], fork
            node, at = child, at + len(label)
        node.ids.add(record)

    def terminals(self) -> Iterator[set[int]]:
        stack = [self.root]
        while stack:
            node = stack.pop()
            if node.ids:
                yield node.ids
            stack.extend(child for _, child in node.edges.values())


def radix_buckets(rows: DataFrame, fits: int = FITS, first_bytes: int = FIRST_BYTES) -> tuple[DataFrame, list[DataFrame]]:
    """rows(id, key) with columns bucket and salted, and the tables of large prefixes that these are read from.

    Every level counts only the rows of buckets that are still too large. Their prefixes form a small table (at most
    rows / fits of them), which Spark broadcasts or shuffles by its size. Copies of one record end at the same level;
    if they alone exceed a bucket, their rows get a salt from their id and salted is true.
    """
    levels, left, depth = [], rows, first_bytes
    while True:
        prefix, ended = F.substring("key", 1, depth), F.octet_length("key") <= depth
        counts = left.groupBy(prefix.alias("prefix")).agg(
            F.count("*").alias("n"), F.sum(ended.cast("bigint")).alias("n_ended")
        )
        large = materialize(counts.filter(F.col("n") > fits).withColumn("salts", F.ceil(F.col("n_ended") / fits)), "radix")
        state = large.agg(F.count("*").alias("n"), F.sum(F.col("n") - F.col("n_ended")).alias("open")).first()
        if not state["n"]:
            break
        levels.append((depth, large))
        if not state["open"]:
            break
        left = left.filter(~ended).join(large.select(F.col("prefix").alias("p")), prefix == F.col("p"), "left_semi")
        depth *= 2
    open_, bucket, salted = F.lit(True), F.substring("key", 1, first_bytes), F.lit(False)
    for k, (depth, large) in enumerate(levels):
        row = large.select(F.col("prefix").alias(f"p{k}"), F.col("salts").alias(f"s{k}"))
        rows = rows.join(row, F.substring("key", 1, depth) == F.col(f"p{k}"), "left")
        inside, ends = open_ & F.col(f"p{k}").isNotNull(), F.octet_length("key") <= depth
        salt = F.pmod(F.xxhash64("id"), F.greatest(F.col(f"s{k}"), F.lit(1))).cast("string").cast("binary")
        stop = F.concat(F.col("key"), F.lit("\x1e").cast("binary"), salt)
        bucket = F.when(inside, F.when(ends, stop).otherwise(F.substring("key", 1, depth * 2))).otherwise(bucket)
        salted = F.when(inside & ends, F.col(f"s{k}") > 1).otherwise(salted)
        open_ = inside & ~ends
    return rows.select("id", "key", bucket.alias("bucket"), salted.alias("salted")), [large for _, large in levels]


def _tries(members: bool):
    schema = pa.schema([("digest", pa.binary()), ("first_id", pa.int64()), ("copy_id", pa.int64()), ("n", pa.int64())])

    def emit(trie: Trie, digest: bytes | None, out: list[tuple]) -> None:
        for ids in trie.terminals():
            first = min(ids)
            if not members:
                out.append((digest, first, None, len(ids)))
            elif digest is not None:
                out.extend((digest, first, i, None) for i in ids)
            elif len(ids) > 1:
                out.extend((None, first, i, None) for i in ids if i != first)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        def flush(out: list[tuple]) -> pa.RecordBatch:
            columns = zip(*out, strict=True) if out else ((), (), (), ())
            return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        trie, at, digest, out = None, None, None, []
        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("bucket", "key", "id", "salted")]
            for bucket, key, record, salted in zip(*columns, strict=True):
                if bucket != at or trie is None:
                    if trie is not None:
                        emit(trie, digest, out)
                    trie, at = Trie(), bucket
                    digest = hashlib.md5(key).digest() if salted else None
                trie.add(key, record)
            if len(out) > 20_000:
                yield flush(out)
                out = []
        if trie is not None:
            emit(trie, digest, out)
        yield flush(out)

    return run


def _counted(df: DataFrame, key: str, first: str, second: str, fits: int, members: bool) -> DataFrame:
    rows = df.select(F.col(key).cast("bigint").alias("id"), F.col(first).alias("a"), F.col(second).alias("b"))
    rows = rows.filter("id IS NOT NULL AND a <> '' AND b <> ''")
    rows = materialize(rows.select("id", canonical_bytes(F.col("a"), F.col("b")).alias("key")), "canonical")
    buckets, prefixes = radix_buckets(rows, fits)
    sorted_ = buckets.repartition("bucket").sortWithinPartitions("bucket")
    out = materialize(sorted_.mapInArrow(_tries(members), "digest binary, first_id bigint, copy_id bigint, n bigint"), "tries")
    release(df.sparkSession, rows, *prefixes)
    return out


def copy_members(df: DataFrame, key: str, first: str, second: str, fits: int = FITS) -> DataFrame:
    """(first_id, copy_id): every id of a group of copies but the smallest, with the smallest.

    Rows with null id or a null or empty text take no part; an id given more than once counts once. Two records
    without any letter or digit are copies of each other, as nothing but punctuation sets them apart.
    """
    out = _counted(df, key, first, second, fits, True)
    whole = out.filter("digest IS NULL").select("first_id", "copy_id")
    parts = out.filter("digest IS NOT NULL")
    least = parts.groupBy("digest").agg(F.min("first_id").alias("least"))
    split = parts.join(least, "digest").select(F.col("least").alias("first_id"), "copy_id").filter("first_id <> copy_id")
    return whole.unionByName(split)


def distinct_records(df: DataFrame, key: str, first: str, second: str, fits: int = FITS) -> DataFrame:
    """(first_id, n_copies): each distinct record once, under its smallest id, with the number of its ids."""
    out = _counted(df, key, first, second, fits, False)
    whole = out.filter("digest IS NULL").select("first_id", F.col("n").alias("n_copies"))
    parts = out.filter("digest IS NOT NULL").groupBy("digest")
    split = parts.agg(F.min("first_id").alias("first_id"), F.sum("n").alias("n_copies")).drop("digest")
    return whole.unionByName(split)
