"""Problem 5: how often every term occurs, and in how many records, from a distributed suffix array.

The suffixes of all records are range-partitioned and sorted, which lays the suffix array out over the cluster. A run
of neighbours whose common prefix has at least n terms is the interval of an n-gram: its weights add up to the n-gram's
occurrences, and its rows less those that repeat the n-gram within their record are the n-gram's records. An interval
that crosses a partition edge comes out in parts, which a last small aggregation adds up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Stands between the terms of a suffix; it cannot be part of a term.
UNIT = "\x1f"


def _suffixes(max_n: int):
    """Records to suffixes of at most max_n terms; again is the longest prefix shared with another one of the record."""
    schema = pa.schema([("suffix", pa.string()), ("weight", pa.int64()), ("again", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[list[str], int]] = []
            for terms in batch.column(0).to_pylist():
                terms = [t for t in terms or () if t is not None]
                last: list[str] = []
                for suffix in sorted(terms[i : i + max_n] for i in range(len(terms))):
                    same = next((k for k, (a, b) in enumerate(zip(suffix, last, strict=False)) if a != b), min(len(suffix), len(last)))
                    out.append((suffix, same))
                    last = suffix
            columns = [pa.array([UNIT.join(s) for s, _ in out], pa.string()), pa.array([1] * len(out), pa.int64()), pa.array([k for _, k in out], pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return run


class _Intervals:
    """The open intervals of the suffix array, one for each prefix of the last suffix."""

    def __init__(self) -> None:
        self.terms: list[str] = []
        self.open: list[list[int]] = []
        self.done: list[tuple[str, int, int, int]] = []

    def move(self, terms: list[str]) -> None:
        """On to a suffix: close every interval that it does not share."""
        same = next((k for k, (a, b) in enumerate(zip(terms, self.terms, strict=False)) if a != b), min(len(terms), len(self.terms)))
        for n in range(len(self.terms), same, -1):
            self.done.append((UNIT.join(self.terms[:n]), n, *self.open.pop()))
        self.open.extend([0, 0] for _ in terms[same:])
        self.terms = terms

    def add(self, weight: int, rows: np.ndarray, again: np.ndarray) -> None:
        """rows: how many records each line stands for; again: the terms that these have in common with an earlier line."""
        for n, counts in enumerate(self.open, 1):
            counts[0] += weight
            counts[1] += int(rows[again < n].sum())


_OUT = pa.schema([("ngram", pa.string()), ("n", pa.int32()), ("total", pa.int64()), ("records", pa.int64())])


def _intervals(keyed: bool):
    """Sorted suffixes to n-grams. keyed: rows carry record and row keys, by which repeated rows and records are told."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, last = _Intervals(), None

        def flush() -> pa.RecordBatch:
            columns = zip(*state.done, strict=True) if state.done else ((), (), (), ())
            state.done = []
            return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, _OUT, strict=True)], schema=_OUT)

        for batch in batches:
            if not batch.num_rows:
                continue
            suffixes = pc.dictionary_encode(batch.column(0))
            codes, names = suffixes.indices.to_numpy(), suffixes.dictionary.to_pylist()
            weights = batch.column(1).to_numpy()
            new = np.append(True, codes[1:] != codes[:-1])
            goes_on = last is not None and last[0] == names[codes[0]]
            if keyed:
                record, row = batch.column(2).to_numpy(), batch.column(3).to_numpy()
                again = np.append(goes_on and last[1] == record[0], (record[1:] == record[:-1]) & ~new[1:])
                repeated = again & np.append(goes_on and last[2] == row[0], row[1:] == row[:-1])
                last = (names[codes[-1]], record[-1], row[-1])
                again, rows = again.astype(np.int32), np.ones(len(codes), np.int64)
            else:
                again, rows, repeated = batch.column(2).to_numpy(), batch.column(3).to_numpy(), np.zeros(len(codes), bool)
            starts = np.flatnonzero(new)
            for a, b in zip(starts, [*starts[1:], len(codes)], strict=True):
                name, keep = names[codes[a]], ~repeated[a:b]
                state.move([name] if keyed else name.split(UNIT))
                state.add(int(weights[a:b][keep].sum()), rows[a:b][keep], again[a:b][keep])
            if len(state.done) > 20_000:
                yield flush()
        state.move([])
        yield flush()

    return run


def _merged(parts: DataFrame) -> DataFrame:
    return parts.groupBy("ngram", "n").agg(F.sum("total").alias("total"), F.sum("records").alias("records"))


def ngram_counts(df: DataFrame, terms: str, max_n: int) -> DataFrame:
    """(ngram, n, total, records) for every n-gram of up to max_n terms; terms is an array column, a row a record.

    Null and empty arrays and null terms count for nothing; the terms of an n-gram are joined by UNIT. Equal suffixes
    are added up before they cross the network, so a suffix that many records hold is a few rows.
    """
    suffixes = df.select(F.col(terms).alias("t")).mapInArrow(_suffixes(max_n), "suffix string, weight long, again int")
    sums = suffixes.groupBy("suffix", "again").agg(F.sum("weight").alias("weight"), F.count("*").alias("rows"))
    array = sums.select("suffix", "weight", "again", "rows").repartitionByRange("suffix").sortWithinPartitions("suffix")
    return _merged(array.mapInArrow(_intervals(False), "ngram string, n int, total long, records long"))


def value_counts(df: DataFrame, record: str, value: str, weight: str, row_key: list[str]) -> DataFrame:
    """(value, total, records) for every value that records carry, each row of df being one suffix of one term.

    A null weight counts as 1; rows with null record or value are left out; rows equal in record, value and row_key
    count once. A value that fills a third of all rows is spread over many partitions, as the range is cut by value
    and record together.
    """
    weight_column = F.coalesce(F.col(weight), F.lit(1)).cast("bigint").alias("weight")
    rows = df.select(F.col(value).alias("suffix"), weight_column, F.col(record).cast("bigint").alias("record"), F.xxhash64(*row_key).alias("row"))
    array = rows.filter("suffix IS NOT NULL AND record IS NOT NULL").repartitionByRange("suffix", "record")
    array = array.sortWithinPartitions("suffix", "record", "row")
    counts = _merged(array.mapInArrow(_intervals(True), "ngram string, n int, total long, records long"))
    return counts.select(F.col("ngram").alias("value"), "total", "records")


def marked(counts: DataFrame, n_records: int, rare: int = 2, common: float = 0.03) -> DataFrame:
    """value_counts() rows with the marks rare (a total of 1 to rare) and common (in at least that share of records)."""
    is_rare, is_common = F.col("total").between(1, rare), F.col("records") >= common * n_records
    return counts.withColumns({"rare": is_rare, "common": is_common & (F.col("records") > 0)})
