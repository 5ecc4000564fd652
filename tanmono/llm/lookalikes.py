"""Problem 1: texts that look the same although their characters differ.

Every text is brought to its confusables skeleton: invisible characters are dropped, the rest is decomposed
canonically, every character is replaced by the prototype of its look-alike class, and the result is decomposed again.
Two texts read alike to the eye exactly if their skeletons are equal.

The table of prototypes is the public one of Unicode's security mechanisms (some 6,300 characters, prototypes of one or more
characters), read from the data of the ICU library that Spark brings. Widths and kinds of a blank are classes of
their own, as are a few pairs of kana and kanji that the public table lacks.
"""

from __future__ import annotations

import os
import re
import struct
import sys
import unicodedata
import zipfile
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pandas as pd
import pyspark
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tanmono.plans.storage import materialize, release

#: Look-alike classes beside the public table: the first character of a row is the prototype of the others.
CLASSES = """
リ り
チ 千
オ 才
ミ 三
ヒ 匕
ヌ 又
ム 厶
ヽ 丶
日 曰
q ԛ
~ 〜 ∼
"""
#: Characters that the public table joins with others although readers of Japanese tell them apart by their strokes, or by the
#: kind of mark they are.
APART = "士く。"

#: Characters without any picture: soft hyphen, joiners, zero-width marks, variation selectors and the like.
INVISIBLE = (
    "\u00ad\u034f\u061c\u115f-\u1160\u17b4-\u17b5\u180b-\u180f\u200b-\u200f\u202a-\u202e\u2060-\u206f"
    "\u3164\ufe00-\ufe0f\ufeff\uffa0\ufff0-\ufff8\U0001bca0-\U0001bca3\U0001d173-\U0001d17a\U000e0000-\U000e0fff"
)
_INVISIBLE = re.compile(f"[{INVISIBLE}]")
#: Kinds of a blank; line ends are blanks too.
BLANKS = "\t\n\v\f\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


#: Members of a group that meet all others in one task.
MEET = 1_000


def public_table(source: str | None = None) -> dict[int, str]:
    """Character to prototype, from ICU's compiled confusables: a .cfu file, or the ICU jar that holds it (that of Spark, if None)."""
    if source is None:
        folders = [Path(f) / "jars" for f in (os.environ.get("SPARK_HOME"), pyspark.__path__[0]) if f]
        jars = [str(j) for f in folders for j in sorted(f.glob("icu4j-*.jar"))]
        if not jars:
            raise FileNotFoundError("no ICU jar beside Spark: name the jar or the .cfu file")
        source = jars[0]
    if source.endswith(".jar"):
        with zipfile.ZipFile(source) as jar:
            data = jar.read(next(n for n in jar.namelist() if n.endswith("/confusables.cfu")))
    else:
        data = Path(source).read_bytes()
    order = ">" if data[8] else "<"  # byte order, by ICU's common header
    body = data[struct.unpack(order + "H", data[:2])[0] :]
    # Offset and length of three arrays: keys (code point, units of the prototype less one), values, units of longer prototypes.
    keys_at, n_keys, values_at, n_values, units_at, n_units = struct.unpack(order + "6i", body[12:36])
    keys = struct.unpack(f"{order}{n_keys}I", body[keys_at : keys_at + 4 * n_keys])
    values = struct.unpack(f"{order}{n_values}H", body[values_at : values_at + 2 * n_values])
    units, coding = body[units_at : units_at + 2 * n_units], "utf-16-be" if order == ">" else "utf-16-le"
    out = {}
    for key, value in zip(keys, values, strict=True):
        n = (key >> 24) + 1
        out[key & 0xFFFFFF] = chr(value) if n == 1 else units[2 * value : 2 * (value + n)].decode(coding)
    return out


def _decomposed(text: str) -> str:
    return text if unicodedata.is_normalized("NFD", text) else unicodedata.normalize("NFD", text)


def _closed(steps: dict[int, str]) -> dict[int, str]:
    """The table that takes as many steps as there are for each character at once."""
    out = {}
    for c in steps:
        seen, text = set(), chr(c)
        while text not in seen:
            seen.add(text)
            text = _decomposed(_INVISIBLE.sub("", _decomposed(text).translate(steps)))
        out[c] = text
    return out


@lru_cache
def prototypes(source: str | None = None) -> dict[int, str]:
    """Prototype of every character that is not its own: the public table, widths, blanks and CLASSES."""
    apart = lambda c: (same := unicodedata.normalize("NFKC", chr(c))) in APART and same
    steps = {c: apart(c) or p for c, p in public_table(source).items() if chr(c) not in APART}  # ⼠, say, stays with 士
    for c in range(sys.maxunicode + 1):
        kind, _, of = unicodedata.decomposition(chr(c)).partition(" ")
        if kind in ("<wide>", "<narrow>"):
            steps[c] = "".join(chr(int(x, 16)) for x in of.split())
    blank = re.compile(f"[{BLANKS}]")
    steps |= {c: " " for c in range(0x3001) if blank.match(chr(c))}
    public = _closed(steps)
    for row in CLASSES.strip().splitlines():
        first, *others = (public.get(ord(c), c) for c in row.split())
        steps |= {ord(c): first for c in others if c != first and len(c) == 1}
    return _closed(steps)


def skeleton(text: str | None, table: dict[int, str] | None = None) -> str | None:
    """The form under which exactly the look-alike texts are equal; null for null, '' for ''."""
    if text is None:
        return None
    table = prototypes() if table is None else table
    if text.isascii():
        return text.translate(table)
    return _decomposed(_decomposed(_INVISIBLE.sub("", text)).translate(table))


def skeleton_column(text: Column | str, source: str | None = None) -> Column:
    """skeleton() over Arrow batches; the table, some 200 kB, goes with the function."""
    table = prototypes(source)

    @F.pandas_udf(T.StringType())
    def skeletons(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield part.map(lambda t: skeleton(t, table), na_action="ignore")

    return skeletons(F.col(text) if isinstance(text, str) else text)


def _digest(text: Column) -> Column:
    return F.unhex(F.md5(text))


def lookalike_forms(df: DataFrame, text: str, scope: str | None = None) -> DataFrame:
    """One row per distinct text: (scope, form, text, n_rows, n_forms).

    form is the consistent form (the skeleton), n_rows the rows with this text, n_forms the texts of the scope
    that read alike. Null texts are left out; '' is a text like any other; a null scope is a scope of its own.
    Only counts cross the network, after partial aggregation, so a text that fills a third of all rows does no harm.
    """
    rows = df.select((F.col(scope) if scope else F.lit(0)).alias("scope"), F.col(text).alias("text"))
    texts = rows.filter("text IS NOT NULL").groupBy("scope", "text").agg(F.count("*").alias("n_rows"))
    texts = materialize(texts.withColumn("form", skeleton_column("text")), "forms")
    sizes = texts.groupBy(F.col("scope").alias("s"), F.col("form").alias("f")).agg(F.count("*").alias("n_forms"))
    joined = texts.join(sizes, F.col("scope").eqNullSafe(F.col("s")) & (F.col("form") == F.col("f")))
    return joined.select("scope", "form", "text", "n_rows", "n_forms")


def lookalike_pairs(df: DataFrame, key: str, text: str, scope: str | None = None) -> DataFrame:
    """Pairs of different keys of one scope whose texts differ in code points yet read alike: (scope, key_a, key_b).

    key_a < key_b. Rows with null key or a null or empty text take no part; repeated rows count once. Rows carry
    two digests of 128 bits instead of their texts. Groups whose texts are all equal are left out, by partial
    aggregation, before any join; the join meets only groups that hold at least two forms, and within them
    only rows of different forms, so copies of one text are never paired. The members of a large group meet in many tasks.
    """
    rows = df.select(
        (F.col(scope) if scope else F.lit(0).cast("bigint")).alias("scope"), F.col(key).alias("key"), F.col(text).alias("text")
    )
    rows = rows.filter("key IS NOT NULL AND scope IS NOT NULL AND text <> ''")
    if key == text:
        rows = rows.distinct()
    rows = rows.select("scope", "key", _digest(F.col("text")).alias("exact"), _digest(skeleton_column("text")).alias("form"))
    rows = materialize(rows, "lookalikes")
    mixed = rows.groupBy("scope", "form").agg(F.min("exact").alias("lo"), F.max("exact").alias("hi")).filter("lo < hi")
    both = materialize(rows.join(mixed.select("scope", "form"), ["scope", "form"], "left_semi").distinct(), "mixed")
    release(df.sparkSession, rows)
    sizes = both.groupBy("scope", "form").agg(F.ceil(F.count("*") / MEET).alias("parts"))
    both = both.join(sizes, ["scope", "form"])
    part, parts = F.pmod(F.xxhash64("key"), "parts"), F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)
    a = both.select("scope", "form", part.alias("part"), F.col("key").alias("key_a"), F.col("exact").alias("exact_a"))
    b = both.select("scope", "form", F.explode(parts).alias("part"), F.col("key").alias("key_b"), F.col("exact").alias("exact_b"))
    pairs = a.join(b, ["scope", "form", "part"]).filter("key_a < key_b AND exact_a <> exact_b")
    return pairs.select("scope", "key_a", "key_b").distinct()
