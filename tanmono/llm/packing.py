"""Problem 6: documents into containers of fixed capacity, by a grouping genetic algorithm on islands.

Items are dealt into blocks of bounded size. For each block several islands keep a population of packings. A crossover
injects whole well-filled containers of one parent into the other, removes the containers that hold an item twice, trades
displaced items for smaller ones where that fills a container better, and puts the rest back by best fit. After every epoch an island's best packing migrates to the next island. At the end
the worst filled containers of all blocks are dealt and packed once more, so that blocks leave no remainders.
"""

from __future__ import annotations

import random
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tanmono.plans.storage import materialize, release

#: Items of a block; islands of a block; packings of an island; children of an island and epoch; epochs.
BLOCK, ISLANDS, POPULATION, CHILDREN, EPOCHS = 2_000, 2, 4, 24, 3
#: Share of a block's containers, the worst filled, that is packed again across blocks.
AGAIN = 0.1

#: Container sizes that one call takes.
WINDOWS = 1_000

Packing = list[list[int]]


def best_fit(sizes: list[int], capacity: int, packing: Packing, items: list[int]) -> Packing:
    """Put each item, in the given order, into the container that it leaves with the least space; open one if none holds it."""
    free = sorted((capacity - sum(sizes[i] for i in group), g) for g, group in enumerate(packing))
    least = min((sizes[i] for i in items), default=0)
    del free[: bisect_left(free, (least, -1))]
    for i in items:
        at = bisect_left(free, (sizes[i], -1))
        if at < len(free):
            space, g = free.pop(at)
        else:
            space, g = capacity, len(packing)
            packing.append([])
        packing[g].append(i)
        if space - sizes[i] >= least:
            insort(free, (space - sizes[i], g))
    return packing


def refilled(sizes: list[int], capacity: int, packing: Packing, loose: list[int]) -> list[int]:
    """Trade, in each container, one or two items for the loose one that fills it best; returns what is loose then.

    Space moves from the containers to the loose items, which become smaller and easier to place.
    """
    pool = sorted((sizes[i], i) for i in loose)
    for group in packing:
        space = capacity - sum(sizes[i] for i in group)
        if not space or not pool:
            continue
        best = (0, (), 0)
        for out in [(i,) for i in group] + [(i, j) for n, i in enumerate(group) for j in group[n + 1 :]]:
            held = sum(sizes[i] for i in out)
            at = bisect_right(pool, (held + space, len(sizes))) - 1
            if at >= 0 and pool[at][0] - held > best[0]:
                best = (pool[at][0] - held, out, at)
        if best[0]:
            group.append(pool.pop(best[2])[1])
            for i in best[1]:
                group.remove(i)
                insort(pool, (sizes[i], i))
    return [i for _, i in pool]


def fitness(sizes: list[int], capacity: int, packing: Packing) -> tuple[int, float]:
    """Fewer containers first; then those filled unevenly, as a container nearly empty is nearly saved."""
    return -len(packing), sum((sum(sizes[i] for i in group) / capacity) ** 2 for group in packing)


def crossover(sizes: list[int], a: Packing, b: Packing, rng: random.Random) -> tuple[Packing, list[int]]:
    """a with whole containers of b, and the items displaced by them."""
    ranked = sorted(b, key=lambda g: -sum(sizes[i] for i in g))
    good = ranked[: max(1, len(ranked) // 2)]
    some = rng.sample(good, min(len(good), max(1, len(b) * len(b) // (4 * len(sizes)))))
    inside = {i for group in some for i in group}
    kept = [list(group) for group in a if inside.isdisjoint(group)]
    displaced = [i for group in a if not inside.isdisjoint(group) for i in group if i not in inside]
    return kept + [list(g) for g in some], displaced


def mutated(sizes: list[int], packing: Packing, rng: random.Random) -> tuple[Packing, list[int]]:
    """packing without its emptiest containers and a few others, and their items."""
    ranked = sorted(packing, key=lambda g: sum(sizes[i] for i in g))
    few = max(1, len(ranked) // 30)
    rest = ranked[few:]
    rng.shuffle(rest)
    return rest[2 * few :], [i for g in ranked[:few] + rest[: 2 * few] for i in g]


def child(sizes: list[int], capacity: int, a: Packing, b: Packing, rng: random.Random) -> Packing:
    """A packing out of two others."""
    packing, displaced = crossover(sizes, a, b, rng)
    packing, more = mutated(sizes, packing, rng)
    loose = displaced + more
    for _ in range(2):
        loose = refilled(sizes, capacity, packing, loose)
    return best_fit(sizes, capacity, packing, sorted(loose, key=lambda i: (-sizes[i], i)))


def evolved(sizes: list[int], capacity: int, population: list[Packing], children: int, rng: random.Random) -> list[Packing]:
    """The population after that many children, best first. Ends early at a packing that cannot be beaten."""
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    bound = -(-sum(sizes) // capacity)
    while len(population) < POPULATION:
        noise = 0.0 if not population else 0.02 * 4 ** len(population)
        population.append(best_fit(sizes, capacity, [], sorted(order, key=lambda i: -sizes[i] * rng.uniform(1 - noise, 1 + noise)) if noise else order))
    ranked = sorted(((fitness(sizes, capacity, p), p) for p in population), key=lambda x: x[0], reverse=True)
    for _ in range(children):
        if len(ranked[0][1]) <= bound:
            break
        (_, a), (_, b) = rng.sample(ranked, 2)
        new = child(sizes, capacity, a, b, rng)
        ranked.append((fitness(sizes, capacity, new), new))
        ranked = sorted(ranked, key=lambda x: x[0], reverse=True)[:POPULATION]
    return [p for _, p in ranked]


_STATE = "window long, capacity long, block long, island int, ids array<long>, sizes array<long>, packings array<array<int>>, containers long, fit double"
_SCHEMA = pa.schema([
    ("window", pa.int64()), ("capacity", pa.int64()), ("block", pa.int64()), ("island", pa.int32()), ("ids", pa.list_(pa.int64())),
    ("sizes", pa.list_(pa.int64())), ("packings", pa.list_(pa.list_(pa.int32()))), ("containers", pa.int64()), ("fit", pa.float64()),
])


def _decoded(groups: list[int]) -> Packing:
    packing: Packing = [[] for _ in range(max(groups, default=-1) + 1)]
    for i, g in enumerate(groups):
        packing[g].append(i)
    return packing


def _encoded(packing: Packing, n: int) -> list[int]:
    groups = [0] * n
    for g, group in enumerate(packing):
        for i in group:
            groups[i] = g
    return groups


def _epoch(number: int, children: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                rng = random.Random(f"{row['window']} {row['block']} {row['island']} {number}")
                sizes, packings = row["sizes"], [_decoded(p) for p in row["packings"] or ()]
                packings = evolved(sizes, row["capacity"], packings, children, rng)
                containers, fit = fitness(sizes, row["capacity"], packings[0])
                row |= {"packings": [_encoded(p, len(sizes)) for p in packings], "containers": -containers, "fit": fit}
                yield pa.RecordBatch.from_pylist([row], schema=_SCHEMA)

    return run


def _packed(items: DataFrame, search: bool) -> DataFrame:
    """(window, capacity, block, group, id, size): the best packing of every block of items(window, capacity, id, size)."""
    n = items.groupBy("window").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    block = F.pmod(F.xxhash64("id", "window"), F.lit(-(-n // BLOCK) or 1)).alias("block")
    dealt = items.select("window", "capacity", block, F.struct(F.col("size"), F.col("id")).alias("item"))
    blocks = dealt.groupBy("window", "capacity", "block").agg(F.sort_array(F.collect_list("item"), asc=False).alias("items"))
    state = blocks.select(
        "window", "capacity", "block", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"),
        F.col("items.id").alias("ids"), F.col("items.size").alias("sizes"), F.lit(None).cast("array<array<int>>").alias("packings"),
        F.lit(0).cast("bigint").alias("containers"), F.lit(0.0).alias("fit"),
    )
    keys, kept = ["window", "block", "island"], None
    for epoch in range(EPOCHS if search else 1):
        if epoch:
            elite = state.select("window", "block", ((F.col("island") + 1) % ISLANDS).cast("int").alias("island"), F.slice("packings", 1, 1).alias("elite"))
            state = state.join(elite, keys)
            moved = F.concat(F.slice("packings", 1, POPULATION - 1), "elite")
            state = state.select("window", "capacity", "block", "island", "ids", "sizes", moved.alias("packings"), "containers", "fit")
        tasks = max(1, state.sparkSession.sparkContext.defaultParallelism * 4)
        before, state = kept, materialize(state.repartition(tasks, *keys).mapInArrow(_epoch(epoch, CHILDREN if search else 0), _STATE), "islands")
        release(items.sparkSession, *([before] if before is not None else []))
        kept = state
    best = Window.partitionBy("window", "block").orderBy("containers", F.col("fit").desc(), "island")
    state = state.withColumn("r", F.row_number().over(best)).filter("r = 1")
    rows = state.select("window", "capacity", "block", F.explode(F.arrays_zip("ids", "sizes", F.col("packings")[0].alias("groups"))).alias("x"))
    return rows.select("window", "capacity", "block", F.col("x.groups").alias("group"), F.col("x.ids").alias("id"), F.col("x.sizes").alias("size"))


def packed_documents(docs: DataFrame, key: str, size: str, windows: DataFrame, window: str, capacity: str, search: bool = True) -> DataFrame:
    """(window, capacity, container, id, piece, n_pieces, tokens): every item in one container of every window.

    An item larger than the capacity is split into full containers and one rest, which is packed like an item. Items with
    null id are left out, an id given more than once counts once with its largest size, and sizes that are null or
    below 1 count as 1. Windows with null id or capacity below 1 hold nothing; more than WINDOWS of them are an error.
    Without search, the packings that the search starts from are the result.
    """
    items = docs.select(F.col(key).cast("bigint").alias("id"), F.greatest(F.coalesce(F.col(size), F.lit(1)), F.lit(1)).cast("bigint").alias("n"))
    items = items.filter("id IS NOT NULL").groupBy("id").agg(F.max("n").alias("n"))
    frames = windows.select(F.col(window).cast("bigint").alias("window"), F.col(capacity).cast("bigint").alias("capacity"))
    frames = frames.filter("window IS NOT NULL AND capacity >= 1").groupBy("window").agg(F.max("capacity").alias("capacity"))
    rows = frames.limit(WINDOWS + 1).collect()
    if len(rows) > WINDOWS:
        raise ValueError(f"more than {WINDOWS} container sizes")
    pairs = F.array(*(F.struct(F.lit(w.window).cast("bigint").alias("window"), F.lit(w.capacity).cast("bigint").alias("capacity")) for w in rows))
    pieces = items.withColumn("w", F.explode(pairs.cast("array<struct<window:bigint,capacity:bigint>>"))).select("w.window", "w.capacity", "id", "n")
    pieces = materialize(pieces.withColumns({"full": F.expr("CASE WHEN n > capacity THEN n div capacity ELSE 0L END")}), "items")
    rest = F.col("n") - F.col("full") * F.col("capacity")
    loose = pieces.withColumn("size", rest).filter("size > 0").select("window", "capacity", "id", "size")
    first = materialize(_packed(loose, search), "packed")
    fill = first.groupBy("window", "block", "group").agg(F.sum("size").alias("fill"))
    worst = F.percent_rank().over(Window.partitionBy("window", "block").orderBy("fill", "group"))
    again = materialize(fill.withColumn("rank", worst).filter(F.col("rank") <= AGAIN).select("window", "block", "group"), "again")
    kept = first.join(again, ["window", "block", "group"], "left_anti")
    second = _packed(first.join(again, ["window", "block", "group"], "left_semi").select("window", "capacity", "id", "size"), search)
    whole = [p.withColumn("round", F.lit(r)) for r, p in ((1, kept), (2, second))]
    name = F.concat_ws("-", "round", "block", "group")
    placed = whole[0].unionByName(whole[1]).select("window", "id", name.alias("container"), F.col("size").alias("tokens"))
    placed = pieces.join(placed, ["window", "id"]).select("window", "capacity", "container", "id", F.col("full").alias("piece"), "n", "full", "tokens")
    full = pieces.filter("full > 0").withColumn("piece", F.explode(F.expr("sequence(0L, full - 1)")))
    full = full.withColumn("container", F.concat_ws("-", F.lit(0), "id", "piece")).withColumn("tokens", F.col("capacity"))
    n_pieces = (F.col("full") + F.when(rest > 0, 1).otherwise(0)).alias("n_pieces")
    both = placed.unionByName(full.select(placed.columns))
    return both.select("window", "capacity", "container", "id", "piece", n_pieces, "tokens")


def packing_report(packing: DataFrame, before: DataFrame) -> DataFrame:
    """(window, capacity, items, tokens, least, before, containers, share) of a packing and of the one its search began with.

    least is the lower bound of the containers, the tokens by the capacity; share is the part of the containers that is used.
    """
    sums = packing.groupBy("window", "capacity").agg(
        F.count_distinct("id").alias("items"), F.sum("tokens").alias("tokens"), F.count_distinct("container").alias("containers")
    )
    sums = sums.join(before.groupBy("window").agg(F.count_distinct("container").alias("before")), "window")
    share = F.col("tokens") / (F.col("containers") * F.col("capacity"))
    return sums.select("window", "capacity", "items", "tokens", F.ceil(F.col("tokens") / F.col("capacity")).alias("least"), "before", "containers", share.alias("share"))
