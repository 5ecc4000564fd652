"""Difficulty of words, quality of examples, and progressive plans of both."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tanmono.operators.model import sentence_words, source_counts
from tanmono.plans.storage import materialize

#: Marks of sentence fragments, of colloquial speech, and filler words.
FRAGMENT_ANY = ["→", "…"]
FRAGMENT_START = ["＜", "《", "≪"]
FRAGMENT_MARKS = ["→", "…", "＜", "《", "≪", "≫"]
PLAN_FRAGMENT_MARKS = [*FRAGMENT_MARKS, "((", "))"]
COLLOQUIAL_MARKS = ["ねえ", "ぜ", "ぞ", "やが", "りゃ", "じゃん", "～"]
FILLERS = ["ん", "んな", "うん", "えっ", "あっ", "うっ"]
#: Weights of the components in each metric.
WEIGHTS = {
    "source": {"source": 0.80, "sentence": 0.10, "quality": 0.10, "noise": 0.20},
    "general": {"general": 1.0, "form": 0.05, "quality": 0.10, "noise": 0.20},
    "hybrid": {"general": 0.55, "source": 0.15, "sentence": 0.20, "form": 0.05, "quality": 0.05, "noise": 0.20},
}
#: How much harder than its target a context word may be.
TOLERANCE = 2.0


#: Parts of a difficulty point by which a large source's ranking is split; difficulties have three digits.
RANK_STEPS = 10


def scoped(sen: DataFrame, scopes: DataFrame) -> DataFrame:
    """sen with every sentence once for each scope that holds its source; source_id is then the scope.

    scopes(scope_id, source_id) may overlap. All operators of this module, given such sentences, count, choose examples, rank and
    plan for each set of sources as a whole.
    """
    rows = sen.join(scopes.select("scope_id", "source_id").distinct(), "source_id")
    return rows.drop("source_id").withColumnRenamed("scope_id", "source_id").select(sen.columns)


def contains_any(text: Column | str, marks: list[str]) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    out = F.lit(False)
    for mark in marks:
        out = out | F.contains(text, F.lit(mark))
    return out


def _unit(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def _missing(text: str) -> Column:
    return F.coalesce(F.col(text) == "", F.lit(True))


def zipf_prior(occ: DataFrame, lex: DataFrame) -> DataFrame:
    """(lemma, zipf): log10 of a lemma's occurrences per billion, over the whole corpus."""
    counts = occ.groupBy("lexeme_id").agg(F.sum("n").alias("n"))
    lemmas = lex.select(F.col("id").alias("lexeme_id"), "lemma").join(counts, "lexeme_id").groupBy("lemma").agg(F.sum("n").alias("n"))
    total = occ.agg(F.sum("n").alias("total")).first()["total"] or 1
    return lemmas.select("lemma", F.log10(F.col("n") * 1e9 / F.lit(float(total))).alias("zipf"))


def initial_examples(occ: DataFrame, sen: DataFrame, lex: DataFrame) -> DataFrame:
    """(source_id, lexeme_id, sentence_id, cue_index, n_words, n_unknown) : each source's best first example of a lexeme.

    Best: with a translation, no fragment, not colloquial, two to six words, few unknown other words, in dictionary form, near
    14 characters, early. The minimum of a struct needs no sort and leaves one row of a pair for each task.
    """
    words = sentence_words(occ, lex).select("sentence_id", "n_words", "n_unknown")
    fragment = contains_any("japanese", FRAGMENT_ANY)
    for mark in FRAGMENT_START:
        fragment = fragment | F.col("japanese").startswith(mark)
    lines = sen.select(
        F.col("id").alias("sentence_id"), "source_id", "cue_index", _missing("english").alias("k1"), fragment.alias("k2"),
        contains_any("japanese", COLLOQUIAL_MARKS).alias("k3"), F.abs(F.char_length("japanese") - 14).alias("k7"),
    ).join(words, "sentence_id")
    targets = lex.select(F.col("id").alias("lexeme_id"), "lemma", F.col("known_at").isNull().alias("unknown"))
    rows = occ.select("lexeme_id", "sentence_id", "surface").join(lines, "sentence_id").join(targets, "lexeme_id")
    others = F.col("n_unknown") - F.col("unknown").cast("int")
    key = F.struct(
        "k1", "k2", "k3", (~F.col("n_words").between(2, 6)).alias("k4"), others.alias("k5"), (F.col("surface") != F.col("lemma")).alias("k6"), "k7",
        "cue_index", "sentence_id", "n_words", "n_unknown",
    )
    best = rows.groupBy("source_id", "lexeme_id").agg(F.min(key).alias("b"))
    return best.select("source_id", "lexeme_id", "b.sentence_id", "b.cue_index", "b.n_words", "b.n_unknown")


def candidates(occ: DataFrame, sen: DataFrame, lex: DataFrame, prior: DataFrame | None = None) -> DataFrame:
    """Unknown lexemes of every source that may be taught, with their count, example and zipf value.

    prior(lemma, zipf) is a table of word frequencies, 0 for what it lacks; without one the corpus itself is counted.
    """
    wanted = lex.filter(
        "known_at IS NULL AND (dictionary_status IS NULL OR (dictionary_status = 'matched' AND gloss IS NOT NULL)) "
        "AND NOT (coalesce(part_of_speech, '') = '感動詞' AND char_length(lemma) <= 1)"
    ).select(F.col("id").alias("lexeme_id"), "lexeme_key", "lemma", "reading", "part_of_speech", "gloss")
    counts = source_counts(occ, sen, lex).select("source_id", "lexeme_id", "source_count")
    rows = counts.join(wanted, "lexeme_id").join(initial_examples(occ, sen, lex), ["source_id", "lexeme_id"])
    rows = rows.join(sen.select(F.col("id").alias("sentence_id"), "source_id", "japanese", "english"), ["source_id", "sentence_id"])
    return rows.join(zipf_prior(occ, lex) if prior is None else prior.select("lemma", "zipf"), "lemma", "left").withColumn("zipf", F.coalesce("zipf", F.lit(0.0)))


def components(rows: DataFrame) -> DataFrame:
    """rows with the difficulty components general, source, sentence, form, quality and noise, each of 0 to 1, to 6 digits."""
    words, unknown = F.greatest("n_words", F.lit(1)), F.greatest("n_unknown", F.lit(1))
    other, other_unknown = words - 1, unknown - 1
    ratio = F.when(other > 0, other_unknown / other).otherwise(0.0)
    chars = F.char_length(F.regexp_replace("lemma", r"[\s\x{3000}]", ""))
    kanji = F.regexp_count("lemma", F.lit(r"[\x{3400}-\x{9fff}]"))
    density = F.when(chars > 0, kanji / chars).otherwise(0.0)
    quality = 0.40 * _missing("english").cast("double") + 0.30 * contains_any("japanese", FRAGMENT_MARKS).cast("double")
    quality = quality + 0.20 * contains_any("japanese", COLLOQUIAL_MARKS).cast("double") + 0.10 * (words <= 1).cast("double")
    noisy = (F.coalesce("part_of_speech", F.lit("")) == "感動詞") | F.col("lemma").isin(FILLERS)
    noise = F.when(noisy, 1.0).when(F.col("lemma").rlike(r"^[\x{3040}-\x{30ff}ー]$"), 0.8).otherwise(0.0)
    parts = {
        "general": _unit((6.8 - F.col("zipf")) / 4.3),
        "source": _unit(1.0 / F.sqrt(F.greatest("source_count", F.lit(1)))),
        "sentence": 0.7 * ratio + 0.3 * _unit(F.greatest(words - 2, F.lit(0)) / 10),
        "form": 0.55 * _unit(F.greatest(chars - 1, F.lit(0)) / 5) + 0.45 * density,
        "quality": _unit(quality),
        "noise": noise,
    }
    return rows.withColumns({f"c_{name}": F.round(value, 6) for name, value in parts.items()})


def difficulty(metric: str) -> Column:
    """Score of 0 to 100, to 3 digits, half up, of rows with components."""
    if metric not in WEIGHTS:
        raise ValueError(f"unknown metric: {metric}")
    units = F.lit(0).cast("bigint")  # components have 6 digits and weights 2, so the sum is a whole number and ties are exact
    for name, weight in WEIGHTS[metric].items():
        units = units + F.round(F.col(f"c_{name}") * 1_000_000).cast("bigint") * round(weight * 100)
    units = F.greatest(F.least(units, F.lit(100_000_000)), F.lit(0))
    return F.floor((units + 500) / 1000) / 1000.0


def scored(rows: DataFrame, metrics: list[str]) -> DataFrame:
    """rows, with components() if these are lacking, for every metric with difficulty."""
    scores = F.array(*(F.struct(F.lit(m).alias("metric"), difficulty(m).alias("difficulty")) for m in metrics))
    rows = rows if "c_general" in rows.columns else components(rows)
    return rows.withColumn("m", F.explode(scores)).select("*", "m.metric", "m.difficulty").drop("m")


def with_ranks(rows: DataFrame, limit: int | None = None) -> DataFrame:
    """scored() rows, read twice, with their rank within source and metric, to that limit: easy first, then frequent, early, by key.

    Rows are numbered within steps of difficulty, above the number of rows of the easier steps. So a source that holds a third of
    all rows is sorted by many tasks, and steps beyond the limit are not sorted at all.
    """
    group, step = ["source_id", "metric"], F.floor(F.col("difficulty") * RANK_STEPS).alias("step")
    sizes = rows.select(*group, step).groupBy(*group, "step").agg(F.count("*").alias("n"))
    easier = F.coalesce(F.sum("n").over(Window.partitionBy(*group).orderBy("step").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(*group, "step", easier.alias("easier"))
    if limit is not None:
        sizes = sizes.filter(F.col("easier") < limit)
    placed = rows.withColumn("step", step).join(sizes, [*group, "step"])
    order = Window.partitionBy(*group, "step").orderBy("difficulty", F.col("source_count").desc(), "cue_index", "lexeme_key")
    placed = placed.withColumn("rank", (F.row_number().over(order) + F.col("easier")).cast("int")).drop("step", "easier")
    return placed if limit is None else placed.filter(F.col("rank") <= limit)


def ranked(rows: DataFrame, metrics: list[str], limit: int | None = None) -> DataFrame:
    """rows for every metric with difficulty and rank within the source."""
    return with_ranks(scored(materialize(components(rows), "components"), metrics), limit)


def example_parts(rows: DataFrame, occ: DataFrame, sen: DataFrame, lex: DataFrame, pool: DataFrame | None = None) -> DataFrame:
    """Examples (source_id, lexeme_id, sentence_id, surface) of a pool of scored rows, all if None, with what their scores are made of.

    fixed is the part of the score that depends neither on the position nor on the words known by then. others holds the
    unknown other words, each with gap: how far it is above the target's difficulty and the tolerance, 0 if it is not, null if unscored.
    """
    target = (rows if pool is None else pool).select("source_id", "lexeme_id", "lemma", "difficulty")
    unknown = lex.filter("known_at IS NULL").select(F.col("id").alias("lexeme_id"), F.lit(1).alias("unknown"))
    lines = sen.select(F.col("id").alias("sentence_id"), "source_id", "cue_index", "japanese", "english")
    places = occ.select("lexeme_id", "sentence_id", "surface").join(lines.select("sentence_id", "source_id"), "sentence_id")
    examples = places.join(target, ["source_id", "lexeme_id"])
    if pool is not None:
        examples = materialize(examples, "examples")
        wanted = examples.select("source_id", "sentence_id").distinct()
        places = places.join(wanted, ["source_id", "sentence_id"], "left_semi")
    # Size and context of a sentence come from one pass over its words.
    words = places.select("source_id", "sentence_id", "lexeme_id").distinct().join(unknown, "lexeme_id", "left")
    words = words.join(rows.select("source_id", "lexeme_id", F.col("difficulty").alias("other_difficulty")), ["source_id", "lexeme_id"], "left")
    other = F.when(F.col("unknown").isNotNull(), F.struct(F.col("lexeme_id").alias("other"), "other_difficulty"))
    context = words.groupBy("source_id", "sentence_id").agg(F.count("*").alias("n_words"), F.array_sort(F.collect_list(other)).alias("context"))
    examples = examples.join(context.join(lines, ["source_id", "sentence_id"]), ["source_id", "sentence_id"])
    gap = lambda x: F.greatest(x["other_difficulty"] - F.col("difficulty") - TOLERANCE, F.lit(0.0))
    others = F.transform(
        F.filter("context", lambda x: x["other"] != F.col("lexeme_id")),
        lambda x: F.struct(x["other"].alias("id"), F.when(x["other_difficulty"].isNotNull(), gap(x)).alias("gap")),
    )
    marks = F.char_length(F.regexp_replace("japanese", "[^。？！?!]", ""))
    english_words = F.size(F.filter(F.split(F.coalesce("english", F.lit("")), r"\s+"), lambda w: w != ""))
    mismatch = (F.col("lemma") == "いい") & F.startswith(F.expr("substr(japanese, instr(japanese, surface) + char_length(surface))"), F.lit("たい"))
    parts = [
        (25.0, _missing("english")), (15.0, contains_any("japanese", PLAN_FRAGMENT_MARKS)), (8.0, marks > 1),
        (3.0, F.col("n_words") <= 1), (0.75, F.col("surface") != F.col("lemma")), (50.0, mismatch),
    ]
    fixed = F.greatest(english_words - 30, F.lit(0)) * 0.15 + F.char_length("japanese") * 0.01
    for weight, held in parts:
        fixed = fixed + weight * F.coalesce(held, F.lit(False)).cast("double")
    return examples.select(
        "source_id", "lexeme_id", "sentence_id", "surface", "cue_index", "difficulty", "n_words", fixed.alias("fixed"),
        contains_any("japanese", COLLOQUIAL_MARKS).alias("colloquial"), others.alias("others"),
    )


def unreserved(parts: DataFrame, reserved: DataFrame) -> DataFrame:
    """Examples less those whose sentence is reserved(sentence_id, lexeme_id) by the cards of other lexemes only."""
    owned = reserved.filter("sentence_id IS NOT NULL").groupBy("sentence_id").agg(F.collect_set("lexeme_id").alias("owners"))
    rows = parts.join(owned, "sentence_id", "left").filter("owners IS NULL OR array_contains(owners, lexeme_id)")
    return rows.select(parts.columns)


def bounded_examples(parts: DataFrame, pool: DataFrame, limit: int) -> DataFrame:
    """parts less the examples of a lexeme that no plan of that limit can choose.

    Of a lexeme's examples at most limit - 1 are taken by other cards, so one with a cost no higher than the limit-th least
    highest cost is always free. Costs fall only by the words of the pool, which can become known. Examples that cost more even
    then are left out; the plan stays the same.
    """
    taught = pool.groupBy("source_id").agg(F.collect_set("lexeme_id").alias("taught"))  # at most max(100, 5 x limit)
    weight = lambda x: 10.0 + F.when(x["gap"].isNull() | (x["gap"] > 0), 8.0).otherwise(0.0) + F.coalesce(x["gap"], F.lit(0.0))
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + weight(x))
    desired = [desired_words(p) for p in range(min(limit, 100))] or [2]
    off = [F.abs(F.col("n_words") - d) * 1.25 for d in sorted(set(desired))]
    rows = parts.join(taught, "source_id")
    least = F.col("fixed") + total(F.filter("others", lambda x: ~F.array_contains("taught", x["id"]))) + (F.least(*off) if len(off) > 1 else off[0])
    most = F.col("fixed") + total("others") + (F.greatest(*off) if len(off) > 1 else off[0]) + F.when(F.col("colloquial"), 5.0).otherwise(0.0)
    word = ["source_id", "lexeme_id"]
    rows = rows.withColumns({"least": least, "most": most}).drop("taught")
    again = F.row_number().over(Window.partitionBy(*word, "sentence_id").orderBy("most", "surface")) > 1
    rows = rows.withColumn("again", again).withColumn("r", F.sum(F.when(F.col("again"), 0).otherwise(1)).over(Window.partitionBy(*word).orderBy("most", "sentence_id", "surface")))
    # Rows come in order of most, so the running maximum up to the limit-th sentence is that sentence's.
    safe = F.max(F.when(F.col("r") <= limit, F.col("most"))).over(Window.partitionBy(*word).orderBy("most", "sentence_id", "surface").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("safe", safe).filter((F.col("r") <= limit) | (F.col("least") <= F.col("safe") + 1e-6)).select(parts.columns)


def context_weight(position: int) -> float:
    return max(0.6, 3.0 - 0.12 * position)


def desired_words(position: int) -> int:
    return min(8, 2 + position // 5)


def opening_scores(parts: DataFrame) -> DataFrame:
    """Examples with example_score and joint_score at the first position, and how many unknown and harder words they hold."""
    harder = F.size(F.filter("others", lambda x: x["gap"].isNull() | (x["gap"] > 0)))
    gaps = F.aggregate("others", F.lit(0.0), lambda a, x: a + F.coalesce(x["gap"], F.lit(0.0)))
    score = F.col("fixed") + 10.0 * F.size("others") + 8.0 * harder + gaps + 1.25 * F.abs(F.col("n_words") - desired_words(0))
    score = score + F.when(F.col("colloquial"), 5.0).otherwise(0.0)
    rows = parts.withColumns({"example_score": score, "n_unknown_others": F.size("others"), "n_harder": harder})
    return rows.withColumn("joint_score", F.col("difficulty") + context_weight(0) * F.col("example_score")).drop("others", "fixed", "colloquial")


def plan_greedily(rows: list[dict], limit: int, window: int = 500) -> list[dict]:
    """The greedy plan over candidates in rank order, each with difficulty and examples; every sentence is used once.

    At each position the candidate with the least joint score is taken, then it counts as known. Only the first window candidates
    are compared, the others if none of these has an unused example left. All examples stand in flat arrays; a word that becomes
    known takes its cost off the examples that hold it.
    """
    examples = [(c, e) for c, row in enumerate(rows) for e in sorted(row["examples"], key=lambda e: (e["sentence_id"], e["surface"]))]
    if not examples:
        return []
    owner = np.array([c for c, _ in examples])
    words = np.array([e["n_words"] for _, e in examples])
    colloquial = np.array([bool(e["colloquial"]) for _, e in examples])
    cost = np.array([float(e["fixed"]) for _, e in examples])
    holds: dict[int, list[tuple[int, float]]] = {}
    places: dict[int, list[int]] = {}
    for n, (_, e) in enumerate(examples):
        places.setdefault(e["sentence_id"], []).append(n)
        for o in e["others"]:
            gap = o["gap"]
            weight = 10.0 + (8.0 if gap is None or gap > 0 else 0.0) + (gap or 0.0)
            cost[n] += weight
            holds.setdefault(o["id"], []).append((n, weight))
    difficulty = np.array([float(row["difficulty"]) for row in rows])
    first = np.searchsorted(owner, np.arange(len(rows) + 1))  # a candidate's examples lie together
    left = np.ones(len(rows), bool)
    free = np.ones(len(examples), bool)
    plan: list[dict] = []

    def best_in(part: np.ndarray, position: int) -> tuple[float, float, int, int] | None:
        """(joint, difficulty, candidate, example) of the best of some candidates."""
        part = part[first[part] < first[part + 1]]
        if not len(part):
            return None
        sizes = first[part + 1] - first[part]
        at = np.arange(sizes.sum()) + np.repeat(first[part] - (np.cumsum(sizes) - sizes), sizes)
        score = cost[at] + 1.25 * np.abs(words[at] - desired_words(position)) + colloquial[at] * max(0.0, 5.0 - 0.15 * position)
        score = np.where(free[at], np.round(score, 9), np.inf)
        best = np.minimum.reduceat(score, np.cumsum(sizes) - sizes)
        joint = np.round(difficulty[part] + context_weight(position) * best, 9)
        k = int(np.lexsort((part, difficulty[part], joint))[0])
        if not np.isfinite(joint[k]):
            return None
        begin = int(sizes[:k].sum())
        n = begin + int(np.argmin(score[begin : begin + sizes[k]]))
        return float(joint[k]), float(best[k]), int(part[k]), int(at[n])

    for position in range(min(limit, len(rows))):
        open_rows = np.flatnonzero(left)
        found = best_in(open_rows[:window], position) or best_in(open_rows[window:], position)
        if found is None:
            break
        joint, score, chosen, n = found
        taken = examples[n][1]
        left[chosen] = False
        free[places[taken["sentence_id"]]] = False
        for m, weight in holds.get(rows[chosen]["lexeme_id"], ()):
            cost[m] -= weight
        plan.append({
            "position": position + 1, "lexeme_id": rows[chosen]["lexeme_id"], "sentence_id": taken["sentence_id"], "surface": taken["surface"],
            "example_score": score, "joint_score": joint,
        })
    return plan


def pool_size(limit: int) -> int:
    """Candidates that a plan looks at."""
    return max(100, 5 * limit)


def planned(pool: DataFrame, parts: DataFrame, limit: int = 20, reserved: DataFrame | None = None) -> DataFrame:
    """One plan for every source, or scope, from its pool_size() first ranked rows of one metric and their example_parts().

    reserved(sentence_id, lexeme_id) are the sentences of existing cards, which only their own lexemes may use.
    """
    pool = pool.filter(F.col("rank") <= pool_size(limit)).select("source_id", "lexeme_id", "rank", "difficulty")
    parts = parts if reserved is None else unreserved(parts, reserved)
    examples = bounded_examples(parts, pool, limit).groupBy("source_id", "lexeme_id").agg(
        F.collect_list(F.struct("sentence_id", "surface", "n_words", "fixed", "colloquial", "others")).alias("examples")
    )
    pool = pool.join(examples, ["source_id", "lexeme_id"])

    def plans(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("rank")
        out = pd.DataFrame(plan_greedily(frame.to_dict("records"), limit), columns=["position", "lexeme_id", "sentence_id", "surface", "example_score", "joint_score"])
        out.insert(0, "source_id", frame["source_id"].iloc[0])
        return out

    schema = "source_id long, position int, lexeme_id long, sentence_id long, surface string, example_score double, joint_score double"
    return pool.groupBy("source_id").applyInPandas(plans, schema)


def known_alternatives(occ: DataFrame, sen: DataFrame, lex: DataFrame, used: DataFrame) -> DataFrame:
    """(source_id, lexeme_id, sentence_id, surface, rank): examples whose other words are all known, less those in used sentences.

    used has (sentence_id), whoever shows it. The surface must stand in the sentence, else there is nothing to mark. Sentences with a
    translation first, then short, then early ones.
    """
    unknown = lex.filter("known_at IS NULL").select(F.col("id").alias("lexeme_id"), F.lit(1).alias("is_unknown"))
    words = occ.select("sentence_id", "lexeme_id").distinct().join(unknown, "lexeme_id", "left")
    open_words = words.groupBy("sentence_id").agg(F.count("is_unknown").alias("n_unknown")).filter("n_unknown <= 1")
    rows = occ.select("lexeme_id", "sentence_id", "surface").join(unknown, "lexeme_id", "left").join(open_words, "sentence_id")
    rows = rows.filter(F.col("n_unknown") == F.coalesce("is_unknown", F.lit(0)))
    lines = sen.select(F.col("id").alias("sentence_id"), "source_id", "cue_index", _missing("english").alias("missing"), "japanese")
    rows = rows.join(lines, "sentence_id").filter(F.contains(F.col("japanese"), F.col("surface"))).join(used, "sentence_id", "left_anti")
    order = Window.partitionBy("source_id", "lexeme_id").orderBy("missing", F.char_length("japanese"), "cue_index", "sentence_id", "surface")
    return rows.select("source_id", "lexeme_id", "sentence_id", "surface", F.row_number().over(order).alias("rank"))
