"""Cards and plans as data: snapshots, actions against a card service, and a sequential quality gate."""

from __future__ import annotations

from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

VERDICTS = ["pass", "flag", "uncertain"]


def learned(state: DataFrame, pulled: DataFrame) -> DataFrame:
    """state(lexeme_id, card_id, reps) with the pulled(card_id, reps) counts and learned where they rose from zero; absent cards stay."""
    fresh = pulled.groupBy("card_id").agg(F.max("reps").alias("now"))
    rows = state.join(fresh, "card_id", "left").withColumn("now", F.coalesce("now", "reps"))
    return rows.select("lexeme_id", "card_id", F.col("now").alias("reps"), ((F.col("now") > 0) & (F.coalesce("reps", F.lit(0)) == 0)).alias("learned"))


def actions(plan: DataFrame, state: DataFrame) -> DataFrame:
    """(lexeme_id, sentence_id, action): 'move' for planned lexemes with a card without reviews, 'add' for those without a card."""
    rows = plan.select("lexeme_id", "sentence_id").join(state.select("lexeme_id", "card_id", "reps"), "lexeme_id", "left")
    action = F.when(F.col("card_id").isNull(), "add").when(F.coalesce("reps", F.lit(0)) == 0, "move")
    return rows.withColumn("action", action).filter("action IS NOT NULL").select("lexeme_id", "sentence_id", "action")


def valid_reviews(reviews: DataFrame, criteria: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reviews(card, code, verdict) of known criteria with a known verdict, and the others."""
    known = criteria.select("card", "code").distinct().withColumn("known", F.lit(True))
    rows = reviews.join(known, ["card", "code"], "left")
    fine = F.coalesce(F.col("known") & F.col("verdict").isin(VERDICTS), F.lit(False))
    return rows.filter(fine).drop("known"), rows.filter(~fine).drop("known")


def recorded(state: DataFrame, fresh: DataFrame) -> DataFrame:
    """state(lexeme_id, note_id, card_id, source_id, sentence_id, synced_at, reps) after fresh cards, without reps, were recorded.

    The latest record of a lexeme replaces all but the reviews seen so far, which only a pull may change.
    """
    latest = fresh.groupBy("lexeme_id").agg(F.max_by(F.struct(*(c for c in state.columns if c not in ("lexeme_id", "reps"))), "synced_at").alias("now"))
    rows = state.withColumn("old", F.lit(True)).join(latest, "lexeme_id", "full")
    values = [F.when(F.col("now").isNotNull(), F.col(f"now.{c}")).otherwise(F.col(c)).alias(c) if c not in ("lexeme_id", "reps") else c for c in state.columns]
    return rows.fillna(0, ["reps"]).select(*values)


def batch(name: str, plan: DataFrame, limit: int, sources: list[int], metric: str) -> DataFrame:
    """A plan as a named batch: its rows with name, sources, metric, limit, and complete, whether it has as many cards as asked."""
    facts = {"batch": F.lit(name), "sources": F.array(*map(F.lit, sorted(sources))).cast("array<bigint>"), "metric": F.lit(metric), "asked": F.lit(limit)}
    return plan.withColumns(facts).withColumn("complete", F.count("*").over(Window.partitionBy("batch")) == limit)


def recorded_reviews(stored: DataFrame, fresh: DataFrame, criteria: DataFrame) -> DataFrame:
    """Reviews(card, code, verdict, note, at) after the valid fresh ones were added; the latest of a card and criterion stays."""
    valid, _ = valid_reviews(fresh, criteria)
    both = stored.unionByName(valid.select(stored.columns))
    rest = [c for c in stored.columns if c not in ("card", "code")]
    return both.groupBy("card", "code").agg(F.max_by(F.struct(*rest), "at").alias("r")).select("card", "code", "r.*").select(stored.columns)


def checked_selection(selection: DataFrame, findings: DataFrame, limit: int) -> DataFrame:
    """A clean selection (plan, lexeme_id, ...) to be exported, after its cards were audited again.

    It is an error if a plan has fewer than limit cards, or if findings(plan, lexeme_id) still names one of them.
    """
    accepted = selection.filter("clean_position IS NOT NULL")
    short = accepted.groupBy("plan").agg(F.count("*").alias("n")).filter(F.col("n") < limit).orderBy("plan").limit(1).collect()
    if short or not accepted.limit(1).collect():
        raise ValueError(f"plan {short[0]['plan']} has {short[0]['n']} clean cards of {limit}" if short else "no clean cards")
    again = accepted.join(findings.select("plan", "lexeme_id").distinct(), ["plan", "lexeme_id"], "left_semi").count()
    if again:
        raise ValueError(f"{again} selected cards still have findings")
    return accepted


def snapshot(plan: DataFrame, path: str, replace: bool = False) -> None:
    """Keep a plan under a name; a name that exists is an error unless it is to be replaced."""
    plan.write.mode("overwrite" if replace else "errorifexists").parquet(path)


def first_alternatives(examples: DataFrame, limit: int) -> DataFrame:
    """Alternatives (source_id, lexeme_id, length, cue_index, sentence_id, needs) that a gate of that limit can come to.

    They are tried short and early ones first. One without needs suits unless it is shown or the card's own, so none is tried
    after the first limit + 1 of these.
    """
    order = Window.partitionBy("source_id", "lexeme_id").orderBy("length", "cue_index", "sentence_id").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.when(F.size("needs") == 0, 1).otherwise(0)).over(order), F.lit(0))
    return examples.withColumn("before", before).filter(F.col("before") <= limit).drop("before")


@dataclass
class Course:
    """What a learner has met after some cards: words taught, words refused with their difficulty, sentences shown."""

    taught: set[int] = field(default_factory=set)
    refused: dict[int, float] = field(default_factory=dict)
    shown: set[int] = field(default_factory=set)

    def unknown_again(self, card: dict) -> list[int]:
        """Words of the card's sentence that the plan took for known but that were refused."""
        return sorted(self.refused.keys() & set(card["words"]))

    def faults(self, card: dict, tolerance: float) -> list[str]:
        """Reasons against a card: its findings, and refused words in it that are too hard for it."""
        ceiling = card["difficulty"] + tolerance
        hard = any(self.refused[w] > ceiling for w in self.unknown_again(card))
        return sorted({*card["findings"], *(["rejected_word_became_harder_context"] if hard else [])})

    def suits(self, card: dict, other: dict) -> bool:
        """Whether an alternative can stand for the card: another sentence, not shown, without findings, all else in it known."""
        fresh = other["sentence_id"] != card["sentence_id"] and other["sentence_id"] not in self.shown
        return fresh and not len(other["findings"]) and self.taught.issuperset(other["needs"])


def gate(cards: list[dict], limit: int, tolerance: float = 2.0) -> tuple[list[dict], list[dict]]:
    """Accepted and rejected cards, in order, until limit are accepted.

    A card without faults stays as it is. One with faults stays with its first alternative that suits; needs are the words of an
    alternative, besides the card's, that were not known before the plan. Any other is rejected, and its word counts as refused.
    """
    course, accepted, rejected = Course(), [], []
    for card in cards:
        if len(accepted) == limit:
            break
        faults, again = course.faults(card, tolerance), course.unknown_again(card)
        other = next((a for a in card["alternatives"] if course.suits(card, a)), None) if faults else None
        if faults and other is None:
            course.refused[card["lexeme_id"]] = card["difficulty"]
            rejected.append(card | {"reasons": faults})
            continue
        replaced = {"sentence_id": other["sentence_id"], "replaced": card["sentence_id"]} if other else {}
        accepted.append(card | replaced | {"clean_position": len(accepted) + 1, "unknown_again": [] if other else again})
        course.taught.add(card["lexeme_id"])
        course.shown.add(accepted[-1]["sentence_id"])
    return accepted, rejected


def select_clean(cards: DataFrame, limit: int, tolerance: float = 2.0) -> DataFrame:
    """(plan, lexeme_id, sentence_id, clean_position, replaced, reasons) by gate() for every plan.

    cards(plan, position, lexeme_id, sentence_id, difficulty, findings array, words array, alternatives array of (sentence_id, needs,
    findings)); a plan is a bounded batch, so a group is small. Rejected cards have no clean_position but reasons.
    """
    columns = {"lexeme_id": "Int64", "sentence_id": "Int64", "clean_position": "Int64", "replaced": "Int64", "reasons": "object"}

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        accepted, rejected = gate(frame.sort_values("position").to_dict("records"), limit, tolerance)
        rows = [{c: card.get(c) for c in columns} for card in (*accepted, *rejected)]
        for row in rows:
            row["reasons"] = ",".join(row["reasons"] or ())
        out = pd.DataFrame(rows, columns=list(columns)).astype(columns)
        out.insert(0, "plan", frame["plan"].iloc[0])
        return out

    return cards.groupBy("plan").applyInPandas(run, "plan long, lexeme_id long, sentence_id long, clean_position int, replaced long, reasons string")
