"""Quality criteria of cards, in long form, their summaries, and their agreement with reviewers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Thresholds below which a criterion is flagged.
ALIGNMENT, ALIGNMENT_HIGH, GLOSS, MARGIN, OPACITY = 0.78, 0.72, 0.70, 0.06, 0.20
#: Parts of speech whose reading is checked in context.
READING_POS = ["名詞", "代名詞", "副詞", "連体詞", "感動詞", "表現"]
#: Finding codes of the criteria, fixed values, with what a reader is told.
FINDINGS = {
    "translation_available": ("missing_translation", "There is no English translation."),
    "translation_alignment": ("weak_subtitle_alignment", "The translation may belong to another line."),
    "definition_available": ("missing_definition", "There is no dictionary definition."),
    "gloss_support": ("weak_gloss_support", "The sentence hardly supports this definition."),
    "context_difficulty": ("harder_unknown_context", "The sentence has unknown words that are harder than the target."),
    "contextual_reading": ("reading_disagreement", "Analyzers read this occurrence in another way."),
    "expression_interpretation": ("ambiguous_expression", "It is uncertain whether words here form an expression."),
    "unique_example": ("repeated_example", "Another card shows the same sentence."),
}
BORDERLINE = ("borderline_expression", "An expression was accepted by a narrow margin.")
#: How far above its threshold a score still counts as near.
NEAR = 0.03


def _item(code: str, status: Column, severity: Column, score: Column | None = None, threshold: float | None = None) -> Column:
    value = F.round(score, 3) if score is not None else F.lit(None).cast("double")
    limit = F.lit(threshold).cast("double")
    checked = (status != "not_checked") & value.isNotNull()
    return F.struct(
        F.lit(code).alias("code"), status.alias("status"), F.when(status == "flagged", severity).alias("severity"),
        F.when(checked, value).alias("score"), F.when(checked, limit).alias("threshold"),
    )


def _status(flagged: Column, checked: Column | None = None) -> Column:
    out = F.when(F.coalesce(flagged, F.lit(False)), "flagged").otherwise("passed")
    return out if checked is None else F.when(F.coalesce(checked, F.lit(False)), out).otherwise("not_checked")


def criteria(cards: DataFrame, *keep: str) -> DataFrame:
    """Eight rows (card, *keep, code, status, severity, score, threshold) for every card.

    cards(card, english, gloss, pos, sentence_id, alignment, support, n_harder, reading_status, reading_decisive, expression, margin, opacity):
    alignment and support are similarities, expression is the decision of the worst overlapping analysis, null if there is none.
    An example sentence that two cards share is flagged. Cards may hold translated, defined and uses (of the sentence) in place of english and gloss.
    """
    said = lambda name, text: F.col(name) if name in cards.columns else F.coalesce(F.trim(text), F.lit("")) != ""
    translated, defined = said("translated", "english"), said("defined", "gloss")
    unsure = F.col("expression").isin("ambiguous", "insufficient_evidence")
    weak_margin = F.col("margin") < MARGIN
    borderline = (F.col("expression") == "expression") & (weak_margin | (F.col("opacity") < OPACITY))
    flagged_score = F.when(unsure | (borderline & weak_margin), F.col("margin")).when(borderline, F.col("opacity"))
    flagged_limit = F.when(unsure | (borderline & weak_margin), F.lit(MARGIN)).when(borderline, F.lit(OPACITY))
    medium, high = F.lit("medium"), F.lit("high")
    reading = F.when(~F.coalesce(F.col("pos").isin(READING_POS), F.lit(False)), "not_checked").when(F.col("reading_status") == "disagreement", "flagged")
    reading = reading.when(F.col("reading_status") == "agreement", "passed").otherwise("not_checked")
    expression = _item("expression_interpretation", _status(unsure | borderline), medium)
    expression = F.struct(
        expression["code"].alias("code"), expression["status"].alias("status"), expression["severity"].alias("severity"),
        F.round(flagged_score, 3).alias("score"), flagged_limit.cast("double").alias("threshold"),
    )
    uses = F.col("uses") if "uses" in cards.columns else F.count("*").over(Window.partitionBy("sentence_id"))
    items = F.array(
        _item("translation_available", _status(~translated), high),
        _item("translation_alignment", _status(F.col("alignment") < ALIGNMENT, translated), F.when(F.col("alignment") < ALIGNMENT_HIGH, "high").otherwise("medium"), F.col("alignment"), ALIGNMENT),
        _item("definition_available", _status(~defined), high),
        _item("gloss_support", _status(F.col("support") < GLOSS, translated & defined), medium, F.col("support"), GLOSS),
        _item("context_difficulty", _status(F.col("n_harder") > 0), high),
        _item("contextual_reading", reading, F.when(F.col("reading_decisive"), "high").otherwise("medium")),
        expression,
        _item("unique_example", _status(F.col("uses") > 1), medium),
    )
    return cards.withColumn("uses", uses).select("card", *keep, F.explode(items).alias("i")).select("card", *keep, "i.*")


def review_priority(rows: DataFrame) -> DataFrame:
    """criteria() rows with distance (score less threshold) and priority for a reviewer."""
    distance = F.round(F.col("score") - F.col("threshold"), 3)
    level = F.when(F.col("status") == "flagged", "flagged").when(distance <= NEAR, "near_threshold").when(F.col("status") == "not_checked", "not_applicable")
    return rows.withColumns({"distance": distance, "priority": level.otherwise("pass_control")})


def summary(rows: DataFrame) -> DataFrame:
    """(code, passed, flagged, not_checked, high, medium): how many cards each criterion passed, flagged or left out."""
    counts = [F.count_if(F.col("status") == s).alias(s) for s in ("passed", "flagged", "not_checked")]
    counts += [F.count_if(F.col("severity") == s).alias(s) for s in ("high", "medium")]
    return rows.groupBy("code").agg(*counts)


def clean_cards(rows: DataFrame) -> DataFrame:
    """(card): cards without any flagged criterion."""
    return rows.groupBy("card").agg(F.max(F.col("status") == "flagged").alias("flagged")).filter("NOT flagged").select("card")


def agreement(rows: DataFrame, reviews: DataFrame | None = None) -> DataFrame:
    """(code, reviewed, agreements, missed, false_alarms, uncertain) from criteria() rows and reviews(card, code, verdict), or from rows with a verdict."""
    met = rows.withColumn("automatic", F.when(F.col("status") == "flagged", "flag").when(F.col("status") == "passed", "pass"))
    met = met if reviews is None else met.select("card", "code", "automatic").join(reviews, ["card", "code"])
    same, unsure = F.coalesce(F.col("automatic") == F.col("verdict"), F.lit(False)), F.col("verdict") == "uncertain"
    return met.groupBy("code").agg(
        F.count("*").alias("reviewed"), F.count_if(same).alias("agreements"),
        F.count_if((F.col("automatic") == "pass") & (F.col("verdict") == "flag")).alias("missed"),
        F.count_if((F.col("automatic") == "flag") & (F.col("verdict") == "pass")).alias("false_alarms"), F.count_if(~same & unsure).alias("uncertain"),
    )


def overlapping(cards: DataFrame, analyses: DataFrame) -> DataFrame:
    """Cards(card, sentence_id, start, end) with the analyses(sentence_id, a_start, a_end, ...) of their sentence that overlap the target span.

    A card without span meets all analyses of its sentence; an equi-join on the sentence with the range as residual.
    """
    return cards.join(analyses, "sentence_id").filter(overlaps(F.col("a_start"), F.col("a_end")))


def overlaps(a_start: Column, a_end: Column) -> Column:
    """Whether an analysis overlaps the span of columns start and end; whatever is null overlaps all."""
    return F.col("start").isNull() | F.col("end").isNull() | ((a_start < F.col("end")) & (a_end > F.col("start")))


def _need(decision: Column, margin: Column, opacity: Column) -> Column:
    """What puts analyses in order: undecided ones first, then accepted ones near their limits, each by the smallest margin."""
    unsure = decision.isin("ambiguous", "insufficient_evidence")
    near = (decision == "expression") & ((margin < MARGIN) | (opacity < OPACITY))
    return F.struct(F.when(unsure, 0).when(near, 1).otherwise(2).alias("level"), margin.alias("margin"), opacity.alias("opacity"), decision.alias("decision"))


def worst_analyses(met: DataFrame) -> DataFrame:
    """(card, expression, margin, opacity) of the analysis of each card in overlapping() rows that most needs a look.

    Undecided ones come first, then accepted ones near their limits, each by the smallest margin.
    """
    best = F.min(_need(F.col("decision"), F.col("margin"), F.col("opacity"))).alias("w")
    return met.groupBy("card").agg(best).select("card", F.col("w.decision").alias("expression"), "w.margin", "w.opacity")


def worst_of(found: str) -> Column:
    """worst_analyses() within a row: of the column's array of (start, end, decision, margin, opacity), those that overlap the span start to end."""
    met = F.filter(found, lambda a: overlaps(a["start"], a["end"]))
    return F.array_min(F.transform(met, lambda a: _need(a["decision"], a["margin"], a["opacity"])))


def findings(rows: DataFrame, cards: DataFrame | None = None) -> DataFrame:
    """(card, finding, severity, explanation, score, threshold) of every flagged one of criteria() rows; these or the cards have the expression."""
    named = F.create_map(*(F.lit(x) for code, (f, _) in FINDINGS.items() for x in (code, f)))
    told = F.create_map(*(F.lit(x) for code, (_, t) in FINDINGS.items() for x in (code, t)))
    met = rows.filter("status = 'flagged'")
    met = met if cards is None else met.join(cards.select("card", "expression"), "card")
    narrow = (F.col("code") == "expression_interpretation") & F.coalesce(F.col("expression") == "expression", F.lit(False))
    pick = lambda names, other: F.when(narrow, other).otherwise(F.element_at(names, F.col("code")))
    return met.select("card", pick(named, BORDERLINE[0]).alias("finding"), "severity", pick(told, BORDERLINE[1]).alias("explanation"), "score", "threshold")


def totals(cards: DataFrame, found: DataFrame, excluded: DataFrame) -> DataFrame:
    """(name, n): cards, cards with findings, excluded lexemes, and findings by code and by severity."""
    count = lambda name, df: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
    by = lambda kind, column: found.groupBy(F.concat(F.lit(f"{kind}:"), F.col(column)).alias("name")).agg(F.count("*").alias("n"))
    parts = [count("cards_with_findings", found.select("card").distinct()), count("excluded", excluded), by("code", "finding"), by("severity", "severity")]
    out = count("cards", cards)
    for part in parts:
        out = out.unionByName(part)
    return out


def review_sheet(cards: DataFrame, rows: DataFrame, reviews: DataFrame | None = None) -> DataFrame:
    """One row a card and criterion, in the 21 columns that reviewers get, by position.

    cards(card, position, lexeme_key, lemma, reading, gloss, part_of_speech, series, season, episode, sentence_id, japanese, english,
    difficulty_score); verdicts and notes of reviews(card, code, verdict, note) are filled in.
    """
    about = ["position", "lexeme_key", "lemma", "reading", "gloss", "part_of_speech", "series", "season", "episode", "sentence_id", "japanese", "english", "difficulty_score"]
    met = review_priority(rows).join(cards.select("card", *about), "card")
    if reviews is not None:
        met = met.join(reviews.select("card", "code", F.col("verdict").alias("review_verdict"), F.col("note").alias("review_note")), ["card", "code"], "left")
    blank = {c: F.coalesce(F.col(c) if c in met.columns else F.lit(None).cast("string"), F.lit("")) for c in ("gloss", "part_of_speech", "english", "review_verdict", "review_note")}
    names = {"code": "criterion", "status": "automatic_status", "distance": "threshold_distance", "priority": "review_priority"}
    met = met.withColumns(blank).withColumnsRenamed(names)
    order = ["criterion", "automatic_status", "score", "threshold", "threshold_distance", "review_priority", "review_verdict", "review_note"]
    return met.select(*about, *order).orderBy("position", "criterion")
