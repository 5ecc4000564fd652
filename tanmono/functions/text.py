"""Scalar column functions on subtitle text, readings and card text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Every character that counts as a blank.
BLANKS = r"[\t\n\x{0b}\f\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Labels of the parts of speech that learners see.
POS_LABELS = {
    "名詞": "Noun",
    "代名詞": "Pronoun",
    "動詞": "Verb",
    "形容詞": "い-Adjective",
    "形状詞": "な-Adjective",
    "副詞": "Adverb",
    "連体詞": "Prenominal",
    "感動詞": "Interjection",
    "表現": "Expression",
}
#: English words that say nothing about a sense.
STOPWORDS = """the a an to of and or be is are was were it this that you your i my he she they we""".split()

_KATAKANA = "".join(map(chr, range(0x30A1, 0x30F7)))
_HIRAGANA = "".join(chr(ord(c) - 0x60) for c in _KATAKANA)


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(text: Column | str) -> Column:
    """Without blanks at both ends."""
    return F.regexp_replace(_col(text), f"^{BLANKS}+|{BLANKS}+$", "")


def squeeze(text: Column | str) -> Column:
    """Every run of blanks as one space, none at the ends."""
    return F.trim(F.regexp_replace(_col(text), f"{BLANKS}+", " "))


def clean_text(text: Column | str) -> Column:
    """A subtitle's words: no markup, override codes, line breaks, double parentheses or leading speaker labels."""
    bare = F.regexp_replace(F.regexp_replace(_col(text), "<[^>]+>", ""), r"\{\\[^}]+\}", "")
    flat = squeeze(F.replace(bare, F.lit("\\N"), F.lit(" ")))
    flat = F.replace(F.replace(flat, F.lit("((")), F.lit("))"))
    return F.trim(F.regexp_replace(flat, rf"^(?:[（(][^）)]{{1,24}}[）)]{BLANKS}*)+", ""))


def millis(hours: Column, minutes: Column, seconds: Column, ms: Column) -> Column:
    h, m, s, f = (x.cast("bigint") for x in (hours, minutes, seconds, ms))
    return ((h * 60 + m) * 60 + s) * 1000 + f


def lexeme_key(lemma: Column | str, reading: Column | str) -> Column:
    """Identity of a word: 24 hex digits of the digest of dictionary form and reading."""
    return F.substring(F.sha2(F.concat_ws("\x1f", _col(lemma), _col(reading)), 256), 1, 24)


def to_hiragana(reading: Column | str) -> Column:
    return F.translate(_col(reading), _KATAKANA, _HIRAGANA)


def to_katakana(reading: Column | str) -> Column:
    return F.translate(_col(reading), _HIRAGANA, _KATAKANA)


def katakana_reading(reading: Column | str) -> Column:
    """Katakana and the long mark only."""
    return F.regexp_replace(to_katakana(reading), "[^ァ-ヶー]", "")


def learner_pos(pos: Column | str) -> Column:
    labels = F.create_map(*(F.lit(x) for pair in POS_LABELS.items() for x in pair))
    return F.coalesce(F.try_element_at(labels, _col(pos)), _col(pos))


def english_words(text: Column | str) -> Column:
    """The distinct content words of an English text, sorted."""
    words = F.regexp_extract_all(F.lower(_col(text)), F.lit("[a-z][a-z'-]+"), F.lit(0))
    return F.array_sort(F.array_distinct(F.array_except(words, F.array(*map(F.lit, STOPWORDS)))))


def escape_html(text: Column | str) -> Column:
    out = _col(text)
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def marked_target(sentence: Column, target: Column, start: Column, end: Column, before: str, after: str, keep: bool) -> Column:
    """HTML of a sentence with its target marked; keep shows the target between before and after, else nothing stands there.

    The span [start, end) in code points is taken if it holds the target; otherwise the first literal occurrence, if any.
    """
    escaped, wanted = escape_html(sentence), escape_html(target)
    mark = lambda shown: F.concat(F.lit(before), shown if keep else F.lit(""), F.lit(after))
    valid = (start >= 0) & (start < end) & (end <= F.char_length(sentence)) & (F.substr(sentence, start + 1, end - start) == target)
    by_span = F.concat(
        escape_html(F.substr(sentence, F.lit(1), F.greatest(start, F.lit(0)))), mark(wanted),
        escape_html(F.substr(sentence, end + 1, F.char_length(sentence))),
    )
    at = F.position(wanted, escaped)
    by_text = F.concat(F.substr(escaped, F.lit(1), at - 1), mark(wanted), F.substr(escaped, at + F.char_length(wanted), F.char_length(escaped)))
    return F.when(F.coalesce(valid, F.lit(False)), by_span).when((F.char_length(wanted) > 0) & (at > 0), by_text).otherwise(escaped)


def blank_target(sentence: Column, target: Column, start: Column, end: Column) -> Column:
    return marked_target(sentence, target, start, end, '<span class="target-blank">（　）', "</span>", False)


def highlight_target(sentence: Column, target: Column, start: Column, end: Column) -> Column:
    return marked_target(sentence, target, start, end, '<span class="target-answer">', "</span>", True)


def source_label(season: Column | str, episode: Column | str) -> Column:
    return F.format_string("S%02dE%02d", _col(season), _col(episode))


#: The parent of all decks, and the tag of all notes.
DECK_PARENT, NOTE_TAG = "Japanese Sources", "multisource_vocab"


def deck_name(series: Column | str) -> Column:
    """The deck of a series under the common parent; "::" would part it in two."""
    return F.concat(F.lit(f"{DECK_PARENT}::"), F.replace(_col(series), F.lit("::"), F.lit("-")))


def note_tags(series: Column | str) -> Column:
    return F.array(F.lit(NOTE_TAG), F.concat(F.lit("series::"), F.replace(_col(series), F.lit(" "), F.lit("_"))))
