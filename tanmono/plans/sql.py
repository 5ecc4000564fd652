"""SQL pieces shared by the oracles: the canonical model and text rules in DuckDB's dialect."""

BLANKS = r"[\t\n\x{0b}\f\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def strip(text: str) -> str:
    return f"regexp_replace({text}, '^{BLANKS}+|{BLANKS}+$', '', 'g')"


def clean(text: str) -> str:
    bare = rf"regexp_replace(regexp_replace({text}, '<[^>]+>', '', 'g'), '\{{\\[^}}]+\}}', '', 'g')"
    flat = rf"trim(regexp_replace(replace({bare}, '\N', ' '), '{BLANKS}+', ' ', 'g'), ' ')"
    flat = f"replace(replace({flat}, '((', ''), '))', '')"
    return rf"trim(regexp_replace({flat}, '^(?:[（(][^）)]{{1,24}}[）)]{BLANKS}*)+', ''), ' ')"


def escape(text: str) -> str:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#x27;")):
        text = f"replace({text}, '{raw}', '{safe}')"
    return text


def any_of(text: str, marks: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, '{m}')" for m in marks) + ")"


MODEL = """
src AS (SELECT * EXCLUDE (imported_at, r, first_at), first_at AS imported_at FROM (
          SELECT *, row_number() OVER (PARTITION BY id, series, season, episode ORDER BY imported_at DESC, coalesce(title, '') DESC) AS r,
                 min(imported_at) OVER (PARTITION BY id, series, season, episode) AS first_at FROM sources) WHERE r = 1),
sen AS (SELECT DISTINCT * FROM sentences),
lex AS (SELECT DISTINCT * FROM lexemes),
occ AS (SELECT DISTINCT lexeme_id, sentence_id, surface, coalesce(count, 1) AS n FROM occurrences)
"""
