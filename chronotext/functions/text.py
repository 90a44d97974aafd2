"""Column-expression builders for the text rules.

Every rule is a built-in Spark expression (JVM side, no Python per row).
Patterns are written so that the same string is valid both as a Java regex
(Spark) and, where noted, as an RE2 regex (DuckDB oracle SQL).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: text rules --------------------------------------------
# One-letter tag pair, inner text kept; "(?d)": only "\n" ends a line, so "."
# crosses "\r" as Python's "." does.  A tag letter is a Unicode word char.
TAG_PAIR = r"(?d)<[\p{L}\p{N}_]>(.*?)</[\p{L}\p{N}_]>"
TAG_PAIR_RE2 = r"<[\p{L}\p{N}_]>(.*?)</[\p{L}\p{N}_]>"
# Python str.strip() whitespace at both ends (identical in Java and RE2).
EDGE_SPACE = r"^[\s\x{0B}\x{1C}-\x{1F}\x{85}\p{Z}]+|[\s\x{0B}\x{1C}-\x{1F}\x{85}\p{Z}]+\z"
# Any other character: a text without one is blank.
NOT_SPACE = r"[^\s\x{0B}\x{1C}-\x{1F}\x{85}\p{Z}]"
# ASCII whitespace used by the token and sentence rules.
WS = r"[ \t\n\x{0B}\f\r]"
# A token is a run of letters/marks/digits or one other non-space char.
TOKEN = r"[\p{L}\p{M}\p{N}]+|[^ \t\n\x{0B}\f\r\p{L}\p{M}\p{N}]"
# Pieces cover every character exactly once: tokens plus whitespace runs.
PIECE = r"[\p{L}\p{M}\p{N}]+|[ \t\n\x{0B}\f\r]+|[^ \t\n\x{0B}\f\r\p{L}\p{M}\p{N}]"
# Sentence end: one of . ! ? followed by whitespace.
SENT_END = r"([.!?])[ \t\n\x{0B}\f\r]+"
SENT_MARK = "\u0001"
# Runs of two or more Unicode whitespace chars collapse to one space (char n-grams).
WS_RUN = r"[\t\n\x{0B}\f\r \x{85}\p{Z}\x{1C}-\x{1F}]{2,}"
LETTER = r"\p{L}"
# ---------------------------------------------------------------------------


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def strip_space(col) -> Column:
    """Python ``str.strip()``: remove Unicode whitespace at both ends."""
    return F.regexp_replace(_c(col), EDGE_SPACE, "")


def not_blank(col) -> Column:
    """Something is left when the text is stripped; found at its first character that isn't space."""
    return _c(col).rlike(NOT_SPACE)


def clean_text(col) -> Column:
    """Reference cleaning: lower, unwrap one-letter tags (one lazy pass),
    drop NUL characters, strip."""
    lowered = F.lower(_c(col))
    untagged = F.regexp_replace(lowered, TAG_PAIR, "$1")
    no_nul = F.replace(untagged, F.lit("\u0000"), F.lit(""))
    return strip_space(no_nul)


def tokens(col) -> Column:
    """Raw word tokens, punctuation marks included (one per mark)."""
    return F.regexp_extract_all(_c(col), F.lit(TOKEN), 0)


def word_tokens(col) -> Column:
    """Lower-cased tokens holding at least one letter."""
    return F.filter(tokens(F.lower(_c(col))), lambda t: t.rlike(LETTER))


def n_word_tokens(col) -> Column:
    return F.size(word_tokens(col))


def sentences(col) -> Column:
    """Split at ``[.!?]`` followed by whitespace; empty pieces dropped."""
    marked = F.regexp_replace(_c(col), SENT_END, "$1" + SENT_MARK)
    return F.filter(F.split(marked, SENT_MARK), lambda s: s != F.lit(""))


def endlines(col) -> Column:
    """Split on newline, strip every line, drop blank lines."""
    lines = F.transform(F.split(_c(col), "\n"), lambda s: strip_space(s))
    return F.filter(lines, lambda s: s != F.lit(""))


def collapse_space(col) -> Column:
    return F.regexp_replace(_c(col), WS_RUN, " ")


def char_array(col) -> Column:
    """The string as an array of code points (empty string -> empty array)."""
    return F.when(F.length(_c(col)) > 0, F.split(_c(col), "")).otherwise(F.array().cast("array<string>"))


def char_ngrams(text, n_min: int = 1, n_max: int = 3) -> Column:
    """All character n-grams (code points), n_min..n_max, of a string.

    Unigrams are the character array; longer grams are the overlapping
    matches of ``(?s)(?=(.{n}))`` (one compiled regex pass per n, JVM side).
    Never ``substring`` over positions: positional access into UTF-8 is
    linear, which makes that quadratic in the text length.
    """
    text = _c(text)
    parts = []
    for n in range(n_min, n_max + 1):
        if n == 1:
            parts.append(char_array(text))
        else:
            parts.append(F.regexp_extract_all(text, F.lit(r"(?s)(?=(.{%d}))" % n), 1))
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def shape_tag(col) -> Column:
    """Default part-of-speech stand-in: a deterministic shape class."""
    c = _c(col)
    return (F.when(c.rlike(r"^\p{N}+$"), F.lit("NUM"))
            .when(~c.rlike(r"[\p{L}\p{N}]"), F.lit("PUNCT"))
            .when(c.rlike(r"\p{L}") & c.rlike(r"\p{N}"), F.lit("MIX"))
            .when(F.length(c) <= 3, F.lit("FUNC"))
            .when(F.length(c) <= 7, F.lit("WORD"))
            .otherwise(F.lit("LONG")))


def md5_order(*cols) -> Column:
    """Seeded pseudo-random order key, equal in Spark and DuckDB."""
    return F.md5(F.concat_ws("-", *[_c(c).cast("string") for c in cols]))
