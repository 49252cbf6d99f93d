"""Text rules as column expressions: markers, titles, types, slugs, paths."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliospark.settings import (
    CHOICE_PATTERN,
    CHOICE_PREFIXES,
    FORMULA_MARKS,
    GENERIC_TITLE_PATTERN,
    KOREAN_SUBJECT_WORDS,
    MATH_SUBJECT_WORDS,
    OVERLAP_PATTERN,
    PROBLEM_PATTERN,
    SCIENCE_SUBJECT_WORDS,
    SECRET_WORDS,
    SECTION_MAX_CHARS,
    SECTION_SUFFIXES,
)

# (?U) makes \s match every Unicode space, such as U+00A0 and U+3000.
PROBLEM_REGEX = "(?U)" + PROBLEM_PATTERN.replace("{s}", r"\s")
CHOICE_REGEX = "(?U)" + CHOICE_PATTERN.replace("{s}", r"\s")
GENERIC_TITLE_REGEX = "(?U)" + GENERIC_TITLE_PATTERN.replace("{s}", r"\s")
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def strip(text: Column) -> Column:
    """Trim every kind of white space (``trim`` alone removes spaces only)."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def filled(text: Column) -> Column:
    """The text, or null if it is null or blank."""
    return F.when(strip(text) != "", text)


def is_filled(text: Column) -> Column:
    return F.coalesce(strip(text) != "", F.lit(False))


def contains_any(text: Column, words: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


# ------------------------------------------------------------------ markers
def has_problem_marker(text: Column) -> Column:
    return F.coalesce(text.rlike(PROBLEM_REGEX), F.lit(False))


def has_choice_marker(text: Column) -> Column:
    return F.coalesce(text.rlike(CHOICE_REGEX), F.lit(False))


def has_overlap_marker(text: Column) -> Column:
    """Text that starts like both a problem and a choice: 1) to 9)."""
    return F.coalesce(strip(text).rlike(OVERLAP_PATTERN), F.lit(False))


def problem_number(text: Column) -> Column:
    digits = F.concat(F.regexp_extract(text, PROBLEM_REGEX, 1), F.regexp_extract(text, PROBLEM_REGEX, 2))
    return F.when(text.rlike(PROBLEM_REGEX), digits).cast("int")  # most texts have none and are looked at once


def best_line_number(lines: Column, width: Column, height: Column) -> Column:
    """Best number candidate among a block's lines, as a struct; null without one.

    A line near the block's top-left corner beats any other; within each kind
    the lowest score wins. Works inside the row: nothing is exploded or moved.
    """
    across = lambda l: F.greatest(F.lit(0.0), l["bbox"]["left"] / F.greatest(width, F.lit(1.0)))  # noqa: E731,E741
    down = lambda l: F.greatest(F.lit(0.0), l["bbox"]["top"] / F.greatest(height, F.lit(1.0)))  # noqa: E731,E741
    candidates = F.transform(
        lines,
        lambda l, i: F.struct(  # noqa: E741
            line_rank(down(l), across(l), i).alias("rank"), i.alias("line_no"), problem_number(l["text"]).alias("number")
        ),
    )
    return F.array_min(F.filter(candidates, lambda c: c["number"].isNotNull()))


def line_rank(down: Column, across: Column, index: Column) -> Column:
    """Sort value of a number candidate: outside the corner zone first, then the score."""
    return F.struct(
        (~((down <= 0.32) & (across <= 0.18))).alias("outside"), (down * 2.4 + across + index * 0.05).alias("score")
    )


def strip_problem_marker(text: Column) -> Column:
    """Text after the problem marker; null if nothing is left."""
    return filled(strip(F.regexp_replace(strip(text), PROBLEM_REGEX, "")))


def title_source(display_title: Column, text: Column) -> Column:
    return F.coalesce(strip(filled(display_title)), strip(filled(text)))


def display_title_of(display_title: Column, text: Column) -> Column:
    """Title source without its marker, or the source if only the marker is there."""
    source = title_source(display_title, text)
    return F.coalesce(strip_problem_marker(source), source)


# ------------------------------------------------------------ types, subjects
def looks_like_formula(text: Column) -> Column:
    return contains_any(text, FORMULA_MARKS)


def text_block_type(text: Column) -> Column:
    """Block type of a text, first rule that holds."""
    body = strip(F.coalesce(text, F.lit("")))
    choice = reduce(lambda a, b: a | b, [body.startswith(p) for p in CHOICE_PREFIXES])
    section = reduce(lambda a, b: a | b, [body.endswith(p) for p in SECTION_SUFFIXES])
    return (
        F.when(body == "", "unknown")
        .when(looks_like_formula(body), "formula")
        .when(choice, "choice")
        .when((F.length(body) <= SECTION_MAX_CHARS) & section, "section")
        .otherwise("stem")
    )


def subject_words(lowered: Column) -> dict[str, Column]:
    """Whether a lower-cased text holds a subject's words, in order of precedence.

    Give a column that is lower-cased already; an expression would be evaluated for each word.
    """
    words = {"math": MATH_SUBJECT_WORDS, "science": SCIENCE_SUBJECT_WORDS, "korean": KOREAN_SUBJECT_WORDS}
    return {s: F.coalesce(contains_any(lowered, w), F.lit(False)) for s, w in words.items()}


def resolve_enum(value: Column, allowed: Sequence[str], default: str, *, trim: bool = True) -> Column:
    """Lower-cased value if it is allowed, else the default."""
    word = F.lower(strip(value) if trim else value)
    return F.when(word.isin(*allowed), word).otherwise(F.lit(default))


# ------------------------------------------------------------------- titles
def normalize_title(title: Column, index: Column, page_id: Column, number: Column) -> Column:
    """Keep a specific title; replace a generic one by a numbered label."""
    raw = strip(F.coalesce(title, F.lit("")))
    keep = (raw != "") & ~F.lower(raw).contains("problem") & ~raw.rlike(GENERIC_TITLE_REGEX)
    return (
        F.when(keep, raw)
        .when(number > 0, F.concat(F.lit("문항 "), number.cast("string")))
        .otherwise(F.concat(F.format_string("문항 %02d", index + 1), F.lit(" · "), page_id))
    )


# The three forms of a numbered session title.
_TITLE_MARKER = r"(?U)^\s*(?:문항\s*)?([1-9][0-9]{0,2})[.)](?:\s+|$)"
_TITLE_LABEL = r"(?U)^\s*문항\s*([1-9][0-9]{0,2})(?:\s*[·:\-].*)?$"
_TITLE_GENERIC = r"(?Ui)(?:^|[\s_-])problem\s*([0-9]+)$"


def parsed_title(title: Column) -> tuple[Column, Column]:
    """(number, remaining title) of a session title: marker, label or generic form."""
    marked, labelled, generic = (title.rlike(p) for p in (_TITLE_MARKER, _TITLE_LABEL, _TITLE_GENERIC))
    digits = (
        F.when(marked, F.regexp_extract(title, _TITLE_MARKER, 1))
        .when(labelled, F.regexp_extract(title, _TITLE_LABEL, 1))
        .when(generic, F.regexp_extract(title, _TITLE_GENERIC, 1))
    )
    number = digits.try_cast("int")
    rest = (
        F.when(marked, strip(F.regexp_replace(title, _TITLE_MARKER, "")))
        .when(labelled | generic, "")
        .otherwise(strip(title))
    )
    return F.when(number > 0, number), rest


def problem_label(number: Column, index: Column) -> Column:
    return F.concat(F.lit("문항 "), F.coalesce(number, index + 1).cast("string"))


def problem_heading(title: Column, number: Column, index: Column) -> Column:
    """Label and title in one line; the title alone when there is no number."""
    body = strip(F.coalesce(title, F.lit("")))
    label = problem_label(number, index)
    return (
        F.when(number.isNull() & (body != ""), body)
        .when(number.isNull() | (body == "") | (body == label), label)
        .otherwise(F.concat(label, F.lit(" · "), body))
    )


# ------------------------------------------------------- payloads and strings
def normalize_text(text: Column) -> Column:
    """CR to LF, each line trimmed, blank lines dropped (T5)."""
    lines = F.split(F.replace(F.coalesce(text, F.lit("")), F.lit("\r"), F.lit("\n")), "\n")
    return F.array_join(F.filter(F.transform(lines, strip), lambda s: s != ""), "\n")


def slug(value: Column) -> Column:
    """Letters, digits, dash, underscore and dot stay; the rest becomes _."""
    safe = F.regexp_replace(strip(value), r"[^\p{L}\p{N}._-]", "_")
    return F.when(safe != "", safe).otherwise("default")


def redact_settings(settings: Column) -> Column:
    """Hide values whose key names a secret."""
    return F.transform_values(
        settings, lambda k, v: F.when(contains_any(F.lower(k), SECRET_WORDS), "<redacted>").otherwise(v)
    )


def normalize_path(path: Column) -> Column:
    """URLs stay, drive paths become file URLs, backslashes become slashes."""
    slashed = F.replace(path, F.lit("\\"), F.lit("/"))
    url = reduce(lambda a, b: a | b, [path.startswith(p) for p in ("file://", "http://", "https://", "/api/")])
    return (
        F.when(path.isNull(), "")
        .when(url, path)
        .when(path.rlike(r"^[A-Za-z]:[\\/]"), F.concat(F.lit("file:///"), slashed))
        .otherwise(slashed)
    )
