"""Tags, tokens and identifiers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What isn't a tag on a reviewed sheet.
BARE_SIZE = r'^\d+(?:[-\s]\d+/\d+)?\s*["”″](?:\s*[xX×]\s*\d+(?:[-\s]\d+/\d+)?\s*["”″])?$'
LINE_NUMBER = r"^\d{5,}[\d\-]*$"
ANNOTATION = r"(SET\s*@|MAWP|DESIGN|\bGPM\b|#|\bFROM\b|\bTO\b|\bNOTE\b|DETAIL|\bROOM\b|\bTYP\b|\bSHEET\b|\bSIM\b|HEADER|PUMP$|DRUM$|CAISSON|BIOCIDE|NITROGEN)"
# Types that carry the loop number of the equipment they serve.
CHILD_TYPES = ("instrument", "valve", "safety_device")
# Class names between vocabularies.
AGENT_TYPES = {"valve": "valve", "instrumentation": "instrument", "tank": "equipment", "pump": "equipment", "general": "equipment"}
# Characters that text recognition confuses.
CONFUSED = {"0": "8", "1": "7", "5": "6", "B": "8", "O": "0", "I": "1"}


def alnum(s: Column) -> Column:
    return F.regexp_replace(F.upper(F.coalesce(s, F.lit(""))), "[^A-Z0-9]", "")


def kept_tag(s: Column) -> Column:
    """The letters and digits of a tag; null for sizes, annotations, line numbers and what is shorter than two."""
    t = F.trim(F.coalesce(s, F.lit("")))
    a = alnum(t)
    number = F.regexp_replace(t, r"[^0-9\-]", "").rlike(LINE_NUMBER) & ~t.rlike("[A-Za-z]")
    return F.when(~((F.length(a) < 2) | t.rlike(BARE_SIZE) | F.upper(t).rlike(ANNOTATION) | number), a)


def series(tag: Column) -> Column:
    """The first run of three or four digits."""
    return F.nullif(F.regexp_extract(tag, r"(\d{3,4})", 1), F.lit(""))


def series_disagree(a: Column, a_type: Column, b: Column, b_type: Column) -> Column:
    """A child's loop number contradicts that of the equipment at the other end; a missing one is no evidence."""
    ends = (a_type.isin(*CHILD_TYPES) & (b_type == "equipment")) | (b_type.isin(*CHILD_TYPES) & (a_type == "equipment"))
    return F.coalesce(ends & (series(a) != series(b)), F.lit(False))


def field_norm(s: Column) -> Column:
    return F.replace(F.lower(F.trim(s)), F.lit(" "), F.lit(""))


def token_set(s: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(s, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0)))


def token_overlap(pred: Column, truth: Column) -> Column:
    """The share of truth's tokens that pred has; for an empty truth, whether pred is empty too."""
    p, t = token_set(pred), token_set(truth)
    return F.when(F.size(t) == 0, F.when(F.size(p) == 0, 1.0).otherwise(0.0)).otherwise(F.try_divide(F.size(F.array_intersect(p, t)), F.size(t)))


def title_case(s: Column) -> Column:
    return F.initcap(F.replace(s, F.lit("_"), F.lit(" ")))


def temp_id(page: Column, pos: Column, kind: str = "e") -> Column:
    """``p0_e0007``; null for negative numbers."""
    return F.when((page >= 0) & (pos >= 0), F.format_string(f"p%d_{kind}%04d", page, pos))


def model_effort(s: Column) -> tuple[Column, Column]:
    """A model's name without, and its effort from, a suffix."""
    suffix = r"^(.+)-(low|medium|high|xhigh|max)$"
    effort = F.nullif(F.regexp_extract(s, suffix, 2), F.lit(""))
    return F.when(effort.isNull(), s).otherwise(F.regexp_extract(s, suffix, 1)), effort


def trailing_tag(s: Column) -> Column:
    """What stands in brackets at the end, else all of it."""
    return F.coalesce(F.nullif(F.regexp_extract(s, r"\(([^()]*)\)\s*$", 1), F.lit("")), s)


def confuse(s: Column, at: Column) -> Column:
    """One character, at a position from 0, replaced by one it is confused with (or X, or Y for X)."""
    c = F.substr(s, at + 1, F.lit(1))
    other = F.when(c == "X", "Y").otherwise("X")
    for k, v in CONFUSED.items():
        other = F.when(c == k, v).otherwise(other)
    return F.concat(F.substr(s, F.lit(1), at), other, F.substr(s, at + 2, F.length(s)))


def degenerate(s: Column) -> Column:
    """More than eight words, few of them distinct."""
    w = F.filter(F.split(F.trim(s), r"\s+"), lambda x: x != "")
    return (F.size(w) > 8) & (F.try_divide(F.size(F.array_distinct(w)), F.size(w)) < 0.3)


def tag_like(s: Column) -> Column:
    return (F.length(s) >= 2) & s.rlike("[0-9]|-")


def tag_list(s: Column) -> Column:
    """The distinct tag-like tokens, sorted."""
    return F.array_sort(F.array_distinct(F.filter(F.split(s, r"\s+"), tag_like)))


def mapped(s: Column, names: dict[str, str], default: str | None = None) -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in names.items() for x in kv)), s), F.lit(default))
