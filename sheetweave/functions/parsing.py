"""Tolerant parsing of model answers. Nothing raises: what can't be read is a row with parse_failed."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# How answers mark JSON and points, and the fields and verdicts that are known.
FENCED = r"(?s)```(?:json)?\s*([\[{].*?[\]}])\s*```"
POINTS = r'<(?:points|tracks).*? coords="([0-9\t:;, .]+)"/?>'
TITLE_FIELDS = ("drawing_number", "revision", "title", "site")
VERDICTS = ("confirmed", "rejected", "uncertain")


def json_text(s: Column) -> Column:
    """The last fenced block; else from the bracket that opens first to the last one of its kind that closes; else null."""
    fenced = F.regexp_extract_all(s, F.lit(FENCED), F.lit(1))

    def span(opener: str, closer: str) -> tuple[Column, Column]:
        start = F.instr(s, opener)
        end = F.length(s) - F.instr(F.reverse(s), closer) + 1
        ok = (start > 0) & (F.instr(s, closer) > 0) & (end > start)
        return F.when(ok, start), F.when(ok, F.substr(s, start, end - start + 1))

    (curly, curly_text), (square, square_text) = span("{", "}"), span("[", "]")
    return F.when(F.size(fenced) > 0, F.try_element_at(fenced, F.lit(-1))).when(curly.isNull() | (square < curly), square_text).otherwise(curly_text)


def json_span(s: Column) -> Column:
    """The simpler locator: from the first curly bracket to the last one that closes."""
    return F.nullif(F.regexp_extract(s, r"(?s)(\{.*\})", 1), F.lit(""))


def json_value(s: Column) -> Column:
    """The located JSON as a variant; null if there is none or it isn't valid."""
    return F.try_parse_json(json_text(s))


def is_object(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))


def title_block(s: Column) -> Column:
    """STRUCT<located, drawing_number, revision, title, site, parse_failed>."""
    v = json_value(s)
    fields = {f: F.when(is_object(v), F.try_variant_get(v, f"$.{f}", "string")) for f in TITLE_FIELDS}
    located = F.coalesce(*(F.nullif(c, F.lit("")) for c in fields.values())).isNotNull()
    return F.struct(located.alias("located"), *(c.alias(f) for f, c in fields.items()), (~is_object(v)).alias("parse_failed"))


def _only(s: Column, yes: str, no: str) -> Column:
    """True or false by the only one of two words that occurs, else null."""
    low = F.lower(s)
    has, hasnt = low.rlike(rf"\b{yes}\b"), low.rlike(rf"\b{no}\b")
    return F.when(has & ~hasnt, True).when(hasnt & ~has, False)


def entity_verdict(s: Column) -> Column:
    """STRUCT<keep, confidence, parse_failed>: a JSON object's ``keep``, else the only one of the words keep and remove."""
    v = json_value(s)
    raw = F.when(is_object(v), F.try_variant_get(v, "$.keep", "string"))
    said = F.when(raw.isNotNull(), ~F.lower(raw).isin("false", "0", "")).otherwise(_only(s, "keep", "remove"))
    sure = F.when(raw.isNotNull(), F.coalesce(F.try_variant_get(v, "$.confidence", "double"), F.lit(0.5))).when(said.isNotNull(), 0.5)
    return F.struct(said.alias("keep"), sure.alias("confidence"), said.isNull().alias("parse_failed"))


def relation_verdict(s: Column) -> Column:
    """STRUCT<verdict, confidence, parse_failed>: a JSON object's known ``verdict``, else the only one of yes and no."""
    v = json_value(s)
    raw = F.when(is_object(v), F.try_variant_get(v, "$.verdict", "string"))
    known, word = F.coalesce(raw.isin(*VERDICTS), F.lit(False)), _only(s, "yes", "no")
    verdict = F.when(known, raw).when(word, "confirmed").when(~word, "rejected")
    sure = F.when(known, F.coalesce(F.try_variant_get(v, "$.revised_confidence", "double"), F.lit(0.5))).when(word, 0.75).when(~word, 0.25)
    return F.struct(verdict.alias("verdict"), sure.alias("confidence"), verdict.isNull().alias("parse_failed"))


def _numbers(s: Column) -> Column:
    found = F.transform(F.filter(F.split(F.trim(s), r"[\t:;, ]+"), lambda x: x != ""), lambda x: F.try_to_number(x, F.lit("999999999.999999")).cast("double"))
    n = F.size(found)
    twice = (n >= 2) & (F.try_element_at(found, F.lit(1)) == F.try_element_at(found, F.lit(2))) & ((n - 1) % 3 == 0)
    return F.when(n % 3 == 0, found).when(twice, F.slice(found, F.lit(2), F.greatest(n - 1, F.lit(0))))


def points(s: Column, width: Column | float, height: Column | float) -> Column:
    """STRUCT<points: ARRAY<STRUCT<x, y>>, parse_failed> of marked triples (frame, x, y) in thousandths; a doubled first number is repaired."""
    groups = F.transform(F.regexp_extract_all(s, F.lit(POINTS), F.lit(1)), _numbers)
    def scaled(v: Column, side: Column | float) -> Column:
        return v / 1000 * side

    def triples(g: Column) -> Column:
        return F.transform(F.filter(F.sequence(F.lit(1), F.greatest(F.size(g), F.lit(1))), lambda i: (i % 3 == 2) & (i < F.size(g))), lambda i: F.struct(scaled(F.element_at(g, i), width).alias("x"), scaled(F.element_at(g, i + 1), height).alias("y")))

    bad = F.exists(groups, lambda g: g.isNull())
    out = F.flatten(F.transform(groups, triples))
    failed = bad | ((F.size(out) == 0) & F.lower(s).contains("<point"))
    return F.struct(F.when(~failed, out).alias("points"), failed.alias("parse_failed"))


def boxes(s: Column, strict: bool = True) -> Column:
    """STRUCT<boxes: ARRAY<ARRAY<STRING>>, parse_failed> of a list of lists; ``0:9`` is read as ``0.9`` and bare words as strings.

    strict: six items each, or all fail; else lists of less than four are left out.
    """
    bare = F.regexp_replace(F.regexp_replace(s, "```(?:json)?", ""), r"(?<=\d):(?=\d)", ".")
    rows = F.transform(F.regexp_extract_all(bare, F.lit(r"\[([^\[\]]*)\]"), F.lit(1)), lambda r: F.transform(F.split(r, ","), lambda x: F.regexp_replace(F.trim(x), '^["\']|["\']$', "")))
    good = F.filter(rows, lambda r: F.size(r) >= 4)
    failed = (F.size(rows) == 0) | ~F.forall(rows, lambda r: F.size(r) == 6) if strict else F.size(rows) == 0
    return F.struct(F.when(~failed, rows if strict else good).alias("boxes"), failed.alias("parse_failed"))


def polarity(s: Column) -> Column:
    """yes or no from ``ANSWER: YES``, a leading yes, no, keep or remove, or a leading A or B."""
    t = F.lower(F.trim(s))
    marked = F.lower(F.regexp_extract(s, r"(?i)ANSWER:\s*(YES|NO)", 1))
    return F.when(marked != "", marked).when(t.rlike(r"^(yes|keep|a\b)"), "yes").when(t.rlike(r"^(no|remove|b\b)"), "no")


def balanced_objects(text: str) -> list[str]:
    """Every outermost ``{...}`` that closes; brackets within strings don't count."""
    out, depth, begin, quoted, skip = [], 0, 0, False, False
    for i, c in enumerate(text):
        if skip:
            skip = False
        elif quoted:
            skip, quoted = c == "\\", c != '"'
        elif c == '"' and depth:
            quoted = True
        elif c == "{":
            begin = begin if depth else i
            depth += 1
        elif c == "}" and depth:
            depth -= 1
            if not depth:
                out.append(text[begin : i + 1])
    return out


def _salvaged(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: balanced_objects(_last_list(t)) if t else [])


def salvage(s: Column) -> Column:
    """ARRAY<STRING> of the complete objects in a cut-off answer, in Arrow batches."""
    return F.pandas_udf(_salvaged, T.ArrayType(T.StringType()))(s)


def _last_list(text: str) -> str:
    """What follows the first ``[`` of an object's list, so that a cut-off outer object doesn't hide its items."""
    at = text.find("[")
    return text[at + 1 :] if 0 <= at and text.lstrip().startswith("{") else text
