"""Text around model calls: what a schema looks like in a prompt, and what an answer means for a schema."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheetweave.functions.parsing import entity_verdict, relation_verdict


def example(kind: T.DataType) -> object:
    """A worked value of a type."""
    if isinstance(kind, T.StructType):
        return {f.name: example(f.dataType) for f in kind.fields}
    if isinstance(kind, T.ArrayType):
        return [example(kind.elementType)]
    if isinstance(kind, T.MapType):
        return {"key": example(kind.valueType)}
    if isinstance(kind, T.BooleanType):
        return True
    if isinstance(kind, T.FractionalType):
        return 0.5
    return 1 if isinstance(kind, T.IntegralType) else "text"


def instruction(schema: T.StructType, style: str = "example") -> str:
    """The end of a prompt that asks for JSON: by a worked example, a list of fields or the schema itself."""
    if style == "example":
        return f"Answer with JSON only, in this form:\n{json.dumps(example(schema))}"
    if style == "fields":
        return "Answer with one JSON object with the fields " + ", ".join(f"{f.name} ({f.dataType.simpleString()}{', may be null' if f.nullable else ''})" for f in schema.fields)
    return f"Answer with JSON that fits this schema:\n{json.dumps(schema.jsonValue())}"


def fallback(answer: Column, schema_key: str) -> Column:
    """A plain-text answer as the JSON that a schema with that key expects; an empty object for other schemas."""
    if schema_key == "keep":
        v = entity_verdict(answer)
        return F.when(~v["parse_failed"], F.to_json(F.struct(v["keep"].alias("keep"), v["confidence"].alias("confidence")))).otherwise("{}")
    if schema_key == "verdict":
        v = relation_verdict(answer)
        return F.when(~v["parse_failed"], F.to_json(F.struct(v["verdict"].alias("verdict"), v["confidence"].alias("revised_confidence")))).otherwise("{}")
    return F.lit("{}")
