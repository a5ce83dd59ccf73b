"""Record conformance to a JSON Schema document (C5), judged on raw JSON.

``compile_schema`` turns a schema (a dict) into one column expression over a VARIANT,
so the rules are data: another schema needs no code.  Records are judged as written,
before any typed read could cast or drop what is wrong, so ``type`` can be told.

Keywords: type (one or several), required, properties, additionalProperties (a
schema), items, minItems, maxItems, enum (strings), pattern, format "date", minimum,
maximum.  As JSON Schema has it, a keyword concerns values of its own kind only, an
absent property breaks nothing but ``required``, a present null is a value of type
null, and 3.0 is an integer.

Violations are (path, rule); paths name properties and element numbers, as
``skills[2].proficiency``.  A text that isn't JSON breaks rule ``json`` at ''.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VIOLATION = "array<struct<path:string,rule:string>>"
DATE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"


def _given(value: Column, checks: Callable[[Column], Column]) -> Column:
    """The violations of a value that is there; the value is evaluated once."""
    there = F.filter(F.array(value), lambda v: v.isNotNull())
    return F.flatten(F.transform(there, checks))


def _one(path: Column, rule: str) -> Column:
    return F.array(F.struct(path.alias("path"), F.lit(rule).alias("rule")))


def _if(broken: Column, path: Column, rule: str) -> Column:
    return F.when(F.coalesce(broken, F.lit(False)), _one(path, rule)).otherwise(F.array().cast(VIOLATION))


def _is(value: Column, kind: Column, number: Column, name: str) -> Column:
    return {"string": kind == "STRING", "boolean": kind == "BOOLEAN", "null": F.is_variant_null(value),
            "number": number.isNotNull(),
            "integer": F.coalesce(number == F.rint(number), F.lit(False)),
            "array": F.try_variant_get(value, "$", "array<variant>").isNotNull(),
            "object": F.try_variant_get(value, "$", "map<string,variant>").isNotNull()}[name]


def _join(path: Column, name: Column) -> Column:
    return F.when(path == "", name).otherwise(F.concat(path, F.lit("."), name))


def _checks(value: Column, schema: dict, path: Column) -> Column:
    kind = F.schema_of_variant(value)
    scalar = {"minimum", "maximum"} & set(schema) or {"number", "integer"} & set(_types(schema))
    number = F.when(kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL"),
                    F.try_variant_get(value, "$", "double")) if scalar else F.lit(None).cast("double")
    text = F.when(kind == "STRING", F.try_variant_get(value, "$", "string"))
    parts = []
    if _types(schema):
        fits = F.lit(False)
        for t in _types(schema):
            fits = fits | _is(value, kind, number, t)
        parts.append(_if(~fits, path, "type"))
    if "pattern" in schema:
        parts.append(_if(~text.rlike(schema["pattern"]), path, "pattern"))
    if "enum" in schema:
        parts.append(_if(~F.coalesce(text.isin(list(schema["enum"])), F.lit(False)), path, "enum"))
    if schema.get("format") == "date":
        parts.append(_if(text.isNotNull() & (~text.rlike(DATE) | F.try_to_date(text, "yyyy-MM-dd").isNull()), path, "format"))
    if "minimum" in schema:
        parts.append(_if(number < float(schema["minimum"]), path, "minimum"))
    if "maximum" in schema:
        parts.append(_if(number > float(schema["maximum"]), path, "maximum"))
    if {"items", "minItems", "maxItems"} & set(schema):
        parts.append(_given(F.try_variant_get(value, "$", "array<variant>"), lambda a: _elements(a, schema, path)))
    if {"required", "properties", "additionalProperties"} & set(schema):
        parts.append(_given(F.try_variant_get(value, "$", "map<string,variant>"), lambda m: _members(m, schema, path)))
    return F.concat(*parts) if parts else F.array().cast(VIOLATION)


def _types(schema: dict) -> list[str]:
    t = schema.get("type", [])
    return [t] if isinstance(t, str) else list(t)


def _elements(array: Column, schema: dict, path: Column) -> Column:
    parts = []
    if "minItems" in schema:
        parts.append(_if(F.size(array) < schema["minItems"], path, "minItems"))
    if "maxItems" in schema:
        parts.append(_if(F.size(array) > schema["maxItems"], path, "maxItems"))
    if "items" in schema:
        parts.append(F.flatten(F.transform(array, lambda v, i: _checks(
            v, schema["items"], F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))))))
    return F.concat(*parts)


def _members(members: Column, schema: dict, path: Column) -> Column:
    parts = [_if(~F.map_contains_key(members, F.lit(name)), _join(path, F.lit(name)), "required")
             for name in schema.get("required", [])]
    named = schema.get("properties", {})
    for name, sub in named.items():
        parts.append(_given(F.try_element_at(members, F.lit(name)), _member(sub, _join(path, F.lit(name)))))
    rest = schema.get("additionalProperties")
    if isinstance(rest, dict):
        others = F.filter(F.map_entries(members), lambda e: ~e["key"].isin(list(named)) if named else F.lit(True))
        parts.append(F.flatten(F.transform(others, lambda e: _checks(e["value"], rest, _join(path, e["key"])))))
    return F.concat(*parts) if parts else F.array().cast(VIOLATION)


def _member(schema: dict, path: Column) -> Callable[[Column], Column]:
    return lambda v: _checks(v, schema, path)


def compile_schema(schema: dict) -> Callable[[Column], Column]:
    """A function from a VARIANT column to the array of its violations."""
    return lambda value: _given(value, lambda v: _checks(v, schema, F.lit("")))


def conformance(df: DataFrame, key: str, record: str, schema: dict) -> DataFrame:
    """(record_key, path, rule): every violation of ``schema`` by the JSON texts in ``record``."""
    parsed = df.select(F.col(key).alias("record_key"), F.try_parse_json(F.col(record)).alias("v"),
                       F.col(record).isNotNull().alias("there"))
    broken = F.when(F.col("v").isNull(), _one(F.lit(""), "json")).otherwise(compile_schema(schema)(F.col("v")))
    return parsed.where("there").select("record_key", F.explode(broken).alias("b")).select("record_key", "b.path", "b.rule")


def read_raw_records(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """(record, source) JSON texts as they are: lines of a .jsonl file; else the elements of an array, or one object."""
    if (fmt or ("jsonl" if path.lower().endswith(".jsonl") else "json")) == "jsonl":
        lines = spark.read.text(path).withColumn("source", F.input_file_name())
        return lines.where(F.trim("value") != "").select(F.col("value").alias("record"), "source")
    whole = spark.read.text(path, wholetext=True).withColumn("source", F.input_file_name())
    v = F.try_parse_json("value")
    several = F.try_variant_get(v, "$", "array<variant>")
    records = F.when(several.isNotNull(), F.transform(several, lambda x: F.to_json(x))).otherwise(F.array("value"))
    return whole.select(F.explode(records).alias("record"), "source")
