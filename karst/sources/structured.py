"""Structured replies: JSON schemas, and texts held against them without leaving the engine.

Schemas are JSON-schema dicts of objects, arrays, strings, integers, numbers, booleans and null, with enums,
bounds (minimum, maximum, minLength, maxLength, minItems, maxItems) and required properties.  Unknown
properties are always an error.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_KINDS = {"object": r"^OBJECT<", "array": r"^ARRAY<", "string": "^STRING$", "integer": "^BIGINT$", "number": r"^(BIGINT|DOUBLE|FLOAT|DECIMAL\(.*)$", "boolean": "^BOOLEAN$", "null": "^VOID$"}
_JSON_OF = [(T.StringType, "string"), (T.IntegralType, "integer"), (T.NumericType, "number"), (T.BooleanType, "boolean")]


def strict_schema(schema: dict) -> dict:
    """A copy as providers want it: no defaults, every property required, none beside them, at all depths."""
    out = {}
    for key, value in schema.items():
        if key == "default":
            continue
        if key in ("properties", "$defs"):
            value = {k: strict_schema(v) for k, v in value.items()}
        elif isinstance(value, dict):
            value = strict_schema(value)
        elif isinstance(value, list):
            value = [strict_schema(v) if isinstance(v, dict) else v for v in value]
        out[key] = value
    if "properties" in out:
        out |= {"required": list(out["properties"]), "additionalProperties": False}
    return out


def schema_of(kind: T.DataType, required: bool = True) -> dict:
    """The JSON schema of a Spark type: all fields required (unless told), null allowed wherever a field may be null."""
    if isinstance(kind, T.StructType):
        own = {f.name: schema_of(f.dataType, required) for f in kind.fields}
        own = {f.name: own[f.name] | {"type": [own[f.name]["type"], "null"]} if f.nullable else own[f.name] for f in kind.fields}
        return {"type": "object", "properties": own, "required": list(own) if required else []}
    if isinstance(kind, T.ArrayType):
        return {"type": "array", "items": schema_of(kind.elementType, required)}
    for cls, name in _JSON_OF:
        if isinstance(kind, cls):
            return {"type": name}
    raise ValueError(f"no JSON schema for {kind.simpleString()}")


def _kinds(schema: dict) -> list[str]:
    kinds = schema["type"]
    return [kinds] if isinstance(kinds, str) else list(kinds)


def _quoted(key: str) -> str:
    return "$['" + key.replace("'", "\\'") + "']"


def variant_error(v: Column, schema: dict, path: str = "$") -> Column:
    """Null, or the first thing wrong with a variant: wrong_type, unknown_keys, missing_keys, not_in_enum, out_of_bounds, and where."""
    kinds, kind = _kinds(schema), F.schema_of_variant(v)
    told = lambda code: F.lit(code if path == "$" else f"{code} {path}")
    known = F.lit(False)
    for k in kinds:
        known |= kind.rlike(_KINDS[k])
    error = F.when(v.isNull() | ~F.coalesce(known, F.lit(False)), told("wrong_type"))
    if "enum" in schema:
        error = error.when(kind.rlike(_KINDS["string"]) & ~F.try_variant_get(v, "$", "string").isin(schema["enum"]), told("not_in_enum"))
    bounds = [("minimum", "maximum", "number", lambda: F.try_variant_get(v, "$", "double")), ("minLength", "maxLength", "string", lambda: F.length(F.try_variant_get(v, "$", "string"))), ("minItems", "maxItems", "array", lambda: F.size(F.try_variant_get(v, "$", "array<variant>")))]
    for low, high, name, size in bounds:
        outside = F.lit(False)
        if low in schema:
            outside |= size() < schema[low]
        if high in schema:
            outside |= size() > schema[high]
        if low in schema or high in schema:
            error = error.when(kind.rlike(_KINDS[name]) & outside, told("out_of_bounds"))
    if "object" in kinds and "properties" in schema:
        keys = F.map_keys(F.try_variant_get(v, "$", "map<string,variant>"))
        is_object = kind.rlike(_KINDS["object"])
        error = error.when(is_object & (F.size(F.array_except(keys, F.array(*[F.lit(p) for p in schema["properties"]]))) > 0), told("unknown_keys"))
        if schema.get("required"):
            error = error.when(is_object & (F.size(F.array_except(F.array(*[F.lit(p) for p in schema["required"]]), keys)) > 0), told("missing_keys"))
        parts = [F.when(F.array_contains(keys, p), variant_error(F.try_variant_get(v, _quoted(p), "variant"), own, f"{path}.{p}")) for p, own in schema["properties"].items()]
        error = error.when(is_object, F.coalesce(*parts) if len(parts) > 1 else parts[0])
    if "array" in kinds and "items" in schema:
        items = F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x: variant_error(x, schema["items"], f"{path}[]"))
        error = error.when(kind.rlike(_KINDS["array"]), F.get(F.filter(items, lambda e: e.isNotNull()), F.lit(0)))
    return error


def structured(text: Column, schema: dict, kind: T.StructType) -> Column:
    """struct(value, error): the text parsed as kind, or why it is not what the schema asks for (malformed: no JSON at all, or a repeated key)."""
    v = F.try_parse_json(text)
    error = F.when(text.isNull() | v.isNull() | ~F.schema_of_variant(v).rlike(_KINDS["object"]), F.lit("malformed")).otherwise(variant_error(v, schema))
    return F.struct(F.when(error.isNull(), F.from_json(text, kind, {"mode": "PERMISSIVE"})).alias("value"), error.alias("error"))
