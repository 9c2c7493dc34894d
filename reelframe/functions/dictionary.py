"""Dynamic metadata as MAP<STRING, VARIANT>: typed reads with the dictionary's coercions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INT_PREFIX = r"^(-?[0-9]+)"
FLOAT_PREFIX = r"^(-?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?)"


# The first letters of a VARIANT's schema to the kind of value.
KINDS = {"BIG": "int", "INT": "int", "SMA": "int", "TIN": "int", "DOU": "double", "FLO": "double", "DEC": "double", "STR": "string", "BOO": "boolean", "VOI": "null", "ARR": "array", "OBJ": "object"}


def kind(v: Column) -> Column:
    """The VARIANT's kind: int (any whole number), double, string, boolean, array, object, null or other.

    One look into a constant map, so the schema is read once.
    """
    names = F.create_map(*(F.lit(x) for pair in KINDS.items() for x in pair))
    return F.when(v.isNotNull(), F.coalesce(F.try_element_at(names, F.substring(F.schema_of_variant(v), 1, 3)), F.lit("other")))


def _schema(v: Column) -> Column:
    return F.schema_of_variant(v)


def _is_string(v: Column) -> Column:
    return _schema(v) == "STRING"


def _rational(v: Column, kind: str) -> tuple[Column, Column]:
    return F.try_variant_get(v, "$.num", kind), F.try_variant_get(v, "$.den", kind)


def to_int(v: Column) -> Column:
    """A whole number; doubles truncate, strings give their numeric prefix, booleans 0 or 1, the rest null.

    These functions ask a VARIANT's schema as little as they can: expressions of
    many branches make methods that the JVM doesn't compile.
    """
    text = F.try_variant_get(v, "$", "string")
    return F.when(_is_string(v), F.regexp_extract(text, INT_PREFIX, 1).try_cast("long")).otherwise(F.try_variant_get(v, "$", "long"))


def to_double(v: Column) -> Column:
    """As to_int, as double; an object with num and den is their quotient (0 if den is 0)."""
    num, den = _rational(v, "double")
    return (
        F.when(_is_string(v), F.regexp_extract(F.try_variant_get(v, "$", "string"), FLOAT_PREFIX, 1).try_cast("double"))
        .when(F.startswith(_schema(v), F.lit("OBJECT")), F.when(num.isNotNull() & (den == 0), 0.0).otherwise(F.try_divide(num, den)))
        .otherwise(F.try_variant_get(v, "$", "double"))
    )


def to_text(v: Column) -> Column:
    """Doubles with six decimals, booleans as true or false, rationals as n/d, the rest unsupported; null is empty."""
    num, den = _rational(v, "long")
    first = F.substring(_schema(v), 1, 1)
    return (
        F.when(v.isNull() | (first == "V"), "")
        .when(first == "O", F.coalesce(F.concat(num.cast("string"), F.lit("/"), den.cast("string")), F.lit("<unsupported type>")))
        .when((first == "D") | (first == "F"), F.coalesce(F.format_string("%.6f", F.try_variant_get(v, "$", "double")), F.lit("<unsupported type>")))
        .when(first == "A", "<unsupported type>")
        .otherwise(F.try_variant_get(v, "$", "string"))
    )


def get_int(m: Column, key: str, default) -> Column:
    return F.coalesce(to_int(F.try_element_at(m, F.lit(key))), F.lit(default).cast("long"))


def get_double(m: Column, key: str, default) -> Column:
    return F.coalesce(to_double(F.try_element_at(m, F.lit(key))), F.lit(default).cast("double"))


def get_string(m: Column, key: str, default) -> Column:
    """The string at a key, without coercion."""
    v = F.try_element_at(m, F.lit(key))
    return F.coalesce(F.when(_is_string(v), F.try_variant_get(v, "$", "string")), F.lit(default).cast("string"))


def options(m: Column, keys: list[str]) -> Column:
    """Options (key, value) that m sets, in the keys' order, as whole numbers; other keys and values that aren't numbers are left out."""
    each = F.array(*(F.struct(F.lit(k).alias("key"), to_int(F.try_element_at(m, F.lit(k))).alias("value")) for k in keys))
    return F.filter(each, lambda x: x["value"].isNotNull())


def contains(m: Column, key: str) -> Column:
    return F.map_contains_key(m, F.lit(key))


def put(m: Column, key: str, v: Column) -> Column:
    """m with this key set; the last write wins."""
    return F.map_concat(remove(m, key), F.create_map(F.lit(key), v))


def remove(m: Column, key: str) -> Column:
    return F.map_filter(m, lambda k, _: k != key)


def index_or_insert(m: Column, key: str) -> Column:
    """m with a null value at key if it had none."""
    return F.when(contains(m, key), m).otherwise(F.map_concat(m, F.create_map(F.lit(key), F.lit(None).cast("variant"))))


def entries(m: Column) -> Column:
    """(key, text of the value), by key."""
    return F.transform(F.array_sort(F.map_keys(m)), lambda k: F.struct(k.alias("key"), to_text(F.try_element_at(m, k)).alias("value")))
