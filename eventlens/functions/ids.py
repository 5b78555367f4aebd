"""Content ids: the first 12 hex digits of the SHA-256 of key-sorted JSON text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F
from pyspark.sql import types as T


def _code_unit(value: Column) -> Column:
    return F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(value)), 4, "0"))


def _escaped_char(char: Column) -> Column:
    point = F.ascii(char)
    above = point - F.lit(0x10000)
    pair = F.concat(
        _code_unit(F.lit(0xD800) + F.shiftright(above, 10)),
        _code_unit(F.lit(0xDC00) + above.bitwiseAND(F.lit(0x3FF))),
    )
    return (
        F.when(char == '"', F.lit('\\"'))
        .when(char == "\\", F.lit("\\\\"))
        .when(char == "\n", F.lit("\\n"))
        .when(char == "\r", F.lit("\\r"))
        .when(char == "\t", F.lit("\\t"))
        .when(char == "\b", F.lit("\\b"))
        .when(char == "\f", F.lit("\\f"))
        .when((point >= 32) & (point < 127), char)
        .when(point > 0xFFFF, pair)
        .otherwise(_code_unit(point))
    )


# Printable ASCII without quote and backslash stands for itself.
PLAIN = r"^[ !#-\[\]-~]*$"


def json_string(text: Column) -> Column:
    """JSON literal of a string in pure ASCII; null becomes ``null``."""
    escaped = F.concat_ws("", F.transform(F.split(text, ""), _escaped_char))
    body = F.when(text.rlike(PLAIN), text).otherwise(escaped)
    return F.when(text.isNotNull(), F.concat(F.lit('"'), body, F.lit('"'))).otherwise("null")


def _json_double(value: Column) -> Column:
    """A double as its shortest digits: plain from 1e-4 to below 1e16, else with an exponent of two digits at least.

    Where Spark writes an exponent, the plain form is put together from its digits; no decimal type holds them all.
    """
    text = value.cast("string")
    mantissa = F.substring_index(text, "E", 1)
    exponent = F.substring_index(text, "E", -1).cast("int")
    minus = F.when(value < 0, "-").otherwise("")
    digits = F.regexp_replace(F.regexp_replace(mantissa, "[-.]", ""), "0+$", "")
    below_one = F.concat(minus, F.lit("0."), F.repeat(F.lit("0"), -exponent - 1), digits)
    whole = F.rpad(F.substring(digits, F.lit(1), exponent + 1), exponent + 1, F.lit("0"))
    rest = F.substring(digits, exponent + 2, F.char_length(digits))
    plain = F.concat(minus, whole, F.lit("."), F.when(rest == "", "0").otherwise(rest))
    size = F.lpad(F.abs(exponent).cast("string"), F.greatest(F.lit(2), F.char_length(F.abs(exponent).cast("string"))), F.lit("0"))
    power = F.concat(F.regexp_replace(mantissa, r"\.0$", ""), F.lit("e"), F.when(exponent < 0, "-").otherwise("+"), size)
    return (
        F.when(F.isnan(value), "NaN")
        .when(F.abs(value) == float("inf"), F.when(value > 0, "Infinity").otherwise("-Infinity"))
        .when(~text.contains("E"), text)
        .when((exponent >= -4) & (exponent < 0), below_one)
        .when((exponent >= 0) & (exponent < 16), plain)
        .otherwise(power)
    )


def json_text(value: Column, kind: T.DataType) -> Column:
    """JSON text of a value of any nested type, keys sorted, ``", "`` and ``": "`` as separators."""
    if isinstance(kind, T.StringType):
        return json_string(value)
    if isinstance(kind, T.StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        parts = [F.concat(json_string(F.lit(f.name)), F.lit(": "), json_text(value[f.name], f.dataType)) for f in fields]
        body = F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))
    elif isinstance(kind, T.MapType):
        if not isinstance(kind.keyType, T.StringType):
            raise ValueError("only text can be a key")
        pairs = F.transform(
            F.array_sort(F.transform(F.map_keys(value), lambda k: k)),
            lambda k: F.concat(json_string(k), F.lit(": "), json_text(F.element_at(value, k), kind.valueType)),
        )
        body = F.concat(F.lit("{"), F.array_join(pairs, ", "), F.lit("}"))
    elif isinstance(kind, T.ArrayType):
        body = F.concat(F.lit("["), F.array_join(F.transform(value, lambda v: json_text(v, kind.elementType)), ", "), F.lit("]"))
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        body = _json_double(value.cast("double"))
    elif isinstance(kind, (T.IntegralType, T.BooleanType)):
        body = value.cast("string")
    elif isinstance(kind, T.NullType):
        return F.lit("null")
    else:
        raise ValueError(f"no JSON text for {kind.simpleString()}")
    return F.when(value.isNotNull(), body).otherwise("null")


TEXT_MAP = T.MapType(T.StringType(), T.StringType())


def json_sorted_text(info: Column, kind: T.DataType = TEXT_MAP) -> Column:
    """JSON object with sorted keys of a map or struct of the type ``kind``."""
    return json_text(info, kind)


def content_id(info: Column, kind: T.DataType = TEXT_MAP) -> Column:
    """Id of a version: equal information gives an equal id. ``kind`` is the type of ``info``."""
    return F.substring(F.sha2(json_sorted_text(info, kind), 256), 1, 12)


def experiment_content_id(name: Column, parameters: Column, kind: T.DataType = TEXT_MAP) -> Column:
    """Id of an experiment: its name, an underscore and its parameters."""
    return F.substring(F.sha2(F.concat(name, F.lit("_"), json_sorted_text(parameters, kind)), 256), 1, 12)
