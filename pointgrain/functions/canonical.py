"""Canonical JSON of nested columns: sorted keys, no spaces, ASCII only. One text for one content."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Escapes that JSON has a letter for, by UTF-16 unit.
LETTERS = {"0022": '\\"', "005c": "\\\\", "000a": "\\n", "000d": "\\r", "0009": "\\t", "0008": "\\b", "000c": "\\f"}
WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def quoted(text: Column) -> Column:
    """A JSON string; what is not plain ASCII goes as UTF-16 units."""
    units = F.lower(F.hex(F.encode(text, "UTF-16BE")))
    cells = F.transform(F.sequence(F.lit(1), F.greatest(F.length(units), F.lit(1)), F.lit(4)), lambda i: F.substr(units, i, F.lit(4)))

    def escaped(u: Column) -> Column:
        letter = F.when(u == "", "")
        for unit, what in LETTERS.items():
            letter = letter.when(u == unit, what)
        return letter.when((u >= "0020") & (u <= "007e"), F.char(F.conv(u, 16, 10).cast("int"))).otherwise(F.concat(F.lit("\\u"), u))

    plain = text.rlike(r'\A[ !#-\[\]-~]*\z')
    return F.concat(F.lit('"'), F.when(plain, text).otherwise(F.array_join(F.transform(cells, escaped), "")), F.lit('"'))


def number(value: Column) -> Column:
    """A double with the fewest digits that tell it: fixed from 1e-4 up to below 1e16, else with an exponent of two digits or more."""
    size = F.abs(value)
    text = size.cast("string")
    part = lambda i: F.regexp_extract(text, r"^(\d+)\.(\d+)(?:E(-?\d+))?$", i)
    exponent = F.coalesce(F.try_to_number(F.when(part(3) != "", part(3)), F.lit("S999")).cast("int"), F.lit(0))
    written = F.concat(part(1), part(2))
    lead = F.length(written) - F.length(F.ltrim(written, F.lit("0")))
    digits = F.rtrim(F.ltrim(written, F.lit("0")), F.lit("0"))
    point = F.length(part(1)) + exponent - lead
    # Java's text may have a digit more than needed: one less is taken if it is the same number.
    n = F.length(digits)
    fewer = F.when(n > 1, F.substr(digits, F.lit(1), n - 1).cast("decimal(20,0)") + (F.substr(digits, n, F.lit(1)) >= "5").cast("int")).cast("string")
    same = F.concat(fewer, F.lit("E"), (point - n + 1).cast("string")).cast("double") == size
    longer = F.length(fewer) - (n - 1)
    point, digits = F.when(same, point + longer).otherwise(point), F.when(same, F.rtrim(fewer, F.lit("0"))).otherwise(digits)
    n = F.length(digits)
    zeros = lambda k: F.repeat(F.lit("0"), k)
    fixed = (
        F.when(point <= 0, F.concat(F.lit("0."), zeros(-point), digits))
        .when(point >= n, F.concat(digits, zeros(point - n), F.lit(".0")))
        .otherwise(F.concat(F.substr(digits, F.lit(1), point), F.lit("."), F.substr(digits, point + 1)))
    )
    power = point - 1
    tail = F.concat(F.lit("e"), F.when(power < 0, "-").otherwise("+"), F.lpad(F.abs(power).cast("string"), F.greatest(F.lit(2), F.length(F.abs(power).cast("string"))), F.lit("0")))
    far = F.concat(F.substr(digits, F.lit(1), F.lit(1)), F.when(n > 1, F.concat(F.lit("."), F.substr(digits, F.lit(2)))).otherwise(""), tail)
    shown = F.when(size == 0, "0.0").when((point > -4) & (point <= 16), fixed).otherwise(far)
    sign = F.when((value < 0) | (value.cast("string") == "-0.0"), "-").otherwise("")
    return F.when(F.isnan(value), "NaN").when(size == F.lit(float("inf")), F.concat(sign, F.lit("Infinity"))).otherwise(F.concat(sign, shown))


def json_text(value: Column, kind: T.DataType) -> Column:
    """The canonical JSON of a column of this type: fields and keys sorted by code point, nulls kept. Maps need text keys;
    types that JSON lacks are an error."""
    if isinstance(kind, T.StructType):
        parts = [F.concat(F.lit(("," if i else "") + json.dumps(f.name) + ":"), json_text(value.getField(f.name), f.dataType)) for i, f in enumerate(sorted(kind.fields, key=lambda f: f.name))]
        text = F.concat(F.lit("{"), *parts, F.lit("}"))
    elif isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
        entry = lambda k: F.concat(quoted(k), F.lit(":"), json_text(F.element_at(value, k), kind.valueType))
        text = F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.map_keys(value)), entry), ","), F.lit("}"))
    elif isinstance(kind, T.ArrayType):
        text = F.concat(F.lit("["), F.array_join(F.transform(value, lambda x: json_text(x, kind.elementType)), ","), F.lit("]"))
    elif isinstance(kind, T.StringType):
        text = quoted(value)
    elif isinstance(kind, T.BooleanType):
        text = F.when(value, "true").otherwise("false")
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        text = number(value.cast("double"))
    elif isinstance(kind, WHOLE):
        text = value.cast("string")
    else:
        raise TypeError(f"no JSON form for {kind.simpleString()}")
    return F.when(value.isNull(), "null").otherwise(text)
