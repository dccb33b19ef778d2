"""Attribute values: text forms of numbers, the comparison map and the typed JSON text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Numbers a double holds unchanged and whose text is already in final form.
_FINAL_NUMBER = r"\A-?(0|[1-9][0-9]{0,14}|[0-9]{1,7}\.[0-9]{0,5}[1-9])\z"
_PLAIN_KEY = r"\A[A-Za-z0-9_.:/-]*\z"
# A number directly behind a key that is longer than that, or has an exponent.
_UNSETTLED = r'":-?([0-9]{16,}|[0-9]{8,}\.|[0-9]*\.[0-9]{7,}|[0-9.]+[eE])|\\u0000'
_INFINITE = ('"Infinity"', '"-Infinity"')


def kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def object_fields(value: Column) -> Column:
    """MAP<STRING, VARIANT> of a JSON object, NULL for every other JSON type."""
    return F.try_variant_get(value, "$", "map<string,variant>")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _shortest(x: Column) -> Column:
    """Scientific notation with the fewest digits that still reads back as the same double.

    With 17 digits there can be several such texts; before Java 19 the formatter does not always pick
    the nearest, so the last of 17 digits may differ by one from other engines.
    """
    def narrow(longest: Column) -> Column:
        shorter = [F.format_string(f"%.{digits}e", x) for digits in (14, 15)]
        return F.coalesce(*[F.when(text.try_cast("double") == x, text) for text in shorter], longest)

    return _let(F.format_string("%.16e", x), narrow)


def _with_layout(x: Column, body: Callable[[Column, Column, Column], Column]) -> Column:
    """Give ``body`` the sign, significant digits and decimal point position of a non-zero double."""
    def cut(parts: Column) -> Column:
        digits = F.rtrim(F.replace(parts[0], F.lit("."), F.lit("")), F.lit("0"))
        return F.struct(digits.alias("digits"), (parts[1].try_cast("int") + 1).alias("point"))

    sign = F.when(x < 0, "-").otherwise("")
    return _let(
        _let(F.split(_shortest(F.abs(x)), "e"), cut), lambda n: body(sign, n["digits"], n["point"])
    )


def _plain(sign: Column, digits: Column, point: Column) -> Column:
    text = (
        F.when(point <= 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), digits))
        .when(point >= F.length(digits), F.concat(digits, F.repeat(F.lit("0"), point - F.length(digits))))
        .otherwise(F.concat(F.left(digits, point), F.lit("."), digits.substr(point + 1, F.length(digits))))
    )
    return F.concat(sign, text)


def _scientific(sign: Column, digits: Column, point: Column) -> Column:
    mantissa = F.when(
        F.length(digits) > 1,
        F.concat(F.left(digits, F.lit(1)), F.lit("."), digits.substr(F.lit(2), F.length(digits))),
    ).otherwise(digits)
    exponent = point - 1
    return F.concat(
        sign, mantissa, F.lit("e"), F.when(exponent >= 0, "+").otherwise("-"), F.abs(exponent).cast("string")
    )


def number_texts(x: Column) -> Column:
    """``(json, plain)`` of a double: JSON text has an exponent from 1e21 up and below 1e-6, plain text,
    which attribute filters compare with, never has."""
    def both(sign: Column, digits: Column, point: Column) -> Column:
        return _let(
            _plain(sign, digits, point),
            lambda plain: F.struct(
                F.when((F.abs(x) >= 1e21) | (F.abs(x) < 1e-6), _scientific(sign, digits, point))
                .otherwise(plain).alias("json"),
                plain.alias("plain"),
            ),
        )

    zero = F.struct(F.lit("0").alias("json"), F.lit("0").alias("plain"))
    return F.when(x == 0, zero).otherwise(_with_layout(x, both))


def _texts(value: Column) -> Column:
    """``(json, plain)`` of one VARIANT; ``json`` is NULL unless it is a string, boolean or finite number."""
    def by_text(json: Column) -> Column:
        first = json.substr(1, 1)
        same = F.struct(json.alias("json"), json.alias("plain"))
        none = F.struct(F.lit(None).cast("string").alias("json"), F.lit(None).cast("string").alias("plain"))
        infinite = json.isin(*_INFINITE) & (kind(value) == "DOUBLE")
        text = F.struct(json.alias("json"), F.try_variant_get(value, "$", "string").alias("plain"))
        return (
            F.when(first == '"', F.when(infinite, none).otherwise(text))
            .when(first.isin("t", "f"), same)
            .when(first.isin("{", "[", "n"), none)
            .when(json.rlike(_FINAL_NUMBER), same)
            .otherwise(_let(json.try_cast("double"), number_texts))
        )

    return _let(F.to_json(value), by_text)


def attribute_entries(fields: Column) -> Column:
    """``(key, text(json, plain))`` per attribute, by key."""
    return F.array_sort(
        F.transform(
            F.map_entries(fields),
            lambda e: F.struct(e["key"].alias("key"), _texts(e["value"]).alias("text")),
        )
    )


def needs_rewriting(json: Column) -> Column:
    """Whether the JSON text of a flat object may hold a number that is not in final form, or a NUL."""
    return json.rlike(_UNSETTLED)


def settled_map(json: Column) -> Column:
    """Comparison map of a flat object whose numbers are all in final form."""
    return F.from_json(json, "map<string,string>")


def quoted(text: Column) -> Column:
    return F.when(text.rlike(_PLAIN_KEY), F.concat(F.lit('"'), text, F.lit('"'))).otherwise(
        F.to_json(text.cast("variant"))
    )


def attributes_json(entries: Column) -> Column:
    """Compact JSON text of a flat attribute object."""
    members = F.transform(entries, lambda e: F.concat(quoted(e["key"]), F.lit(":"), e["text"]["json"]))
    return F.concat(F.lit("{"), F.array_join(members, ","), F.lit("}"))


def attributes_map(entries: Column) -> Column:
    """Comparison map: every value as text."""
    return F.map_from_entries(F.transform(entries, lambda e: F.struct(e["key"], e["text"]["plain"])))


def scalar_plain(value: Column) -> Column:
    """Comparison text of one scalar VARIANT, NULL for JSON null, arrays and objects."""
    return _texts(value)["plain"]


def preview(attr: Column) -> tuple[Column, Column]:
    """``key=value`` of the first attribute in stored order and the number of the others."""
    first = F.array_min(
        F.transform(
            F.map_entries(attr),
            lambda e: F.struct(
                F.octet_length(e["key"]).alias("bytes"), e["key"].alias("key"), e["value"].alias("text")
            ),
        )
    )
    text = F.concat(first["key"], F.lit("="), first["text"])
    return text, F.greatest(F.size(attr) - 1, F.lit(0))
