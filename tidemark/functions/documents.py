"""JSON text to typed rows and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parse(df: DataFrame, schema: str, column: str = "value") -> DataFrame:
    """Parse JSON text into the columns of ``schema``.

    Null text is dropped. Malformed text fails the job: a broken producer must not lose rows silently.
    The row is unnested by a generator because Spark would otherwise push every later filter below the
    projection and parse the text again for each of its conditions.
    """
    text = F.col(column)
    rest = [F.col(c) for c in df.columns if c != column]
    parsed = F.from_json(text, schema, {"mode": "FAILFAST"})
    return df.select(*rest, F.inline(F.when(text.isNotNull(), F.array(parsed))))


def parse_objects(df: DataFrame, column: str = "value") -> DataFrame:
    """Parse JSON text of objects into a VARIANT column ``record``, under the same rules as ``parse``."""
    text = F.col(column)
    rest = [F.col(c) for c in df.columns if c != column]
    checked = F.when(text.rlike(r"^\s*\{"), text).otherwise(F.raise_error("MALFORMED record: no JSON object"))
    record = F.struct(F.parse_json(checked).alias("record"))
    return df.select(*rest, F.inline(F.when(text.isNotNull(), F.array(record))))


def render(df: DataFrame, *keys: str) -> DataFrame:
    """One JSON ``value`` per row, with a JSON ``key`` of the ``keys`` columns if given."""
    value = F.to_json(F.struct(*[F.col(c) for c in df.columns])).alias("value")
    if not keys:
        return df.select(value)
    return df.select(F.to_json(F.struct(*[F.col(k) for k in keys])).alias("key"), value)


def whole_number(text: Column) -> Column:
    """A bigint from JSON number text, in plain or exponent form; null if it is no number."""
    return F.coalesce(text.try_cast("bigint"), text.try_cast("double").try_cast("bigint"))


def text_of(value: Column, *path: str) -> Column:
    """Text of a field of a VARIANT object: numbers exact but without closing zeros, objects as JSON."""
    return F.try_variant_get(value, "$" + "".join(f"['{name}']" for name in path), "string")


def present(value: Column, name: str) -> Column:
    """Whether a VARIANT object has a field that is not a JSON null."""
    field = F.try_variant_get(value, f"$['{name}']", "variant")
    return field.isNotNull() & ~F.is_variant_null(field)


def fields_of(value: Column) -> Column:
    """The fields of a VARIANT object as a map; fails on other values."""
    return value.cast("map<string,variant>")


def put_fields(fields: Column, **new: Column) -> Column:
    """A map of VARIANT fields with ``new`` ones set, replacing those of the same name.

    A null field is left out, as in any JSON object written without its null fields.
    """
    names = [F.lit(name) for name in new]
    kept = F.map_filter(fields, lambda k, v: ~k.isin(*names) & ~F.is_variant_null(v))
    added = F.map_from_arrays(
        F.array(*names), F.array(*[column.cast("variant") for column in new.values()])
    )
    return F.map_concat(kept, F.map_filter(added, lambda _, v: v.isNotNull()))
