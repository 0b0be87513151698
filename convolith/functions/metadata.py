"""Typed access to free JSON: what is read must have the type that is asked for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from convolith.schema import HOISTED


def typed_string(value: Column, key: str) -> Column:
    """The string at a top-level key of a variant; null for any other type (5 is no title)."""
    at = F.try_variant_get(value, f"$.{key}", "variant")
    return F.when(F.schema_of_variant(at) == "STRING", F.try_variant_get(value, f"$.{key}", "string"))


def typed_seconds(value: Column, key: str) -> Column:
    """The non-negative integer at a top-level key; null for strings, fractions and negative numbers."""
    at = F.try_variant_get(value, f"$.{key}", "variant")
    whole = F.schema_of_variant(at).rlike(r"^(BIGINT|DECIMAL\((19|20),0\))$")
    number = F.try_variant_get(value, f"$.{key}", "decimal(20,0)")
    return F.when(whole & (number >= 0) & (number <= F.lit("18446744073709551615").cast("decimal(20,0)")), number)


def hoist(metadata_json: Column) -> dict[str, Column]:
    """title, source, model and created_at of a start event's metadata, each of its own type."""
    v = F.try_parse_json(metadata_json)
    return {k: typed_seconds(v, k) if k == "created_at" else typed_string(v, k) for k in HOISTED}


def rest(metadata_json: Column) -> Column:
    """The metadata without the hoisted keys, as a map of key to JSON text."""
    m = F.from_json(F.coalesce(metadata_json, F.lit("{}")), "map<string, variant>")
    return F.transform_values(F.map_filter(m, lambda k, _: ~k.isin(*HOISTED)), lambda _, v: F.to_json(v))


def sink(metadata_json: Column, columns: dict[str, Column]) -> Column:
    """The metadata as JSON text with the columns put back in under their keys, nulls left out."""
    m = F.from_json(F.coalesce(metadata_json, F.lit("{}")), "map<string, variant>")
    kept = F.map_filter(m, lambda k, _: ~k.isin(*HOISTED))
    own = F.map_from_arrays(F.array(*[F.lit(k) for k in columns]), F.array(*[F.parse_json(F.to_json(F.struct(c.alias("x")))) for c in columns.values()]))
    own = F.transform_values(own, lambda _, v: F.try_variant_get(v, "$.x", "variant"))
    own = F.map_filter(own, lambda _, v: v.isNotNull() & (F.schema_of_variant(v) != "VOID"))
    return F.to_json(F.map_concat(kept, own))
