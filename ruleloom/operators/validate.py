"""Strict and lenient answer validation over JSON text, as ordered reasons."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _numeric(kind: Column) -> Column:
    return F.coalesce(kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL"), F.lit(False))


def finite_unit(v: Column, path: str) -> Column:
    """A JSON number in [0, 1] at ``path``; booleans and quoted numbers are none."""
    kind = F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    number = F.try_variant_get(v, path, "double")
    return _numeric(kind) & F.coalesce(number.between(0, 1), F.lit(False))


def decision_reason(body: Column, keys: Column, tolerance: float = 0.02) -> Column:
    """Null for a valid decision, else the first reason against it.

    ``body``: {"choice": key, "probabilities": {key: p}, "confidence": c}."""
    v = F.try_parse_json(body)
    kind = F.schema_of_variant(v)
    choice = F.try_variant_get(v, "$.choice", "string")
    choice_kind = F.schema_of_variant(F.try_variant_get(v, "$.choice", "variant"))
    p = F.try_variant_get(v, "$.probabilities", "map<string,variant>")
    values = F.map_values(p)
    # quoted numbers and booleans are no numbers
    number = lambda x: F.when(_numeric(F.schema_of_variant(x)), F.try_variant_get(x, "$", "double"))
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + F.coalesce(number(x), F.lit(0.0)))
    return (F.when(v.isNull(), "not_json").when(~kind.startswith("OBJECT"), "not_object")
            .when(choice_kind.isNull() | (choice_kind == "VOID"), "choice_missing").when(choice_kind != "STRING", "choice_not_string")
            .when(~F.array_contains(keys, choice), "choice_not_offered")
            .when(p.isNull(), "probabilities_missing").when(F.size(F.array_except(keys, F.map_keys(p))) > 0, "probability_key_missing")
            .when(F.size(F.array_except(F.map_keys(p), keys)) > 0, "probability_key_extra")
            .when(F.exists(values, lambda x: ~F.coalesce(number(x).between(0, 1), F.lit(False))), "probability_not_unit")
            .when(F.abs(total - 1) > tolerance, "probabilities_sum")
            .when(~finite_unit(v, "$.confidence"), "confidence_not_unit"))


def chat_reason(content: Column, keys: Column) -> Column:
    """Null for content that is exactly {"choice": key}, else the first reason."""
    v = F.try_parse_json(content)
    names = F.json_object_keys(content)
    choice = F.try_variant_get(v, "$.choice", "string")
    kind = F.schema_of_variant(F.try_variant_get(v, "$.choice", "variant"))
    return (F.when(content.isNull(), "content_missing").when(v.isNull(), "not_json").when(~F.schema_of_variant(v).startswith("OBJECT"), "not_object")
            .when(~F.array_contains(names, "choice"), "choice_missing").when(F.size(names) > 1, "extra_keys")
            .when(kind != "STRING", "choice_not_string").when(~F.array_contains(keys, choice), "choice_not_offered"))


def lenient_choice(content: Column, keys: Column) -> Column:
    """The first quoted or bare word of a text that is an option."""
    return F.try_element_at(F.filter(F.regexp_extract_all(content, F.lit(r"[A-Za-z][A-Za-z0-9_]*"), F.lit(0)), lambda w: F.array_contains(keys, w)), F.lit(1))


def argmax_key(p: Column, keys: Column) -> Column:
    """The key of the largest of an array of numbers; the first of ties."""
    return F.element_at(keys, F.array_position(p, F.array_max(p)).cast("int"))


def binary_confidence(p: Column) -> Column:
    return F.greatest(p, 1 - p)
