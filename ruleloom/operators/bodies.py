"""Two versions of JSON bodies compared place by place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ruleloom.functions.text import bound

DEPTH = 8


def _inside(path: Column, v: Column) -> Column:
    """One level further: the fields or elements of a value with their paths, or the value itself,
    which is not ``open`` any more."""
    kind = F.schema_of_variant(v)
    fields = F.map_entries(F.try_variant_get(v, "$", "map<string,variant>"))
    elements = F.try_variant_get(v, "$", "array<variant>")
    itself = F.array(F.struct(path.alias("path"), v.alias("v"), F.lit(False).alias("open")))
    named = F.transform(fields, lambda e: F.struct(F.concat(path, F.lit("."), e["key"]).alias("path"), e["value"].alias("v"), F.lit(True).alias("open")))
    placed = F.transform(elements, lambda x, i: F.struct(F.concat(path, F.lit("["), i.cast("string"), F.lit("]")).alias("path"), x.alias("v"), F.lit(True).alias("open")))
    several = bound(F.when(kind.startswith("OBJECT"), named).when(kind.startswith("ARRAY"), placed), lambda xs: F.when(F.size(xs) > 0, xs))
    return F.coalesce(several, itself)


def leaves(rows: DataFrame, keys: list[str], body: str, depth: int = DEPTH) -> DataFrame:
    """(keys, path, value): every scalar and empty container of a JSON text with its
    path and its own JSON text. What lies deeper than ``depth`` levels is one value,
    its fields in order. A text that is no JSON is one value at ``$``; a null
    text has none.

    Each level is an explosion in the row's own task: nothing travels. What is found to
    be a value is not looked into again."""
    v = F.try_parse_json(body)
    parsed = rows.where(F.col(body).isNotNull()).select(*keys, F.col(body).alias("raw"), F.lit("$").alias("path"), v.alias("v"))
    # a JSON null is a value, a text that is no JSON has none
    told = parsed.select(*keys, F.when(F.col("v").isNull(), F.col("raw")).alias("raw"), "path", "v", F.lit(True).alias("open"))
    closed = F.array(F.struct("path", "v", F.lit(False).alias("open")))
    for _ in range(depth):
        told = told.select(*keys, "raw", F.explode(F.when(F.col("open"), _inside(F.col("path"), F.col("v"))).otherwise(closed)).alias("x")).select(*keys, "raw", "x.path", "x.v", "x.open")
    return told.select(*keys, "path", F.coalesce("raw", F.to_json("v")).alias("value"))


def differences(left: DataFrame, right: DataFrame, key: str, body: str, depth: int = DEPTH) -> DataFrame:
    """(key, state, n_differing, first_path, left_value, right_value) of the bodies
    that are not the same in both: ``left_only``, ``right_only`` or ``differs``, with
    the first place (the least path as text) where they do and what stands there.

    Order of fields and white space are no difference; numbers differ when
    their text does. ``key`` is unique on each side; a null key meets a null
    key; a null body is a missing one. Bodies are first compared whole, so only
    those that differ come apart, in the tasks where they met."""
    whole = lambda c: F.coalesce(F.to_json(F.try_parse_json(c)), F.col(c))
    a = left.where(F.col(body).isNotNull()).select(F.col(key).alias("ka"), F.col(body).alias("a"))
    b = right.where(F.col(body).isNotNull()).select(F.col(key).alias("kb"), F.col(body).alias("b"))
    met = a.join(b, F.col("ka").eqNullSafe(F.col("kb")), "full").where(~whole("a").eqNullSafe(whole("b")))
    state = F.when(F.col("b").isNull(), "left_only").when(F.col("a").isNull(), "right_only").otherwise("differs")
    sides = met.select(F.when(F.col("a").isNull(), F.col("kb")).otherwise(F.col("ka")).alias(key), state.alias("state"), F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("a").alias("text")), F.struct(F.lit(1).alias("side"), F.col("b").alias("text")))).alias("s"))
    each = leaves(sides.select(key, "state", "s.side", "s.text"), [key, "state", "side"], "text", depth)
    paired = each.groupBy(key, "state", "path").agg(F.max(F.when(F.col("side") == 0, F.col("value"))).alias("l"), F.max(F.when(F.col("side") == 1, F.col("value"))).alias("r"))
    first = F.min(F.struct("path", "l", "r"))
    out = paired.where(~F.col("l").eqNullSafe(F.col("r"))).groupBy(key, "state").agg(F.count("*").alias("n_differing"), first.alias("f"))
    return out.select(key, "state", "n_differing", F.col("f.path").alias("first_path"), F.col("f.l").alias("left_value"), F.col("f.r").alias("right_value"))
