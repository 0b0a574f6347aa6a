"""The passages of a source that support a record's fields: rules run again on every attribute line and text line by itself."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import specs
from ..functions.specs import Field


def passages(sources: DataFrame, keys: tuple[str, ...] = ("record_id", "source_id"), category: str = "category", attributes: str = "attributes", text: str = "text") -> DataFrame:
    """keys, category, pos, attributes (of one or none) and text of each passage: all attributes in order, then all lines that are not blank."""
    none = F.array().cast(sources.schema[attributes].dataType)
    listed = F.coalesce(F.col(attributes), none)
    told = F.transform(listed, lambda a: F.struct(F.array(a).alias("attributes"), F.concat(F.coalesce(a["name"], F.lit("")), F.lit(": "), F.coalesce(a["value"], F.lit(""))).alias("text")))
    lines = F.split(F.coalesce(F.col(text), F.lit("")), r"\R")
    bare = F.transform(F.filter(F.transform(lines, lambda x: F.trim(x)), lambda x: x != ""), lambda x: F.struct(none.alias("attributes"), x.alias("text")))
    one = sources.select(*keys, category, F.posexplode(F.concat(told, bare)).alias("pos", "_p"))
    return one.select(*keys, category, "pos", "_p.attributes", "_p.text")


def evidence(sources: DataFrame, found: DataFrame, categories: dict[str, tuple[Field, ...]], keys: tuple[str, ...] = ("record_id", "source_id")) -> DataFrame:
    """keys, field, value, passage and pos of each field of `found` (keys, field, value) that a passage of its source gives by itself: the first such passage.

    The rules run once on every passage; what they give meets the fields in one join on keys, field and value, so a source with many
    passages is spread by field, and only one row a field is kept where the rows are made.
    """
    again = specs.long(specs.extract(passages(sources, keys), categories).withColumn("_key", F.struct(*keys, "pos", "text")), "_key")
    given = again.select(*(F.col(f"_key.{k}") for k in keys), "field", "value", F.col("_key.pos").alias("pos"), F.col("_key.text").alias("passage"))
    first = given.groupBy(*keys, "field", "value").agg(F.min_by("passage", "pos").alias("passage"), F.min("pos").alias("pos"))
    return found.where(S.clean(F.col("value")).isNotNull()).join(first.hint("merge"), [*keys, "field", "value"])
