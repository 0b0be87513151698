"""Tree-shaped chat exports: a map of nodes with parent pointers, walked from the current node upwards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convolith.functions.text import export_role

#: Fixed value: what sessions of such an export name as their source.
EXPORT_SOURCE = "chatgpt-export"
NODE = "struct<id: string, parent: string, message: struct<id: string, author: struct<role: string>, content: struct<content_type: string, parts: array<variant>>, create_time: double>>"
CONVERSATION = f"struct<id: string, title: string, create_time: double, current_node: string, mapping: map<string, {NODE}>>"
_MESSAGE = "struct<role: string, content: string, tool_calls: array<struct<name: string, arguments: string, id: string>>, tool_outputs: array<struct<tool_call_id: string, content: string>>, id: string, parent_id: string, metadata_json: string>"


def joined_parts(parts: Column) -> Column:
    """The string parts one after the other; objects and other values are skipped."""
    texts = F.filter(F.coalesce(parts, F.array().cast("array<variant>")), lambda p: F.schema_of_variant(p) == "STRING")
    return F.array_join(F.transform(texts, lambda p: F.try_variant_get(p, "$", "string")), "")


def walked(mapping: Column, current: Column) -> Column:
    """Nodes from the first to the current one.  As many steps as there are nodes, so cycles end too."""
    none = F.array().cast(f"array<{NODE}>")
    steps = F.sequence(F.lit(1), F.greatest(F.size(mapping), F.lit(1)))
    start = F.struct(current.alias("at"), none.alias("path"))

    def step(acc: Column, _: Column) -> Column:
        node = F.try_element_at(mapping, acc["at"])
        found = acc["at"].isNotNull() & node.isNotNull()
        return F.struct(F.when(found, node["parent"]).alias("at"), F.when(found, F.array_append(acc["path"], node)).otherwise(acc["path"]).alias("path"))

    walk = F.aggregate(steps, start, step, lambda acc: F.reverse(acc["path"]))
    return F.when(F.size(mapping) > 0, walk).otherwise(none)


def export_sessions(df: DataFrame, json: str) -> DataFrame:
    """Sessions of conversations given as JSON objects, one a row; other columns are kept."""
    c = F.col("_c")
    said = F.filter(walked(c["mapping"], c["current_node"]), lambda n: n["message"].isNotNull() & (joined_parts(n["message"]["content"]["parts"]) != ""))
    message = lambda n: F.struct(
        export_role(n["message"]["author"]["role"]).alias("role"),
        joined_parts(n["message"]["content"]["parts"]).alias("content"),
        F.lit(None).cast("array<struct<name: string, arguments: string, id: string>>").alias("tool_calls"),
        F.lit(None).cast("array<struct<tool_call_id: string, content: string>>").alias("tool_outputs"),
        n["message"]["id"].alias("id"),
        n["parent"].alias("parent_id"),
        F.lit("").alias("metadata_json"),
    )
    whole = F.greatest(F.lit(0).cast("double"), F.floor(c["create_time"]).cast("double"))
    return df.withColumn("_c", F.from_json(json, CONVERSATION)).select(
        *[x for x in df.columns if x != json],
        c["id"].alias("id"),
        c["title"].alias("title"),
        F.lit(EXPORT_SOURCE).alias("source"),
        F.lit(None).cast("string").alias("model"),
        whole.cast("decimal(20,0)").alias("created_at"),
        F.lit("").alias("metadata_json"),
        F.transform(said, message).cast(f"array<{_MESSAGE}>").alias("messages"),
    )
