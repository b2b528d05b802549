"""The field catalogue: one row per field per index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell import rules
from tracewell.functions.text import glob_to_like
from tracewell.operators.sizes import landed

FIELD_ROWS = "array<struct<field_name:string,field_type:string,rest:variant>>"
LEVELS = 20  # levels of a mapping that one pass walks; the usual depth limit


def skip_system(indices: DataFrame) -> DataFrame:
    return indices.where(~F.col("index_name").startswith("."))


def mapping_fields(node: Column, prefix: Column | None = None, levels: int = LEVELS) -> Column:
    """Array of (field_name, field_type, rest) for the fields of a mapping, parents included.

    The tree is walked by one nested expression, so there is no shuffle. A field
    at the last level that has fields of its own comes with its node as ``rest``;
    for all others it is null.
    """
    empty = F.array().cast(FIELD_ROWS)
    nothing = F.lit(None).cast("variant")

    def properties(of: Column) -> Column:
        return F.try_variant_get(of, "$.properties", "map<string,variant>")

    def level(of: Column, prefix: Column | None, depth: int) -> Column:
        def rows(child: Column) -> Column:
            name = child["key"] if prefix is None else F.concat(prefix, F.lit("."), child["key"])
            kind = F.try_variant_get(child["value"], "$.type", "string")
            last = depth == levels
            rest = F.when(F.size(properties(child["value"])) > 0, child["value"]) if last else nothing
            own = F.array(
                F.struct(
                    name.alias("field_name"),
                    F.coalesce(kind, F.lit("object")).alias("field_type"),
                    rest.alias("rest"),
                )
            )
            return own if last else F.concat(own, level(child["value"], name, depth + 1))

        return F.coalesce(F.flatten(F.transform(F.map_entries(properties(of)), rows)), empty)

    return level(node, prefix, 1)


def _is_deeper(levels: int) -> Column:
    """Has the mapping more levels than one pass walks? Walked only where it names so many objects."""
    walked = mapping_fields(F.parse_json("mapping"), levels=levels)
    # a backslash may spell the word otherwise
    objects = F.regexp_count("mapping", F.lit(r'"properties"|\\'))
    return F.when(objects > levels, F.exists(walked, lambda f: f["rest"].isNotNull())).otherwise(False)


def flatten_mappings(
    mapping_docs: DataFrame, levels: int = LEVELS, any_deeper: bool | None = None
) -> DataFrame:
    """(index_name, mapping) to one row per field; an index without fields gives ``_doc``.

    Mappings may be nested to any depth. Starts a job to see whether one has
    more than ``levels`` levels, unless ``any_deeper`` says so. The rare ones
    that have are walked that many levels a pass: each pass writes its fields
    and goes on with those that are not at their end.
    """
    if any_deeper is None:
        any_deeper = not mapping_docs.where(_is_deeper(levels)).isEmpty()
    keep = [c for c in mapping_docs.columns if c != "mapping"]
    if not any_deeper:
        return _fields(mapping_docs, keep, levels).select(*keep, "f.field_name", "f.field_type")
    docs = landed(mapping_docs, "mappings")  # read by both parts
    deeper = F.coalesce(_is_deeper(levels), F.lit(False))
    flat = _fields(docs.where(~deeper), keep, levels).select(*keep, "f.field_name", "f.field_type")
    found = landed(_fields(docs.where(deeper), keep, levels).select(*keep, "f.*"), "mapping-fields")
    while True:
        flat = flat.unionByName(found.select(*keep, "field_name", "field_type"))
        open_nodes = found.where("rest is not null")
        if open_nodes.isEmpty():
            return flat
        below = mapping_fields(F.col("rest"), F.col("field_name"), levels)
        found = landed(open_nodes.select(*keep, F.explode(below).alias("f")).select(*keep, "f.*"), "mapping-fields")


def _fields(mapping_docs: DataFrame, keep: list[str], levels: int) -> DataFrame:
    fields = mapping_fields(F.parse_json("mapping"), levels=levels)
    placeholder = F.array(
        F.struct(
            F.lit("_doc").alias("field_name"),
            F.lit(rules.UNKNOWN_TYPE).alias("field_type"),
            F.lit(None).cast("variant").alias("rest"),
        )
    )
    return mapping_docs.select(*keep, fields.alias("fields")).select(
        *keep,
        F.explode(F.when(F.size("fields") > 0, F.col("fields")).otherwise(placeholder)).alias("f"),
    )


def build_catalog(
    mapping_docs: DataFrame,
    settings: DataFrame,
    stats: DataFrame,
    aliases: DataFrame,
    refreshed_at: Column | None = None,
    levels: int = LEVELS,
) -> DataFrame:
    """Mappings with the settings, stats and aliases of their index.

    The four inputs hold one row per index. They are joined at that size; the
    explosion to fields comes last, so no field row is ever shuffled. Starts a
    job over the mappings alone, see ``flatten_mappings``.
    """
    any_deeper = not skip_system(mapping_docs).where(_is_deeper(levels)).isEmpty()
    per_index = (
        skip_system(mapping_docs)
        .join(settings, "index_name", "left")
        .join(stats, "index_name", "left")
        .join(aliases, "index_name", "left")
        .select(
            "index_name",
            "mapping",
            F.coalesce("settings", F.create_map().cast("map<string,string>")).alias("settings"),
            F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"),
            F.coalesce(F.col("settings.number_of_shards").cast("int"), F.lit(1)).alias(
                "shard_count"
            ),
            F.coalesce(F.col("settings.number_of_replicas").cast("int"), F.lit(1)).alias(
                "replica_count"
            ),
            F.coalesce("doc_count", F.lit(0).cast("bigint")).alias("doc_count"),
            F.coalesce("store_size_bytes", F.lit(0).cast("bigint")).alias("store_size_bytes"),
        )
    )
    refreshed = F.current_timestamp() if refreshed_at is None else refreshed_at
    return flatten_mappings(per_index, levels, any_deeper).select(
        "index_name",
        "field_name",
        "field_type",
        "settings",
        "aliases",
        "shard_count",
        "replica_count",
        "doc_count",
        "store_size_bytes",
        refreshed.cast("timestamp").alias("refreshed_at"),
    )


def write_catalog(catalog: DataFrame, table: str, append: bool = False) -> None:
    """Write a snapshot, or append a dated one (read it back through ``latest``). Starts a job."""
    writer = catalog.write.mode("append" if append else "overwrite").format("parquet")
    if append:
        writer = catalog.withColumn("refreshed_on", F.to_date("refreshed_at")).write
        writer = writer.mode("append").format("parquet").partitionBy("refreshed_on")
    writer.saveAsTable(table)


def latest(catalog: DataFrame) -> DataFrame:
    """Newest row per (index, field); equal times go by type name.

    ``max`` over a struct is merged before the shuffle, so a field refreshed
    very often is no hot spot. Maps cannot be compared and ride along by key.
    """
    keys = ["index_name", "field_name"]
    rest = [c for c in catalog.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct("refreshed_at", "field_type"))
    return catalog.groupBy(*keys).agg(newest.alias("n")).select(*keys, "n.*")


def catalog_like(catalog: DataFrame, glob: str = "*") -> DataFrame:
    """Fields of the indices whose name matches a ``*``/``?`` pattern."""
    return catalog.where(F.col("index_name").like(glob_to_like(glob))).select(
        "index_name", "field_name", "field_type", "settings"
    )


def catalog_summary(catalog: DataFrame) -> DataFrame:
    """Indices and fields written, and when."""
    return catalog.agg(
        F.count_distinct("index_name").alias("indices_indexed"),
        F.count(F.lit(1)).alias("fields_indexed"),
        F.max("refreshed_at").alias("refreshed_at"),
    )
