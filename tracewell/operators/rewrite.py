"""Copy a table into new column types, and point a name at the copy."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

from tracewell.functions.text import glob_matches, glob_pieces
from tracewell.operators.ranking import numbered_rows
from tracewell.operators.sizes import MAX_BROADCAST_ROWS


GRAM_SIZES = (8, 4, 2, 1)  # characters of an index key: the longest that a pattern's literal text has


def _grams_of_names(names: DataFrame, sizes: Sequence[int]) -> DataFrame:
    """(name, gram): every gram of the given sizes in a name; one that occurs twice is there twice."""
    sized = names.select("name", F.explode(F.array(*map(F.lit, sizes)).cast("array<int>")).alias("n"))
    sized = sized.where(F.length("name") >= F.col("n"))
    placed = sized.select("name", "n", F.explode(F.sequence(F.lit(1), F.length("name") - F.col("n") + 1)).alias("i"))
    return placed.select("name", F.substr("name", F.col("i"), F.col("n")).alias("gram"))


def _with_grams(patterns: DataFrame) -> DataFrame:
    """``patterns`` with the ``size`` of their grams, null without literal text, and all their ``grams``."""
    longest = F.array_max(F.transform("pieces", lambda piece: F.length(piece)))
    size = F.coalesce(*(F.when(longest >= n, F.lit(n)) for n in GRAM_SIZES))

    def grams(piece: Column) -> Column:
        places = F.sequence(F.lit(1), F.length(piece) - F.col("size") + 1)
        cut = F.transform(places, lambda i: F.substr(piece, i, F.col("size")))
        return F.when(F.length(piece) >= F.col("size"), cut).otherwise(F.array().cast("array<string>"))

    sized = patterns.withColumn("size", size)
    return sized.withColumn("grams", F.array_distinct(F.flatten(F.transform("pieces", grams))))


def _under_rarest_gram(names: DataFrame, patterns: DataFrame, sizes: Sequence[int], small: bool) -> DataFrame:
    """``patterns`` with ``gram``, the one of their grams that names hold least often.

    A pattern one of whose grams is in no name can match none and is left out.
    Only grams of patterns are counted; ``small`` tells that they can be broadcast.
    """
    wanted = patterns.select("id", "pattern", F.explode("grams").alias("gram"))
    asked = wanted.select("gram")
    held = _grams_of_names(names, sizes).join(F.broadcast(asked) if small else asked.distinct(), "gram", "left_semi")
    held = held.groupBy("gram").agg(F.count(F.lit(1)).alias("held"))
    # ties go to the same gram on every run
    rarest = wanted.join(held, "gram", "left").groupBy("id", "pattern").agg(
        F.min(F.struct(F.coalesce("held", F.lit(0)).alias("held"), "gram")).alias("key")
    )
    rarest = rarest.where("key.held > 0").select("id", "pattern", F.col("key.gram").alias("gram"))
    return rarest.withColumn("pieces", glob_pieces(F.col("pattern")))


def _best_by_length(names: DataFrame, patterns: DataFrame) -> DataFrame:
    """(name, id): the best of the patterns that hold wildcards only, which ask for a length.

    Names and patterns meet as lengths, of which there are few, so neither is paired with the other.
    """
    least = F.length(F.replace(F.col("pattern"), F.lit("*")))
    asks = patterns.where("size is null").select(
        least.alias("least"), F.contains("pattern", F.lit("*")).alias("open"), "id"
    )
    asks = asks.groupBy("least", "open").agg(F.max("id").alias("id"))
    sized = names.select("name", F.length("name").alias("n"))
    lengths = sized.select("n").distinct()
    fits = (F.col("least") == F.col("n")) | (F.col("open") & (F.col("least") < F.col("n")))
    # one row per length on both sides
    best = lengths.join(F.broadcast(asks), fits).groupBy("n").agg(F.max("id").alias("id"))
    return sized.join(best, "n").select("name", "id")


def match_templates(names: DataFrame, templates: DataFrame) -> DataFrame:
    """Best template per table name: (name, template_name, pattern, priority).

    ``templates`` is (template_name, patterns, priority). Ties of priority go to
    the last template name, then pattern. A match holds every literal piece of
    its pattern, so each pattern is listed under the one of its grams that
    fewest names hold, names look their grams up there, and the glob is tested
    on those pairs alone. Patterns without literal text ask for a length only
    and are met by length. The order of patterns is a number, whose largest is
    kept while the matches are merged: no name gathers its matches.

    Null names and patterns match nothing; a repeated name gives one row. Starts
    jobs on the patterns; the names are read once to count and once to match.
    """
    patterns = templates.select("template_name", "priority", F.explode("patterns").alias("pattern"))
    patterns = patterns.where("pattern is not null").distinct()
    patterns = numbered_rows(patterns, "priority", "template_name", "pattern", name="id")
    patterns = _with_grams(patterns.withColumn("pieces", glob_pieces(F.col("pattern"))))
    seen = patterns.agg(
        F.collect_set("size").alias("sizes"),
        F.coalesce(F.sum(F.size("grams")), F.lit(0)).alias("grams"),
        F.count(F.lit(1)).alias("patterns"),
        F.count_if(F.col("size").isNull()).alias("by_length"),
    ).head()
    few_grams, few = seen.grams <= MAX_BROADCAST_ROWS, seen.patterns <= MAX_BROADCAST_ROWS
    names = names.select("name").where("name is not null")
    keyed = _under_rarest_gram(names, patterns, sorted(seen.sizes), few_grams)
    names = names.distinct()
    # cheap and needed for a match, so few pairs come to the regex
    holds_pieces = F.forall("pieces", lambda piece: F.contains(F.col("name"), piece))
    best = (
        _grams_of_names(names, sorted(seen.sizes))
        .join(F.broadcast(keyed) if few else keyed, "gram")
        .where(holds_pieces)
        .where(glob_matches(F.col("name"), F.col("pattern")))
        .select("name", "id")
    )
    if seen.by_length:
        best = best.unionAll(_best_by_length(names, patterns))
    best = best.groupBy("name").agg(F.max("id").alias("id"))
    kept = patterns.select("id", "template_name", "pattern", "priority")
    return best.join(F.broadcast(kept) if few else kept, "id").drop("id")


def apply_mapping(
    table: DataFrame, types: Mapping[str, str], renames: Mapping[str, str] | None = None
) -> DataFrame:
    """Cast columns to the types of a mapping; columns it does not name are kept."""
    renames = renames or {}
    return table.select(
        *(
            (F.col(c).cast(types[c]) if c in types else F.col(c)).alias(renames.get(c, c))
            for c in table.columns
        )
    )


def rewrite(
    source: DataFrame,
    types: Mapping[str, str],
    where: Column | str | None = None,
    renames: Mapping[str, str] | None = None,
) -> DataFrame:
    """Rows of ``source`` that pass the filter, in the new types."""
    if where is not None:
        source = source.where(where)
    return apply_mapping(source, types, renames)


def write_rewritten(
    rows: DataFrame, table: str, partition_by: tuple[str, ...] = (), path: str | None = None
) -> int:
    """Write a new table and return its row count; fails if the name is taken.

    Starts jobs. The rebalance hint lets AQE cut a hot partition value into
    several evenly sized files. With ``path`` the files lie there and outlive
    the table's name.
    """
    if partition_by:
        rows = rows.hint("rebalance", *(F.col(c) for c in partition_by))
    writer = rows.write.mode("errorifexists").format("parquet")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if path:
        writer = writer.option("path", path)
    writer.saveAsTable(table)
    return rows.sparkSession.table(table).count()


class CopyMismatch(ValueError):
    """A copy that does not hold the rows of its source."""


def _hashable(column: Column, kind: DataType) -> Column:
    """A map as its sorted entries, wherever it is nested: maps have no hash."""
    if isinstance(kind, MapType):
        entries = F.transform(
            F.map_entries(column),
            lambda e: F.struct(
                _hashable(e["key"], kind.keyType).alias("key"),
                _hashable(e["value"], kind.valueType).alias("value"),
            ),
        )
        return F.array_sort(entries)
    if isinstance(kind, ArrayType):
        return F.transform(column, lambda x: _hashable(x, kind.elementType))
    if isinstance(kind, StructType) and kind.fields:
        parts = (_hashable(column.getField(f.name), f.dataType).alias(f.name) for f in kind.fields)
        return F.when(column.isNotNull(), F.struct(*parts))
    return column


def fingerprint(rows: DataFrame) -> DataFrame:
    """(rows, hash_xor, hash_sum): one row that does not depend on the order of rows.

    Equal rows cancel out in the xor, but not in the sum. Only a row of numbers
    leaves a task. A null and an empty value hash alike in places, so whether each
    column is null is hashed too.
    """
    columns = [F.col(f"`{f.name}`") for f in rows.schema.fields]
    values = [_hashable(c, f.dataType) for c, f in zip(columns, rows.schema.fields, strict=True)]
    digest = F.xxhash64(*values, *(c.isNull() for c in columns)) if values else F.lit(0).cast("bigint")
    return rows.select(digest.alias("h")).agg(
        F.count(F.lit(1)).alias("rows"),
        F.coalesce(F.bit_xor("h"), F.lit(0).cast("bigint")).alias("hash_xor"),
        F.coalesce(F.sum(F.col("h").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).alias("hash_sum"),
    )


def prove_copy(rows: DataFrame, table: str) -> int:
    """Compare ``rows`` with the table they were written to, by fingerprint; returns their count.

    Both are read in full. Raises ``CopyMismatch`` where rows are missing, there
    twice or changed, where the source gives other rows when it is read again,
    or where columns differ. Partition columns may have moved.
    """
    copy = rows.sparkSession.table(table)
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    if {f.name: f.dataType for f in copy.schema.fields} != kinds:
        raise CopyMismatch(f"{table}: columns {copy.dtypes} are not {rows.dtypes}")
    source, target = fingerprint(rows), fingerprint(copy.select(*(f"`{c}`" for c in rows.columns)))
    want, got = source.head(), target.head()
    if want != got:
        raise CopyMismatch(f"{table}: copied {got.rows} rows of {want.rows}, {got} is not {want}")
    return got.rows


def swap_alias(spark: SparkSession, alias: str, table: str) -> None:
    """Point the view ``alias`` at ``table``: one metadata change, old target dropped with it."""
    spark.sql(f"CREATE OR REPLACE VIEW {alias} AS SELECT * FROM {table}")
