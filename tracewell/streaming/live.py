"""The batch operators as Structured Streaming queries.

All take a streaming log whose ``ts`` is TIMESTAMP (event-time operators refuse
TIMESTAMP_NTZ; see ``event_time``) and return a streaming DataFrame.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tracewell import rules
from tracewell.functions import statements as st
from tracewell.functions.ledger import is_decision
from tracewell.functions.vectors import EmbedderFactory
from tracewell.operators import diagnosis, knowledge
from tracewell.operators.sizes import MAX_BROADCAST_ROWS, dropped, landed

DELAY = "10 minutes"
SALTS = 16
READ, GIVEN = "rows_read", "rows_given"  # counts in the progress of windowed streams


def read_files(spark: SparkSession, path: str, schema) -> DataFrame:
    """Parquet files as a stream, new files as they arrive.

    ``path`` is a folder or a pattern; a single file is given as a pattern too.
    """
    return spark.readStream.schema(schema).parquet(path)


def event_time(log: DataFrame, column: str = "ts") -> DataFrame:
    return log.withColumn(column, F.col(column).cast("timestamp"))


def slow_statements(
    log: DataFrame,
    length: str = "1 hour",
    slide: str | None = None,
    min_count: int = rules.MIN_COUNT,
    delay: str = DELAY,
    by: tuple[str, ...] = ("statement",),
) -> DataFrame:
    """Mean duration and count per statement and time window (sliding with ``slide``)."""
    windows = F.window("ts", length, slide) if slide else F.window("ts", length)
    stats = (
        log.withWatermark("ts", delay)
        .withColumn("w", windows)
        .observe(READ, F.count(F.lit(1)).alias("n"))
        .groupBy("w", *by)
        .agg(F.avg("duration_ns").alias("avg_duration"), F.count(F.lit(1)).alias("count"))
        .observe(GIVEN, F.sum("count").alias("n"))
    )
    return stats.where(F.col("count") > min_count).select(
        F.col("w.start").alias("window_start"),
        F.col("w.end").alias("window_end"),
        *by,
        "avg_duration",
        "count",
    )


def statement_bursts(
    log: DataFrame, gap: str = "5 minutes", delay: str = DELAY, by: tuple[str, ...] = ("statement",)
) -> DataFrame:
    """Runs of one statement with no pause longer than ``gap``."""
    bursts = (
        log.withWatermark("ts", delay)
        .observe(READ, F.count("ts").alias("n"))
        .groupBy(F.session_window("ts", gap).alias("w"), *by)
        .agg(F.avg("duration_ns").alias("avg_duration"), F.count(F.lit(1)).alias("count"))
        .observe(GIVEN, F.sum("count").alias("n"))
    )
    return bursts.select(
        F.col("w.start").alias("burst_start"),
        F.col("w.end").alias("burst_end"),
        *by,
        "avg_duration",
        "count",
    )


def breaker_alerts(
    metrics: DataFrame,
    length: str = "1 hour",
    threshold_pct: float = rules.BREAKER_USED_PCT,
    delay: str = DELAY,
) -> DataFrame:
    """Nodes near their memory limit, per time window."""
    means = (
        metrics.withWatermark("ts", delay)
        .withColumn("w", F.window("ts", length))
        .observe(READ, F.count(F.lit(1)).alias("n"))
        .groupBy("w", "node")
        .agg(
            F.avg("breaker_used_bytes").alias("avg_used"),
            F.avg("breaker_limit_bytes").alias("avg_limit"),
            F.count(F.lit(1)).alias("rows"),
        )
        .observe(GIVEN, F.sum("rows").alias("n"))
        .withColumn("used_pct", F.try_divide("avg_used", "avg_limit") * 100)
        .where(F.col("used_pct") > threshold_pct)
    )
    return means.select(
        F.col("w.start").alias("window_start"), "node", "avg_used", "avg_limit", "used_pct"
    )


def live_findings(log: DataFrame, facts: diagnosis.Facts) -> DataFrame:
    """One row per finding of each log row, as it arrives; no state.

    ``facts`` is a static table, as measured when the stream was started.
    """
    clause = "struct<field:string,value:string,item:" + diagnosis.ITEM + ">"
    clauses = F.transform(
        st.wildcard_clauses(F.col("statement")),
        lambda c: F.struct(c["field"], c["value"], F.lit(None).cast(diagnosis.ITEM)),
    ).cast(f"array<{clause}>")
    texts = F.transform(
        diagnosis.statement_items(),
        lambda item: F.struct(F.lit(None).cast("string"), F.lit(None).cast("string"), item),
    ).cast(f"array<{clause}>")
    rows = log.select("*", F.explode(F.concat(clauses, texts)).alias("c")).select(
        *log.columns,
        "c.field",
        "c.value",
        F.col("c.item").alias("text_item"),
    )
    known = F.broadcast(facts.rows) if facts.small else facts.rows
    items = F.when(F.col("text_item").isNotNull(), F.array("text_item")).otherwise(
        diagnosis.wildcard_items()
    )
    graded = diagnosis.with_facts(rows, known)
    return graded.select(*log.columns, F.explode(items).alias("item")).select(
        *log.columns, "item.code", "item.field", "item.message", "item.hint"
    )


def findings_of_rows(log: DataFrame, facts: diagnosis.Facts) -> DataFrame:
    """The rows of ``live_findings`` for a batch of the log, with each statement looked at once.

    Starts a job: the findings of the distinct statements are written, and sent to
    the log rows if they are few. Beyond that both are shuffled with a salt, so
    that a statement with a third of all rows is spread.
    """
    keys = list(diagnosis.KEYS)
    distinct = log.select(*keys).distinct()
    found = landed(live_findings(distinct, facts), "batch-findings")
    found = found.select(*(F.col(k).alias(f"_{k}") for k in keys), "code", F.col("field").alias("_field"), "message", "hint")
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    if found.limit(MAX_BROADCAST_ROWS + 1).count() <= MAX_BROADCAST_ROWS:
        joined = log.join(F.broadcast(found), same)
    else:
        simple = [f.name for f in log.schema.fields if f.dataType.typeName() not in ("map", "array", "struct", "variant")]
        salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt")
        salted = log.withColumn("_own", F.pmod(F.xxhash64(*simple), F.lit(SALTS)).cast("int"))
        joined = salted.join(found.select("*", salts), [*same, F.col("_own") == F.col("_salt")])
    return joined.select(*log.columns, "code", F.col("_field").alias("field"), "message", "hint")


def run_live_findings(
    log: DataFrame, facts: Callable[[], diagnosis.Facts], path: str, checkpoint: str
) -> StreamingQuery:
    """Findings of each log row with the facts of the moment; each batch owns one folder.

    ``facts`` is called once per batch and measures anew what is known of the
    fields then, as ``measure_facts`` does; its table is dropped after the batch.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        known = facts()
        findings_of_rows(batch, known).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        dropped(known.rows)

    query = (
        log.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def expiring_approvals(
    requests: DataFrame,
    decisions: DataFrame,
    timeout_seconds: int = rules.APPROVAL_TIMEOUT_SECONDS,
    delay: str = DELAY,
) -> DataFrame:
    """Requests with each decision in time, or ``rejected_timeout`` once it is too late.

    A request with several decisions in time gives several rows; read them
    through ``first_outcomes``.
    """
    asked = requests.withWatermark("ts", delay).alias("r")
    answered = (
        decisions.where(is_decision(F.col("decision"))).withWatermark("decision_ts", delay).alias("d")
    )
    # an interval literal: the planner must see the time bound to drop old state
    limit = F.expr(f"INTERVAL '{int(timeout_seconds)}' SECOND")
    in_time = (
        (F.col("r.approval_id") == F.col("d.approval_id"))
        & (F.col("d.decision_ts") >= F.col("r.ts"))
        & (F.col("d.decision_ts") <= F.col("r.ts") + limit)
    )
    return asked.join(answered, in_time, "left_outer").select(
        "r.*",
        "d.decision_ts",
        F.coalesce("d.decision", F.lit("rejected_timeout")).alias("outcome"),
    )


def first_outcomes(outcomes: DataFrame) -> DataFrame:
    """Landed rows of ``expiring_approvals`` to one per request: its earliest decision."""
    keys = [c for c in outcomes.columns if c not in ("decision_ts", "outcome")]
    first = F.min(F.struct(F.col("decision_ts").isNull().alias("none"), "decision_ts", "outcome"))
    return outcomes.groupBy(*keys).agg(first.alias("f")).select(*keys, "f.outcome")


def run_to_files(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Process what has arrived and stop; rows go to a Parquet folder exactly once."""
    query = (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def run_top_per_window(
    stream: DataFrame, path: str, checkpoint: str, top_n: int = rules.TOP_STATEMENTS
) -> StreamingQuery:
    """Like ``run_to_files`` with only the slowest ``top_n`` statements of each window.

    A window leaves the state in one batch, so it is ranked there. Each batch
    overwrites its own folder, so a batch that is run again does not repeat rows.
    """
    order = Window.partitionBy("window_start", "window_end").orderBy(
        F.col("avg_duration").desc_nulls_first(), "statement"
    )

    def write(batch: DataFrame, batch_id: int) -> None:
        ranked = batch.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_n)
        ranked.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    query = (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def run_knowledge_base(
    pages: DataFrame,
    path: str,
    checkpoint: str,
    factory: EmbedderFactory,
    size: int = rules.CHUNK_SIZE,
    overlap: int = rules.CHUNK_OVERLAP,
) -> None:
    """Chunk and embed pages as they arrive; each batch owns one folder.

    A page without a long chunk leaves a row too (``chunk_idx`` -1, no text), so
    that its older version is known to be outdated. Of several fetches of one
    page in a batch one is taken.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        texts = knowledge.page_texts(batch).dropDuplicates(["url"])
        chunks = knowledge.chunk_texts(texts, size=size, overlap=overlap)
        embedded = knowledge.embed_chunks(chunks, factory)
        seen = texts.select("url", F.lit(-1).alias("chunk_idx"))
        embedded = embedded.unionByName(seen, allowMissingColumns=True)
        embedded.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    query = (
        pages.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def read_incremental_knowledge_base(spark: SparkSession, path: str) -> DataFrame:
    """Chunks of the newest version of each page over all batches."""
    chunks = spark.read.parquet(path)
    newest = chunks.groupBy("url").agg(F.max("batch").alias("batch"))
    chunks = chunks.where("chunk_idx >= 0")
    return chunks.join(newest, ["url", "batch"], "left_semi").drop("batch")
