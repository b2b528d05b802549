"""Views over the given tables in the shape the operators expect.

Each view has a twin of the same name in ``sql.py``. Only whole-number
arithmetic is used to derive values, so both engines get the same ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions.ledger import approval_id

AS_OF = "2024-01-31 00:00:00"  # the instant after the last event

# (index_name, statement), chosen by event_id % 8.
TEMPLATES = [
    ("events", '{"query": {"match": {"event_type": "click"}}}'),
    ("events", '{"query": {"wildcard": {"user_id": {"value": "john*"}}}}'),
    ("events", '{"query": {"wildcard": {"event_id": {"value": "*err*"}}}}'),
    (
        "lineitem",
        '{"query": {"wildcard": {"l_orderkey": {"value": "?7*"}}}, '
        '"aggs": {"by": {"terms": {"field": "l_suppkey"}}}}',
    ),
    (
        "events",
        '{"query": {"nested": {"path": "a", "query": {"nested": {"path": "b", "query": {}}}}}}',
    ),
    (
        "events",
        '{"query": {"script": {"script": {"source": "1"}}}, '
        '"aggs": {"by": {"terms": {"field": "u", "size": 10}}}}',
    ),
    ("events", "CircuitBreakingException: [parent] Data too large"),
    ("customer", '{"query": {"regexp": {"c_name": {"value": "kim.*"}}}}'),
]

# (index_name, field_name, field_type, refreshed_at); one old row is superseded.
CATALOG = [
    ("events", "user_id", "keyword", "2024-01-02"),
    ("events", "event_id", "long", "2023-12-01"),
    ("events", "event_id", "keyword", "2024-01-02"),
    ("events", "event_type", "keyword", "2024-01-02"),
    ("lineitem", "l_orderkey", "keyword", "2024-01-02"),
    ("customer", "c_name", "text", "2024-01-02"),
    ("customer", "c_mktsegment", "wildcard", "2024-01-02"),
]
SEARCHED_FIELDS = {
    "events": ["user_id", "event_id", "event_type"],
    "lineitem": ["l_orderkey"],
    "customer": ["c_name", "c_mktsegment"],
}
SKETCH_DAYS = {"events": "ts", "lineitem": "trunc(l_shipdate, 'MM')"}  # years of rows: one day a month
ACTIONS = [
    "reindex", "query_rewrite", "mapping_change", "scale_node", "new_node", "update_alias", "reboot",
]
PREFIXES = ["https://blog.", "https://www.", "https://m."]
SNAPSHOT_CUTS = ["2024-01-11", "2024-01-21"]
COST_AS_OF = "1998-06-16"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(index: Column, values: list[str]) -> Column:
    """The entry of a short list, by a column that is 0, 1, ..."""
    out = F.lit(values[-1])
    for place, value in list(enumerate(values))[-2::-1]:
        out = F.when(index == place, F.lit(value)).otherwise(out)
    return out


def slowlog_of(events: DataFrame) -> DataFrame:
    """Batch or streaming events as a slow log of eight statements."""
    turn = F.col("event_id") % 8
    return events.select(
        "ts",
        pick(turn, [index for index, _ in TEMPLATES]).alias("index_name"),
        pick(turn, [text for _, text in TEMPLATES]).alias("statement"),
        (F.floor(F.col("value") * 100 + 0.5) * 250_000 * (1 + turn)).alias("duration_ns"),
        "user_id",
    )


def slowlog(spark, sf_dir) -> DataFrame:
    return slowlog_of(table(spark, sf_dir, "events"))


def slowlog_by_user(spark, sf_dir) -> DataFrame:
    """The same log with the user in the text: statements grow with the data."""
    start = '{"query"'
    named = F.concat(
        F.lit('{"from": '), "user_id", F.lit(', "query"'), F.substring("statement", len(start) + 1, 1_000)
    )
    text = F.when(F.col("statement").startswith(start), named).otherwise(F.col("statement"))
    return slowlog(spark, sf_dir).withColumn("statement", text)


def statements(spark, sf_dir) -> DataFrame:
    return slowlog_by_user(spark, sf_dir).select("index_name", "statement").distinct()


def _metric_columns() -> list[Column]:
    node = F.col("l_suppkey") % 6
    return [
        F.col("l_shipdate").alias("ts"),
        F.concat(F.lit("node-"), node.cast("string")).alias("node"),
        (F.col("l_quantity") * 2).alias("cpu_pct"),
        (F.col("l_discount") * 1000).alias("mem_used_pct"),
        F.col("l_extendedprice").alias("disk_read_kb"),
        (F.col("l_extendedprice") * (1 - F.col("l_tax"))).alias("disk_write_kb"),
        (F.col("l_quantity") * 1_000_000).alias("breaker_used_bytes"),
        ((30 + 4 * node) * F.lit(1_000_000.0)).alias("breaker_limit_bytes"),
    ]


def node_metrics_of(lineitem: DataFrame) -> DataFrame:
    return lineitem.select(*_metric_columns())


def node_metrics(spark, sf_dir) -> DataFrame:
    return node_metrics_of(table(spark, sf_dir, "lineitem"))


def metric_files(spark, sf_dir, path: str) -> None:
    """Write ``lineitem`` as metric documents, a folder a month, in four ways of writing them.

    Numbers and ISO times; numbers as text; milliseconds and fields that nobody
    reads; no breaker at all. Line 7 of an order is cut off, line 6 has no node,
    and line 5 no time in months of the second kind.
    """
    items = table(spark, sf_dir, "lineitem")
    flat = node_metrics_of(items).columns
    rows = items.select("*", F.struct(*(c.alias(n) for n, c in zip(flat, _metric_columns(), strict=True))).alias("m"))
    ship = F.col("l_shipdate").cast("date")
    shape = (F.year(ship) * 12 + F.month(ship)) % 4
    text = lambda c: F.when(shape == 1, c.cast("string"))
    number = lambda c: F.when(shape != 1, c)

    def stats(value, breaker):
        m = {name: value(F.col(f"m.{name}")) for name in flat[2:]}
        parent = F.struct(
            m["breaker_used_bytes"].alias("estimated_size_in_bytes"), m["breaker_limit_bytes"].alias("limit_size_in_bytes")
        )
        io = F.struct(m["disk_read_kb"].alias("read_kilobytes"), m["disk_write_kb"].alias("write_kilobytes"))
        return F.struct(
            F.struct(F.struct(m["cpu_pct"].alias("percent")).alias("cpu"), F.struct(m["mem_used_pct"].alias("used_percent")).alias("mem")).alias("os"),
            F.struct(F.struct(io.alias("total")).alias("io_stats")).alias("fs"),
            F.when(breaker, F.struct(parent.alias("parent"))).alias("breakers"),
        )

    def document(time, value, breaker, *more):
        time = F.when((shape != 1) | (F.col("l_linenumber") != 5), time)
        name = F.when(F.col("l_linenumber") != 6, F.col("m.node"))
        node = F.struct(name.alias("name"), stats(value, breaker).alias("stats"))
        return F.to_json(F.struct(time.alias("@timestamp"), F.struct(node.alias("node")).alias("elasticsearch"), *more))

    iso = F.date_format("m.ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    millis = F.unix_millis(F.col("m.ts").cast("timestamp"))
    extra = F.array("l_partkey").alias("host")
    doc = F.when(shape == 1, document(iso, text, F.lit(True))).when(shape == 2, document(millis, number, F.lit(True), extra))
    doc = doc.when(shape == 3, document(iso, number, F.lit(False))).otherwise(document(iso, number, F.lit(True)))
    doc = F.when(F.col("l_linenumber") == 7, F.substring(doc, 1, 60)).otherwise(doc)
    out = rows.select(doc.alias("value"), F.date_format(ship, "yyyy-MM").alias("month"))
    # months in few files each, a hot one in several
    out.hint("rebalance", F.col("month")).write.partitionBy("month").text(path)


def field_catalog(spark, sf_dir=None) -> DataFrame:
    rows = spark.createDataFrame(
        CATALOG, "index_name string, field_name string, field_type string, refreshed_at string"
    )
    return rows.withColumn("refreshed_at", F.to_timestamp("refreshed_at"))


def searched_tables(spark, sf_dir) -> dict[str, DataFrame]:
    return {name: table(spark, sf_dir, name) for name in SEARCHED_FIELDS}


def catalog_history(spark, sf_dir) -> DataFrame:
    """A catalogue refreshed once per event: many versions of each field."""
    kinds = ["keyword", "text", "long", "wildcard"]
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("idx_"), (F.col("user_id") % 50).cast("string")).alias("index_name"),
        F.col("event_type").alias("field_name"),
        pick(F.col("event_id") % 4, kinds).alias("field_type"),
        F.create_map(F.lit("shards"), (F.col("event_id") % 3).cast("string")).alias("settings"),
        F.col("ts").alias("refreshed_at"),
    )


def index_name() -> Column:
    """One index per part; every tenth is a system index."""
    key = F.col("p_partkey").cast("string")
    return F.when(F.col("p_partkey") % 10 == 7, F.concat(F.lit(".sys-"), key)).otherwise(
        F.concat(F.lit("idx-"), key)
    )


def mapping_docs(spark, sf_dir) -> DataFrame:
    """A nested mapping per part: flat, deep, with a field called ``type``, and empty."""
    deep = F.concat(
        F.lit('{"properties": {"a": {"properties": {"b": {"properties": {"'),
        F.lower("p_type"),
        F.lit('": {"type": "keyword"}}}}}}}'),
    )
    named = F.concat(
        F.lit('{"properties": {"type": {"type": "long"}, "size_'),
        F.col("p_size").cast("string"),
        F.lit('": {"type": "integer"}}}'),
    )
    multi = F.concat(
        F.lit('{"properties": {"'),
        F.col("p_brand"),
        F.lit('": {"type": "text", "fields": {"raw": {"type": "keyword"}}}}}'),
    )
    flat = F.lit(
        '{"properties": {"user_id": {"type": "keyword"}, "message": {"type": "text"}, '
        '"event": {"properties": {"duration": {"type": "long"}}}}}'
    )
    turn = F.col("p_partkey") % 5
    mapping = (
        F.when(turn == 0, flat).when(turn == 1, deep).when(turn == 2, named)
        .when(turn == 3, F.lit("{}")).otherwise(multi)
    )
    return table(spark, sf_dir, "part").select(index_name().alias("index_name"), mapping.alias("mapping"))


def index_settings(spark, sf_dir) -> DataFrame:
    part = table(spark, sf_dir, "part").where(F.col("p_brand") != "Brand#1")
    return part.select(
        index_name().alias("index_name"),
        F.create_map(
            F.lit("number_of_shards"), (1 + F.col("p_size") % 5).cast("string"),
            F.lit("number_of_replicas"), (F.col("p_size") % 3).cast("string"),
        ).alias("settings"),
    )


def index_stats(spark, sf_dir) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", index_name().alias("index_name"))
    counted = (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_partkey")
        .agg(
            F.count(F.lit(1)).alias("doc_count"),
            (F.sum(F.col("l_quantity").cast("bigint")) * 1000).alias("store_size_bytes"),
        )
    )
    return part.join(counted, part.p_partkey == counted.l_partkey).select(
        "index_name", "doc_count", "store_size_bytes"
    )


def index_aliases(spark, sf_dir) -> DataFrame:
    part = table(spark, sf_dir, "part").where(F.col("p_type") != "LARGE")
    return part.select(
        index_name().alias("index_name"),
        F.array(F.concat(F.lit("by-"), F.col("p_brand")), F.lower("p_type")).alias("aliases"),
    )


def sitemap(spark, sf_dir) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return pages.select(
        F.explode(F.array(F.lit(0), F.lit(1))).alias("sitemap_seq"),
        F.col("page_id").alias("url_seq"),
        F.col("url").alias("loc"),
    )


def sitemap_files(spark, sf_dir, path: str) -> None:
    """Write the addresses of ``pages`` as a sitemap index and its children, 40 addresses each.

    The index names the children backwards, one of them that does not exist, and
    one that is broken; entries without an address stand between the others.
    """
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    loc = F.replace(F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    entry = F.concat(F.lit("<url><loc>\n "), loc, F.lit(" </loc></url><url><loc> </loc></url>"))
    child = F.floor(F.col("page_id") / 40)
    entries = F.array_sort(F.collect_list(F.struct("page_id", entry.alias("entry"))))
    urlset = F.concat(
        F.lit("<?xml version='1.0' encoding='UTF-8'?><urlset xmlns='http://www.sitemaps.org/schemas/sitemap/0.9'>"),
        F.array_join(F.transform("entries", lambda e: e["entry"]), ""),
        F.when(F.col("child") % 5 == 3, "</broken>").otherwise("</urlset>"),
    )
    name = F.concat(F.lit("map-"), F.col("child").cast("string"), F.lit(".xml"))
    files = pages.groupBy(child.alias("child")).agg(entries.alias("entries")).select(name.alias("name"), urlset.alias("value"))
    files.write.option("lineSep", "\n").partitionBy("name").text(f"{path}/children")
    # an index per 1,000 children, named so that names stand in their order
    listed = pages.select(child.alias("child")).distinct().withColumn("part", F.floor(F.col("child") / 1000))
    place = F.concat(F.lit("<sitemap><loc>https://docs.example/maps/map-"), F.col("child").cast("string"), F.lit(".xml</loc></sitemap>"))
    places = F.array_sort(F.collect_list(F.struct((-F.col("child")).alias("child"), place.alias("place"))))
    index = F.concat(
        F.lit("<sitemapindex><sitemap><loc>https://docs.example/maps/gone.xml</loc></sitemap>"),
        F.array_join(F.transform("places", lambda e: e["place"]), ""),
        F.lit("</sitemapindex>"),
    )
    listed = listed.groupBy("part").agg(places.alias("places"))
    name = F.concat(F.lit("index-"), F.lpad((10**9 - F.col("part")).cast("string"), 10, "0"), F.lit(".xml"))
    listed.select(name.alias("name"), index.alias("value")).write.partitionBy("name").text(f"{path}/index")


def page(pages: DataFrame) -> DataFrame:
    status = F.when(F.col("page_id") % 10 == 9, 404).otherwise(200)
    return pages.select("url", status.alias("status"), "html", "page_id")


def latency_run(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("query"),
        F.when(F.col("event_id") % 2 == 0, "baseline").otherwise("optimized").alias("variant"),
        F.col("event_id").alias("iteration"),
        F.col("value").alias("elapsed_ms"),
    )


def cost_line(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderdate").cast("date").alias("usage_date"),
        pick(F.col("o_custkey") % 3, ["aws", "gcp", "azure"]).alias("provider"),
        F.col("o_totalprice").alias("amount"),
        F.lit("USD").alias("currency"),
    )


def change_of(orders: DataFrame) -> DataFrame:
    return orders.select(
        F.col("o_orderdate").cast("timestamp").alias("ts"),
        pick(F.col("o_orderkey") % 7, ACTIONS).alias("action"),
        F.concat(F.lit("t"), F.col("o_custkey").cast("string")).alias("target"),
        F.concat(F.lit('{"id": '), F.col("o_orderkey").cast("string"), F.lit("}")).alias("payload"),
        F.lit("slow").alias("reason"),
    )


def decision_of(orders: DataFrame) -> DataFrame:
    answered = orders.where(F.col("o_orderstatus") != "O")
    late = F.make_dt_interval(secs=(F.col("o_orderkey") % 600).cast("decimal(18,6)"))
    return answered.select(
        approval_id(
            pick(F.col("o_orderkey") % 7, ACTIONS),
            F.concat(F.lit("t"), F.col("o_custkey").cast("string")),
            F.concat(F.lit('{"id": '), F.col("o_orderkey").cast("string"), F.lit("}")),
        ).alias("approval_id"),
        (F.col("o_orderdate").cast("timestamp") + late).alias("decision_ts"),
        F.when(F.col("o_orderstatus") == "F", "approved").otherwise("rejected").alias("decision"),
    )


def workflow_step_event(spark, sf_dir) -> DataFrame:
    """Steps of a table rewrite per order; six endings in turn."""
    turn = F.col("o_orderkey") % 6

    def event(step: str, status: Column, seconds: Column | int):
        after = F.lit(seconds) if isinstance(seconds, int) else seconds
        return F.struct(
            F.lit(step).alias("step"), status.alias("status"), after.cast("int").alias("seconds")
        )

    ok_a = F.when(turn == 0, "rejected").otherwise("applied")
    ok_b = F.when(turn == 1, "rejected").otherwise("started")
    ok_c = F.when(turn == 3, "rejected").otherwise("applied")
    task_at = F.when(turn == 2, 4000).otherwise(60)
    steps = F.array_compact(F.array(
        event("a", ok_a, 0),
        F.when(turn.isin(1, 2, 3, 4), event("b", ok_b, 10)),
        F.when(turn.isin(2, 3, 4), event("task", F.lit("completed"), task_at + 10)),
        F.when(turn.isin(3, 4), event("c", ok_c, 100)),
    ))
    return (
        table(spark, sf_dir, "orders")
        .select("o_orderkey", "o_orderdate", F.explode(steps).alias("e"))
        .select(
            F.col("o_orderkey").cast("string").alias("workflow_id"),
            "e.step",
            "e.status",
            (
                F.col("o_orderdate").cast("timestamp")
                + F.make_dt_interval(secs=F.col("e.seconds").cast("decimal(18,6)"))
            ).alias("event_ts"),
        )
    )

