"""Plain SQL twins of the registered queries, for another engine to check them.

Written from the rules, not from the Spark plans: where the operators use
look-ahead regexes, structs or sketches, this uses splits, joins and ranks.
"""

from __future__ import annotations

from tracewell import rules
from workload import views


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def case(index: str, values: list[str]) -> str:
    arms = " ".join(f"WHEN {place} THEN {q(value)}" for place, value in enumerate(values))
    return f"CASE {index} {arms} END"


# --- views -----------------------------------------------------------------

SLOWLOG = f"""slowlog AS (
  SELECT ts, user_id,
    {case("event_id % 8", [index for index, _ in views.TEMPLATES])} AS index_name,
    {case("event_id % 8", [text for _, text in views.TEMPLATES])} AS statement,
    CAST(floor(value * 100 + 0.5::DOUBLE) AS BIGINT) * 250000 * (1 + event_id % 8) AS duration_ns
  FROM events)"""
BY_USER = f"""{SLOWLOG}, log AS (
  SELECT ts, index_name, duration_ns, user_id,
    CASE WHEN starts_with(statement, '{{"query"')
      THEN '{{"from": ' || user_id || ', "query"' || substr(statement, 9) ELSE statement END AS statement
  FROM slowlog)"""
STATEMENTS = f"{BY_USER}, st AS (SELECT DISTINCT index_name, statement FROM log)"
METRICS = """metrics AS (
  SELECT l_shipdate AS ts, 'node-' || (l_suppkey % 6) AS node, l_quantity * 2 AS cpu_pct,
    l_discount * 1000 AS mem_used_pct, l_extendedprice AS disk_read_kb,
    l_extendedprice * (1 - l_tax) AS disk_write_kb, l_quantity * 1000000 AS breaker_used_bytes,
    (30 + 4 * (l_suppkey % 6)) * 1000000.0::DOUBLE AS breaker_limit_bytes
  FROM lineitem)"""
CATALOG = (
    "catalog AS (SELECT index_name, field_name, field_type FROM (VALUES "
    + ", ".join(f"({q(a)}, {q(b)}, {q(c)}, {q(d)})" for a, b, c, d in views.CATALOG)
    + """) AS v(index_name, field_name, field_type, refreshed)
  QUALIFY row_number() OVER (PARTITION BY index_name, field_name ORDER BY refreshed DESC) = 1)"""
)
HISTORY = """history AS (
  SELECT 'idx_' || (user_id % 50) AS index_name, event_type AS field_name,
    CASE event_id % 4 WHEN 0 THEN 'keyword' WHEN 1 THEN 'text' WHEN 2 THEN 'long' ELSE 'wildcard' END
      AS field_type,
    CAST(event_id % 3 AS VARCHAR) AS shards, ts AS refreshed_at
  FROM events)"""
CARDINALITY = (
    "cards AS ("
    + " UNION ALL ".join(
        f"SELECT '{table}' AS index_name, '{field}' AS field_name, "
        f"count(DISTINCT {field}) AS cardinality FROM {table}"
        for table, fields in views.SEARCHED_FIELDS.items()
        for field in fields
    )
    + ")"
)
INDICES = """indices AS (
  SELECT p.*, CASE WHEN p_partkey % 10 = 7 THEN '.sys-' ELSE 'idx-' END || p_partkey AS index_name
  FROM part p)"""
# The fields each kind of mapping must flatten to.
FIELDS = """fields AS (
  SELECT index_name, p_partkey, f.field_name, f.field_type FROM (
    SELECT index_name, p_partkey, unnest(CASE p_partkey % 5
      WHEN 0 THEN [{'field_name': 'user_id', 'field_type': 'keyword'},
                   {'field_name': 'message', 'field_type': 'text'},
                   {'field_name': 'event', 'field_type': 'object'},
                   {'field_name': 'event.duration', 'field_type': 'long'}]
      WHEN 1 THEN [{'field_name': 'a', 'field_type': 'object'},
                   {'field_name': 'a.b', 'field_type': 'object'},
                   {'field_name': 'a.b.' || lower(p_type), 'field_type': 'keyword'}]
      WHEN 2 THEN [{'field_name': 'type', 'field_type': 'long'},
                   {'field_name': 'size_' || p_size, 'field_type': 'integer'}]
      WHEN 3 THEN [{'field_name': '_doc', 'field_type': 'unknown'}]
      ELSE [{'field_name': p_brand, 'field_type': 'text'}] END) AS f
    FROM indices WHERE index_name NOT LIKE '.%'))"""
URLS = """urls AS (
  SELECT s.seq AS sitemap_seq, page_id AS url_seq, url FROM pages, (VALUES (0), (1)) AS s(seq)
  WHERE starts_with(url, 'https://blog.') OR starts_with(url, 'https://www.')
     OR starts_with(url, 'https://m.'))"""
COST = """cost AS (
  SELECT CAST(o_orderdate AS DATE) AS usage_date,
    CASE o_custkey % 3 WHEN 0 THEN 'aws' WHEN 1 THEN 'gcp' ELSE 'azure' END AS provider,
    o_totalprice AS amount, 'USD' AS currency FROM orders)"""
REQUESTS = f"""requests AS (
  SELECT *, substr(sha256(action || target || payload), 1, 12) AS approval_id FROM (
    SELECT o_orderkey, o_orderstatus, o_orderdate AS ts,
      {case("o_orderkey % 7", views.ACTIONS)} AS action, 't' || o_custkey AS target,
      '{{"id": ' || o_orderkey || '}}' AS payload
    FROM orders))"""
# Orders have one decision at most, after o_orderkey % 600 seconds.
RESOLVED = f"""{REQUESTS}, resolved AS (
  SELECT *, CASE WHEN o_orderstatus = 'F' AND o_orderkey % 600 <= 300 THEN 'approved'
                 WHEN o_orderstatus = 'P' AND o_orderkey % 600 <= 300 THEN 'rejected'
                 ELSE 'rejected_timeout' END AS outcome
  FROM requests)"""
RUNS = """runs AS (
  SELECT event_type AS query, CASE WHEN event_id % 2 = 0 THEN 'baseline' ELSE 'optimized' END
    AS variant, value AS elapsed_ms FROM events)"""

# --- statement rules -------------------------------------------------------

WILD = q(rules.WILDCARD_CLAUSE)
CLAUSES = f"""clauses AS (
  SELECT index_name, statement, unnest(regexp_extract_all(statement, {WILD}, 1, 'i')) AS field,
    unnest(regexp_extract_all(statement, {WILD}, 2, 'i')) AS value
  FROM st), facts AS (
  SELECT c.*, left(value, 1) IN ('*', '?') AS is_leading,
    coalesce(t.field_type, 'unknown') AS field_type, coalesce(k.cardinality, 0) AS cardinality
  FROM clauses c
  LEFT JOIN catalog t ON t.index_name = c.index_name AND t.field_name = c.field
  LEFT JOIN cards k ON k.index_name = c.index_name AND k.field_name = c.field)"""
BREAKER = (
    "(statement ILIKE '%CircuitBreakingException%' OR statement ILIKE "
    "'%circuit$_breaking$_exception%' ESCAPE '$' OR statement ILIKE '%Data too large%')"
)
UNBOUNDED = (
    "len(list_filter(regexp_split_to_array(statement, '\"terms\"\\s*:\\s*\\{')[2:], "
    "lambda p: contains(p, '}') AND NOT contains(split_part(p, '}', 1), '\"size\"'))) > 0"
)
NESTED = "len(regexp_extract_all(statement, '\"nested\"', 0, 'i'))"


def clause_test(word: str) -> str:
    return f"regexp_matches(statement, '\"{word}\"\\s*:\\s*\\{{', 'i')"


def message(code: str) -> str:
    """SQL that fills the places of a fixed text from columns of the same name."""
    out = q(rules.MESSAGES[code])
    for place, column in (("field", "field"), ("type", "field_type"), ("value", "value"),
                          ("cardinality", "CAST(cardinality AS VARCHAR)")):
        out = f"replace({out}, '{{{place}}}', {column})"
    return out


WILDCARD_HITS = f"""hits AS (
  SELECT *, 1 AS place, 'leading_wildcard' AS code, {message(rules.LEADING)} AS message,
    {q(rules.SEARCH_HINTS[rules.LEADING].replace("{type}", ""))} || field_type AS hint
  FROM facts WHERE is_leading
  UNION ALL
  SELECT *, 2, 'high_cardinality_wildcard', {message(rules.HIGH_CARD)},
    {q(rules.SEARCH_HINTS[rules.HIGH_CARD])}
  FROM facts WHERE cardinality > 1000
  UNION ALL
  SELECT *, 3, 'trigram_candidate', {message(rules.TRIGRAM)}, {q(rules.SEARCH_HINTS[rules.TRIGRAM])}
  FROM facts WHERE cardinality > 10000 AND field_type IN ('keyword', 'text'))"""
TEXT_HITS = " UNION ALL ".join(
    f"SELECT index_name, statement, {place} AS place, '{code}' AS code, "
    f"{q(rules.SEARCH_HINTS[code])} AS hint FROM st WHERE {test}"
    for place, code, test in (
        (4, rules.BREAKER, BREAKER),
        (5, rules.UNBOUNDED, UNBOUNDED),
        (6, rules.NESTING, f"{NESTED} >= 2"),
        (7, rules.SCRIPT, clause_test("script")),
        (8, rules.REGEXP, clause_test("regexp")),
    )
)


def findings(log: str, min_count: int) -> str:
    """CTEs from a log to ``found``, one row per statement."""
    return f"""{log}, stats AS (
  SELECT index_name, statement, avg(duration_ns) AS avg_duration, count(*) AS count
  FROM {"log" if log is BY_USER else "slowlog"} WHERE ts >= TIMESTAMP '2024-01-01 00:00:00'
  GROUP BY ALL HAVING count(*) > {min_count}),
st AS (SELECT index_name, statement FROM stats), {CATALOG}, {CARDINALITY}, {CLAUSES}, {WILDCARD_HITS},
allhits AS (SELECT index_name, statement, place, code, hint FROM hits UNION ALL {TEXT_HITS}),
per AS (
  SELECT index_name, statement, string_agg(code, ',' ORDER BY place) AS codes, count(*) AS n,
    bool_or(code = 'circuit_breaker') AS broke,
    list_sort(list_distinct(list(hint))) AS hints
  FROM allhits GROUP BY ALL),
named AS (
  SELECT index_name, statement, list_sort(list_distinct(list(field))) AS fields,
    list_sort(list_distinct(list(field || '=' || field_type))) AS types
  FROM facts GROUP BY ALL),
found AS (
  SELECT s.index_name, s.statement, round(avg_duration, 4) AS avg_duration, s.count,
    coalesce(codes, '') AS codes,
    coalesce(array_to_string(fields, ','), '') AS affected_fields,
    coalesce(array_to_string(types, ','), '') AS field_types,
    CASE WHEN n IS NULL THEN 'low'
      WHEN broke OR avg_duration / 1000000 > 10000 THEN 'critical'
      WHEN avg_duration / 1000000 > 5000 OR n >= 3 THEN 'high'
      WHEN avg_duration / 1000000 > 2000 OR n >= 2 THEN 'medium' ELSE 'low' END AS severity,
    hints, coalesce(array_to_string(hints, '|'), '') AS recommended_searches
  FROM stats s LEFT JOIN per USING (index_name, statement)
  LEFT JOIN named USING (index_name, statement))"""


FOUND = findings(SLOWLOG, 100)
FOUND_BY_USER = findings(BY_USER, 0)
FOUND_COLUMNS = (
    "index_name, statement, avg_duration, count, codes, affected_fields, field_types, severity, "
    "recommended_searches"
)


def texts(test: str, extra: str = "") -> str:
    return f"WITH {STATEMENTS} SELECT index_name, statement{extra} FROM st WHERE {test}"


# --- pages -----------------------------------------------------------------

SPACE = (
    r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
)
STRIPPED = (
    "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, "
    "'<style[^>]*>.*?</style>', '', 'gs'), '<script[^>]*>.*?</script>', '', 'gs'), "
    f"'<[^>]+>', ' ', 'g'), '{SPACE}', ' ', 'g'))"
)
BLANKS = q(rules.WHITESPACE_CHARS)
TITLE = (
    "CASE WHEN regexp_matches(html, '(?i)<title>(.*?)</title>') THEN "
    f"trim(regexp_extract(html, '(?i)<title>(.*?)</title>', 1), {BLANKS}) ELSE 'Untitled' END"
)


def chunks(source: str, keys: str) -> str:
    return f"""chunks AS (SELECT {keys}, start // 450 AS chunk_idx, substr(whole, start + 1, 500) AS text
  FROM (SELECT {keys}, whole, unnest(range(0, length(whole), 450)) AS start FROM {source})
  WHERE length(trim(substr(whole, start + 1, 500), {BLANKS})) > 50)"""


PAGE_TEXTS = f"""texts AS (
  SELECT url, {TITLE} AS title, {STRIPPED} AS whole FROM pages WHERE page_id % 10 <> 9)"""

TOPK = """WITH places AS (
  SELECT label, vec_id, generate_subscripts(embedding, 1) AS place, unnest(embedding)::DOUBLE AS x
  FROM embeddings),
means AS (SELECT label, place, avg(x) AS m FROM places GROUP BY ALL),
scores AS (
  SELECT m.label AS query_id, p.vec_id AS id, round(sum(p.x * m.m), 9) AS score
  FROM places p JOIN means m ON m.place = p.place GROUP BY ALL),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM scores)
SELECT query_id, rank, id, round(score, 4) AS score FROM ranked WHERE rank <= 5"""

# --- streams: the batch answer over what a stream has closed ----------------


def windowed(length: str, closed_after: str) -> str:
    return f"""SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, statement, count(*) AS count,
    round(avg(duration_ns), 4) AS avg_duration,
    w + INTERVAL {closed_after} <= (SELECT max(ts) FROM slowlog) - INTERVAL 10 MINUTE AS final
  FROM ({length}) GROUP BY w, statement"""


SLIDES = " UNION ALL ".join(
    f"SELECT *, time_bucket(INTERVAL 10 MINUTE, ts) - INTERVAL {10 * back} MINUTE AS w FROM slowlog"
    for back in range(6)
)

ORACLE = {
    "slowest_statements": f"""WITH {SLOWLOG} SELECT statement, count(*) AS count,
        round(avg(duration_ns), 4) AS avg_duration FROM slowlog
      WHERE ts >= TIMESTAMP '2024-01-17 00:00:00' GROUP BY statement HAVING count(*) > 100
      ORDER BY avg(duration_ns) DESC, statement LIMIT 5""",
    "slowest_by_index": f"""WITH {BY_USER} SELECT index_name, statement, count(*) AS count,
        round(avg(duration_ns), 4) AS avg_duration FROM log
      WHERE ts >= TIMESTAMP '2024-01-01 00:00:00' GROUP BY index_name, statement
      ORDER BY avg(duration_ns) DESC, index_name, statement LIMIT 25""",
    "node_metrics": f"""WITH {METRICS} SELECT node, round(avg(cpu_pct), 4) AS avg_cpu,
        round(avg(mem_used_pct), 4) AS avg_mem_used,
        round(avg(disk_read_kb), 4) AS avg_disk_io_read,
        round(avg(disk_write_kb), 4) AS avg_disk_io_write
      FROM metrics WHERE ts >= TIMESTAMP '1999-01-01' - INTERVAL 1000 DAY GROUP BY node""",
    "breaker_hot_nodes": f"""WITH {METRICS}, m AS (SELECT node, avg(breaker_used_bytes) AS u,
        avg(breaker_limit_bytes) AS l FROM metrics GROUP BY node)
      SELECT node, round(u, 4) AS avg_used, round(l, 4) AS avg_limit,
        round(u / l * 100, 4) AS used_pct FROM m WHERE u / l * 100 > 70""",
    "metric_documents": """WITH m AS (
        SELECT strftime(l_shipdate, '%Y-%m') AS month, l_linenumber AS line, l_shipdate AS ts,
          (year(l_shipdate) * 12 + month(l_shipdate)) % 4 AS shape, 'node-' || (l_suppkey % 6) AS node,
          l_quantity * 2 AS cpu, l_extendedprice * (1 - l_tax) AS write, l_quantity * 1000000 AS used
        FROM lineitem)
      SELECT month, CASE WHEN line < 6 THEN node END AS node, count(*) AS documents,
        count(*) FILTER (line = 7) AS unreadable, count(*) FILTER (line = 5 AND shape = 1) AS no_time,
        count(*) FILTER (line = 6) AS no_node,
        strftime(max(ts) FILTER (line < 7 AND (line <> 5 OR shape <> 1)), '%Y-%m-%d') AS last_day,
        sum(cpu) FILTER (line < 7) AS sum_cpu, round(sum(write) FILTER (line < 7), 4) AS sum_write,
        sum(used) FILTER (line < 7 AND shape <> 3) AS sum_used
      FROM m GROUP BY ALL""",
    "source_coverage": """WITH seen AS (
        SELECT 'slowlog' AS source, count(*) AS n, min(ts) AS lo, max(ts) AS hi FROM events
        UNION ALL SELECT 'catalog', count(*), min(ts), max(ts) FROM events
        UNION ALL SELECT 'node_metrics', count(*), min(l_shipdate), max(l_shipdate) FROM lineitem
        UNION ALL SELECT 'audit', 0, NULL, NULL)
      SELECT source, n > 0 AS present, n AS row_count,
        strftime(lo, '%Y-%m-%d %H:%M:%S') AS earliest_ts,
        strftime(hi, '%Y-%m-%d %H:%M:%S') AS latest_ts FROM seen""",
    "field_cardinality_approx": f"""WITH {CARDINALITY} SELECT index_name, field_name,
        cardinality AS exact, true AS within_5_percent FROM cards""",
    "field_cardinality_exact": f"WITH {CARDINALITY} SELECT * FROM cards",
    "catalog_like": f"""WITH {HISTORY} SELECT index_name, field_name, field_type, shards
      FROM history WHERE index_name LIKE 'idx$_1%' ESCAPE '$'""",
    "catalog_latest": f"""WITH {HISTORY} SELECT index_name, field_name, field_type, shards
      FROM history QUALIFY row_number() OVER (PARTITION BY index_name, field_name
        ORDER BY refreshed_at DESC, field_type DESC) = 1""",
    "catalog_snapshots": f"""WITH {HISTORY} SELECT index_name, field_name, field_type, shards,
        strftime(refreshed_at, '%Y-%m-%d') AS refreshed_on
      FROM history QUALIFY row_number() OVER (PARTITION BY index_name, field_name
        ORDER BY refreshed_at DESC, field_type DESC) = 1""",
    "catalog_flatten": f"""WITH {INDICES}, {FIELDS}
      SELECT index_name, field_name, field_type FROM fields""",
    "catalog_enriched": f"""WITH {INDICES}, {FIELDS}, stats AS (
        SELECT l_partkey, count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) * 1000 AS BIGINT) AS b
        FROM lineitem GROUP BY l_partkey)
      SELECT f.index_name, f.field_name, f.field_type,
        CASE WHEN p_type <> 'LARGE' THEN
          array_to_string(list_sort(['by-' || p_brand, lower(p_type)]), ',') ELSE '' END AS aliases,
        CAST(CASE WHEN p_brand <> 'Brand#1' THEN 1 + p_size % 5 ELSE 1 END AS INTEGER) AS shard_count,
        CAST(CASE WHEN p_brand <> 'Brand#1' THEN p_size % 3 ELSE 1 END AS INTEGER) AS replica_count,
        coalesce(s.n, 0) AS doc_count, coalesce(s.b, 0) AS store_size_bytes
      FROM fields f JOIN indices i USING (index_name) LEFT JOIN stats s ON s.l_partkey = i.p_partkey""",
    "catalog_summary": f"""WITH {INDICES}, {FIELDS} SELECT count(DISTINCT index_name) AS
      indices_indexed, count(*) AS fields_indexed FROM fields""",
    "wildcard_clauses": f"""WITH {STATEMENTS}, {CATALOG}, {CARDINALITY}, {CLAUSES}
      SELECT index_name, statement, field, value, is_leading FROM facts""",
    "wildcard_findings": f"""WITH {STATEMENTS}, {CATALOG}, {CARDINALITY}, {CLAUSES}, {WILDCARD_HITS}
      SELECT index_name, statement, field, field_type, cardinality, code, message FROM hits""",
    "breaker_text": texts(BREAKER),
    "unbounded_terms": texts(UNBOUNDED),
    "nested_clauses": texts(f"{NESTED} >= 2", f", {NESTED} AS nested_count"),
    "script_clauses": texts(clause_test("script")),
    "regexp_clauses": texts(clause_test("regexp")),
    "fuzzy_clauses": texts(clause_test("fuzzy")),
    "statement_findings": f"WITH {FOUND} SELECT {FOUND_COLUMNS} FROM found",
    "statement_findings_by_user": f"WITH {FOUND_BY_USER} SELECT {FOUND_COLUMNS} FROM found",
    "severity_summary": f"""WITH {FOUND_BY_USER} SELECT count(*) AS findings_count,
      count(*) FILTER (severity = 'critical') AS critical_count,
      count(*) FILTER (severity = 'high') AS high_count FROM found""",
    "recommended_searches": f"""WITH {FOUND_BY_USER}
      SELECT DISTINCT search FROM (SELECT unnest(hints) AS search FROM found)""",
    "page_text": f"SELECT page_id, {STRIPPED} AS text FROM pages",
    "page_title": f"SELECT page_id, {TITLE} AS title FROM pages",
    "page_chunks": f"""WITH {PAGE_TEXTS}, {chunks("texts", "url, title")}
      SELECT url, title, chunk_idx, text FROM chunks""",
    "doc_chunks": f"""WITH texts AS (SELECT doc_id, text AS whole FROM documents),
      {chunks("texts", "doc_id")} SELECT doc_id, chunk_idx, text FROM chunks""",
    "url_discovery": f"""WITH {URLS}
      SELECT url, CAST(sitemap_seq AS BIGINT) AS sitemap_seq, url_seq FROM urls
      QUALIFY row_number() OVER (PARTITION BY url ORDER BY sitemap_seq, url_seq) = 1""",
    "sitemap_urls": """WITH c AS (
        SELECT url, page_id // 40 AS child, row_number() OVER (PARTITION BY page_id // 40 ORDER BY page_id) - 1 AS place
        FROM pages),
      i AS (SELECT child, row_number() OVER (ORDER BY child DESC) AS sitemap_seq FROM (SELECT DISTINCT child FROM c)),
      u AS (
        SELECT url, sitemap_seq, 2 * place AS url_seq FROM c JOIN i USING (child)
        WHERE child % 5 <> 3 AND (starts_with(url, 'https://blog.') OR starts_with(url, 'https://www.')
          OR starts_with(url, 'https://m.'))
        QUALIFY row_number() OVER (PARTITION BY url ORDER BY sitemap_seq, place) = 1)
      SELECT *, row_number() OVER (ORDER BY sitemap_seq, url_seq) AS position FROM u""",
    "kb_summary": f"""WITH {URLS}, {PAGE_TEXTS}, {chunks("texts", "url")}, n AS (
        SELECT (SELECT count(DISTINCT url) FROM urls) AS url_count,
          (SELECT count(*) FROM chunks WHERE url IN (SELECT url FROM urls)) AS chunk_count)
      SELECT *, CASE WHEN url_count = 0 THEN 'no_urls_discovered' ELSE 'indexed' END AS status FROM n""",
    "vector_normalize": """WITH n AS (
        SELECT vec_id, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS u
        FROM embeddings)
      SELECT vec_id, round(3 * u, 4) AS norm_before,
        CASE WHEN u > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS norm_after FROM n""",
    "vector_topk": TOPK,
    "vector_topk_tiled": TOPK,
    "latency_stats": f"""WITH {RUNS}, ranked AS (
        SELECT *, row_number() OVER (PARTITION BY query, variant ORDER BY elapsed_ms) AS place,
          count(*) OVER (PARTITION BY query, variant) AS n FROM runs)
      SELECT query, variant, min(elapsed_ms) AS min_ms, max(elapsed_ms) AS max_ms,
        max(elapsed_ms) FILTER (place = CAST(floor(n * 0.95::DOUBLE) AS BIGINT) + 1) AS p95_ms,
        count(*) AS iterations, round(avg(elapsed_ms), 4) AS avg_ms
      FROM ranked GROUP BY query, variant""",
    "latency_compare": f"""WITH {RUNS}, m AS (
        SELECT query, avg(elapsed_ms) FILTER (variant = 'baseline') AS b,
          avg(elapsed_ms) FILTER (variant = 'optimized') AS o FROM runs GROUP BY query)
      SELECT query, round(b, 4) AS baseline_avg_ms, round(o, 4) AS optimized_avg_ms,
        CASE WHEN b > 0 THEN round((b - o) / b * 100, 2) ELSE 0 END AS improvement_pct,
        b > 0 AND (b - o) / b * 100 > 0 AS improvement_confirmed FROM m""",
    "cost_mtd_projection": f"""WITH {COST}, s AS (
        SELECT provider, currency, coalesce(sum(amount) FILTER (
          usage_date >= DATE '1998-06-01' AND usage_date < DATE '1998-06-16'), 0) AS mtd
        FROM cost GROUP BY provider, currency)
      SELECT provider, currency, round(mtd, 2) AS month_to_date_cost,
        round(mtd / 16 * 30, 6) AS projected_monthly_cost FROM s""",
    "cost_decisions": f"""WITH {REQUESTS}, c AS (
        SELECT action, payload, action IN ('scale_node', 'new_node') AS scaling,
          action IN ('reindex', 'query_rewrite', 'mapping_change') AS free FROM requests)
      SELECT action, payload, NOT scaling AS proceed,
        CASE WHEN free THEN 'Proposed action ''' || action || ''' costs $0.00/mo. Scaling a node '
            || 'costs $200.00/mo. Estimated monthly savings by optimizing instead of scaling: '
            || '$200.00. Proceeding with the optimization.'
          WHEN scaling THEN 'Scaling costs $200.00/mo. Query and mapping optimizations should be '
            || 'exhausted first before scaling.'
          ELSE 'No cost constraint identified for action ''' || action || '''.' END AS reason,
        CASE WHEN scaling THEN 200.0::DOUBLE ELSE 0.0::DOUBLE END AS cost_of_action_monthly,
        200.0::DOUBLE AS cost_of_scaling_monthly,
        CASE WHEN scaling THEN 0.0::DOUBLE ELSE 200.0::DOUBLE END AS projected_monthly_savings
      FROM c""",
    "approval_ids": f"WITH {REQUESTS} SELECT approval_id, action, target, payload FROM requests",
    "pending_approvals": f"""WITH {REQUESTS} SELECT approval_id, action, target, payload
      FROM requests WHERE o_orderstatus = 'O'""",
    "approval_resolved": f"WITH {RESOLVED} SELECT approval_id, payload, outcome FROM resolved",
    "action_tally": f"""WITH {RESOLVED} SELECT action AS tool, outcome AS result_status,
      count(*) AS actions FROM resolved GROUP BY ALL""",
    "workflow_status": """SELECT CAST(o_orderkey AS VARCHAR) AS workflow_id, CASE o_orderkey % 6
        WHEN 0 THEN 'halted_at_step_a' WHEN 1 THEN 'halted_at_step_b' WHEN 2 THEN 'reindex_timeout'
        WHEN 3 THEN 'halted_at_step_c' WHEN 4 THEN 'completed' ELSE 'incomplete' END
      AS overall_status FROM orders""",
    "conversation_outcome": """WITH c AS (
        SELECT conv_id, count(*) FILTER (role = 'assistant') AS rounds,
          arg_max(role, turn) AS last_role FROM conversations GROUP BY conv_id)
      SELECT conv_id, rounds, CASE WHEN rounds >= 3 THEN 'max_rounds_reached'
        WHEN last_role = 'assistant' THEN 'completed' ELSE 'running' END AS status FROM c""",
    "table_rewrite": """SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey,
        CAST(o_custkey AS INTEGER) AS o_custkey, o_orderstatus, o_totalprice,
        strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, o_orderpriority AS priority
      FROM orders WHERE o_orderstatus <> 'P'""",
    "table_rewrite_swapped": """SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey,
        CAST(o_custkey AS INTEGER) AS o_custkey, o_orderstatus, o_totalprice,
        strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, o_orderpriority AS priority
      FROM orders WHERE o_orderstatus <> 'F'""",
    "template_match": """WITH names AS (
        SELECT 'logs-' || lower(p_type) || '-' || lower(p_brand) || '-' || p_partkey AS name FROM part),
      templates AS (
        SELECT DISTINCT 't-' || lower(p_type) AS template_name, 10 AS priority,
          'logs-' || lower(p_type) || '-*' AS pattern FROM part
        UNION ALL SELECT DISTINCT 'b-' || lower(p_brand), 20, 'logs-s*-' || lower(p_brand) || '-1?'
        FROM part
        UNION ALL SELECT DISTINCT 'b-' || lower(p_brand), 20, '*-' || lower(p_brand) || '-?7'
        FROM part)
      SELECT DISTINCT name, template_name, pattern FROM names JOIN templates
        ON name LIKE replace(replace(pattern, '*', '%'), '?', '_')
      QUALIFY row_number() OVER (PARTITION BY name
        ORDER BY priority DESC, template_name DESC, pattern DESC) = 1""",
    "stream_hourly_slow": f"""WITH {SLOWLOG}
      {windowed("SELECT *, date_trunc('hour', ts) AS w FROM slowlog", "1 HOUR")}""",
    "stream_sliding_slow": f"WITH {SLOWLOG} {windowed(SLIDES, '1 HOUR')}",
    "stream_top_per_day": f"""WITH {SLOWLOG}, d AS (
        SELECT date_trunc('day', ts) AS w, statement, count(*) AS count, avg(duration_ns) AS a
        FROM slowlog GROUP BY ALL)
      SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, row_number() OVER (
          PARTITION BY w ORDER BY a DESC, statement) AS rank, statement, count,
        w + INTERVAL 1 DAY <= (SELECT max(ts) FROM slowlog) - INTERVAL 10 MINUTE AS final
      FROM d QUALIFY rank <= 5""",
    "stream_breaker_alert": f"""WITH {METRICS}, d AS (
        SELECT date_trunc('day', ts) AS w, node, avg(breaker_used_bytes) AS u,
          avg(breaker_limit_bytes) AS l FROM metrics GROUP BY ALL)
      SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, node, round(u, 4) AS avg_used,
        round(l, 4) AS avg_limit, round(u / l * 100, 4) AS used_pct,
        w + INTERVAL 1 DAY <= (SELECT max(ts) FROM metrics) - INTERVAL 10 MINUTE AS final FROM d
      WHERE u / l * 100 > 70""",
    "stream_findings": f"""WITH {SLOWLOG}, st AS (SELECT DISTINCT index_name, statement FROM slowlog),
      {CATALOG}, {CARDINALITY}, {CLAUSES}, {WILDCARD_HITS}, allhits AS (
        SELECT index_name, statement, code, field, message FROM hits UNION ALL
        SELECT index_name, statement, code, '', CASE code
          {" ".join(f"WHEN '{c}' THEN {q(rules.MESSAGES[c].replace('{count}', '2'))}" for c in
                    (rules.BREAKER, rules.UNBOUNDED, rules.NESTING, rules.SCRIPT, rules.REGEXP))}
          END FROM ({TEXT_HITS}))
      SELECT user_id, statement, code, field, message
      FROM slowlog JOIN allhits USING (index_name, statement)""",
    "stream_findings_fresh": f"""WITH {SLOWLOG}, st AS (SELECT DISTINCT index_name, statement FROM slowlog),
      {CATALOG}, {CARDINALITY}, {CLAUSES}, {WILDCARD_HITS}, allhits AS (
        SELECT index_name, statement, code, field, message FROM hits UNION ALL
        SELECT index_name, statement, code, '', CASE code
          {" ".join(f"WHEN '{c}' THEN {q(rules.MESSAGES[c].replace('{count}', '2'))}" for c in
                    (rules.BREAKER, rules.UNBOUNDED, rules.NESTING, rules.SCRIPT, rules.REGEXP))}
          END FROM ({TEXT_HITS}))
      SELECT user_id, statement, code, field
      FROM slowlog JOIN allhits USING (index_name, statement)""",
    # a timeout that cannot have passed yet is not decided
    "stream_approvals": f"""WITH {RESOLVED} SELECT approval_id, payload, outcome FROM resolved
      WHERE outcome <> 'rejected_timeout' OR ts + INTERVAL 300 SECOND < (
        SELECT least(max(ts), max(ts + to_seconds(o_orderkey % 600)) FILTER (o_orderstatus <> 'O'))
        FROM requests) - INTERVAL 10 MINUTE""",
    "stream_approval_outcomes": f"""WITH {RESOLVED} SELECT approval_id, payload,
        CASE WHEN outcome = 'rejected_timeout' AND ts + INTERVAL 300 SECOND > (
          SELECT greatest(max(ts), max(ts + to_seconds(o_orderkey % 600)) FILTER (o_orderstatus <> 'O')) FROM requests)
          THEN 'open' ELSE outcome END AS outcome FROM resolved""",
    "stream_bursts": f"""WITH {SLOWLOG}, g AS (
        SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY statement ORDER BY ts)
          + INTERVAL 5 MINUTE THEN 0 ELSE 1 END AS fresh FROM slowlog),
      b AS (SELECT *, sum(fresh) OVER (PARTITION BY statement ORDER BY ts
          ROWS UNBOUNDED PRECEDING) AS burst FROM g)
      SELECT strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS burst_start, statement, count(*) AS count,
        round(avg(duration_ns), 4) AS avg_duration,
        max(ts) + INTERVAL 5 MINUTE <= (SELECT max(ts) FROM slowlog) - INTERVAL 10 MINUTE AS final
      FROM b GROUP BY statement, burst""",
    "stream_knowledge_base": f"""WITH {PAGE_TEXTS}, {chunks("texts", "url, title")}
      SELECT url, title, chunk_idx, text FROM chunks""",
}
