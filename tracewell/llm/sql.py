"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

import string

from tracewell.llm import licenses, mixing

_LOWER = f"'{string.ascii_uppercase}', '{string.ascii_lowercase}'"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _canonical(text: str) -> str:
    out = f"lower({text})"
    out = f"regexp_replace({out}, {_quoted(licenses.COPYRIGHT_LINE)}, '', 'g')"
    out = f"(' ' || trim(regexp_replace({out}, {_quoted(licenses.PUNCTUATION)}, '  ', 'g')) || ' ')"
    for one, other in licenses.SPELLINGS:
        one, other = one.replace(" ", "  "), other.replace(" ", "  ")
        out = f"replace({out}, {_quoted(f' {one} ')}, {_quoted(f' {other} ')})"
    return f"nullif(trim({out}), '')"


_KNOWN = ", ".join(f"({_quoted(name)}, {_quoted(text)})" for name, text in licenses.KNOWN)

EXACT_DEDUP = f"""
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), {_LOWER})) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY ALL)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
"""

WARC_REVISITS = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
  FROM pages),
f AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id,
    count(*) OVER (PARTITION BY payload_digest) AS copies
  FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM f
"""

SOURCE_MIXING = f"""
WITH d AS (
  SELECT doc_id, source, md5('{mixing.SEED}|' || coalesce(doc_id::VARCHAR, '')) AS digest,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
  FROM d GROUP BY source),
w AS (
  SELECT *, row_number() OVER (ORDER BY 3.0 * source_size / weight, source NULLS LAST) AS place, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER before, 0))::DOUBLE
    / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
  FROM s WINDOW before AS (ORDER BY 3.0 * source_size / weight, source NULLS LAST
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT coalesce(arg_min(level, place) FILTER (level * weight <= 3 * source_size), 0.0) AS water FROM w),
t AS (
  SELECT source, source_size,
    round(CASE WHEN water * weight > 3 * source_size THEN 3.0::DOUBLE * source_size ELSE water * weight END, 6) AS target
  FROM w, l),
p AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t),
c AS (
  SELECT d.doc_id, d.size, p.source_size, p.target, p.whole,
    round(p.target)::BIGINT - p.whole * p.source_size AS rest,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.digest, d.doc_id, d.size
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
  (whole * size + greatest(0, least(size, rest - before)))::BIGINT AS taken
FROM c
"""

LICENSE_SCAN = f"""
WITH k AS (
  SELECT sha256({_canonical("t")}) AS digest, min(license) AS license FROM (VALUES {_KNOWN}) AS v(license, t) GROUP BY 1),
u AS (
  SELECT doc_id, -1 AS line_no, text AS part FROM documents
  UNION ALL
  SELECT doc_id, unnest(range(len(lines))) AS line_no, unnest(lines) AS part
  FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE contains(text, chr(10)))),
c AS (SELECT doc_id, line_no, sha256({_canonical("part")}) AS digest FROM u)
SELECT doc_id, line_no::INTEGER AS line_no, license, digest FROM c JOIN k USING (digest)
"""

FILTER_AUDIT = """
WITH o AS (
  SELECT a || b || c || d || e AS filter_order FROM (SELECT unnest(string_split('ABCDE', '')) AS a)
  JOIN (SELECT unnest(string_split('ABCDE', '')) AS b) ON b <> a
  JOIN (SELECT unnest(string_split('ABCDE', '')) AS c) ON c NOT IN (a, b)
  JOIN (SELECT unnest(string_split('ABCDE', '')) AS d) ON d NOT IN (a, b, c)
  JOIN (SELECT unnest(string_split('ABCDE', '')) AS e) ON e NOT IN (a, b, c, d)),
s AS (
  SELECT filter_order, step, substr(filter_order, step, 1) AS f, left(filter_order, step - 1) AS before
  FROM o, (SELECT unnest(range(1, 6)) AS step)),
d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
j AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    CASE WHEN len(w) < 200 THEN 'A' ELSE '' END
    || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
    || CASE WHEN 100 * (len(t) - len(regexp_replace(t, '[A-Z]', '', 'g'))) > 3 * len(t) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS failed
  FROM d LEFT JOIN l USING (doc_id)),
c AS (
  SELECT part, failed, count(*) AS n, count_if(good) AS n_good, count_if(toxic) AS n_toxic FROM j GROUP BY ALL),
r AS (
  SELECT part, filter_order, step, f, n, n_good, n_toxic, contains(failed, f) AS fails, failed = f AS alone,
    translate(failed, before, '') <> failed AS gone
  FROM c, s),
a AS (
  SELECT part, filter_order, step, f,
    coalesce(sum(n) FILTER (NOT fails AND NOT gone), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (fails AND NOT gone), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (fails AND gone), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (alone), 0)::BIGINT AS unique_fails,
    coalesce(sum(n_good) FILTER (fails AND NOT gone), 0)::BIGINT AS good_lost,
    coalesce(sum(n_toxic) FILTER (fails AND NOT gone), 0)::BIGINT AS toxic_lost
  FROM r GROUP BY ALL)
SELECT part, filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM a
"""


def _merkle(levels: int = 13, top: int = 5) -> str:
    """The tree level by level; a source of one node passes through. 3 ** 13 rows a source, 3 ** 5 sources."""
    text = "replace(text, chr(10), '')"

    def field(x):
        return f"coalesce(strlen({x}::VARCHAR)::VARCHAR || ':' || {x}::VARCHAR, '-')"

    def leaf(t):
        return "sha256(" + " || ".join(map(field, ("doc_id", "source", "lang", "n_chars", t))) + ")"

    crc = (
        "list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), "
        "lambda a, c: list_reduce(list_prepend(xor(a, c), range(8)), "
        "lambda v, k: xor(v // 2, CASE WHEN v % 2 = 1 THEN 3988292384 ELSE 0 END)))"
    )

    def level(k, name):
        """Node k of each row, the nodes of its run, and the next node."""
        return f"""
{name}n{k} AS (SELECT g, i{k} AS i, any_value(h{k}) AS h, count(*) OVER (PARTITION BY g) AS size FROM {name}{k} GROUP BY g, i{k}),
{name}r{k} AS (SELECT g, i // 3 AS q, list(h ORDER BY i) AS run FROM {name}n{k} WHERE size > 1 GROUP BY ALL),
{name}{k + 1} AS (
  SELECT w.* REPLACE (proof || coalesce(array_to_string(list_filter(run, lambda x, j: j <> i{k} % 3 + 1), ''), '') AS proof),
    i{k} // 3 AS i{k + 1}, CASE WHEN run IS NULL THEN h{k} ELSE sha256(array_to_string(run, '')) END AS h{k + 1},
    CASE WHEN run IS NULL THEN f{k} ELSE sha256(array_to_string(list_transform(run, lambda x, j: CASE WHEN j = i{k} % 3 + 1 THEN f{k} ELSE x END), '')) END AS f{k + 1}
  FROM {name}{k} w LEFT JOIN {name}r{k} r ON w.g = r.g AND w.i{k} // 3 = r.q)"""

    low = ",".join(level(k, "s") for k in range(levels))
    high = ",".join(level(k, "t") for k in range(top))
    return f"""
WITH d AS (
  SELECT doc_id, source, {leaf("text")} AS leaf,
    CASE WHEN xor({crc}, 4294967295) % 2 = 0 THEN {leaf(text)} ELSE {leaf("text")} END AS claim
  FROM documents),
s0 AS (
  SELECT doc_id, leaf, dense_rank() OVER (ORDER BY source NULLS FIRST) AS g, '' AS proof,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, claim) - 1 AS i0, leaf AS h0, claim AS f0
  FROM d),{low},
t0 AS (
  SELECT doc_id, leaf, 0 AS g, proof, h{levels} AS subroot, g - 1 AS i0, h{levels} AS h0, f{levels} AS f0 FROM s{levels}),{high}
SELECT doc_id, leaf, subroot, h{top} AS root, sha256(proof) AS proof_sha256, f{top} AS folded_root, f{top} = h{top} AS verified
FROM t{top}
"""


ORACLE = {
    "op2_exact_dedup": EXACT_DEDUP,
    "op4_warc_revisits": WARC_REVISITS,
    "op7_source_mixing": SOURCE_MIXING,
    "op8_license_scan": LICENSE_SCAN,
    "op11_filter_audit": FILTER_AUDIT,
    "op12_merkle_manifest": _merkle(),
}
