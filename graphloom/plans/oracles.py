"""DuckDB SQL for the engine's queries, written from the definitions and not from the plans."""

from __future__ import annotations

RAW = """raw AS (
  SELECT o_custkey::INT AS src, (1000000 + l_suppkey)::INT AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  UNION ALL SELECT (1000000 + l_suppkey)::INT, (2000000 + l_partkey)::INT FROM lineitem)"""
HOPS = "raw AS (SELECT src, dst FROM (SELECT user_id::INT AS src, lead(user_id) OVER (ORDER BY ts, event_id)::INT AS dst FROM events) WHERE dst IS NOT NULL)"
COMPACT = """e AS (SELECT DISTINCT src, dst FROM raw),
v AS (SELECT vid, (row_number() OVER (ORDER BY vid) - 1)::INT AS idx FROM (SELECT src AS vid FROM e UNION SELECT dst FROM e)),
c AS MATERIALIZED (SELECT d.idx AS dst_idx, s.idx AS src_idx FROM e JOIN v s ON s.vid = e.src JOIN v d ON d.vid = e.dst),
ind AS (SELECT idx, coalesce(n, 0)::BIGINT AS degree FROM v LEFT JOIN (SELECT dst_idx, count(*) AS n FROM c GROUP BY 1) ON dst_idx = idx),
outd AS MATERIALIZED (SELECT idx, coalesce(n, 0)::BIGINT AS degree FROM v LEFT JOIN (SELECT src_idx, count(*) AS n FROM c GROUP BY 1) ON src_idx = idx),
k AS (SELECT count(*)::DOUBLE AS n FROM v)"""
SUPPLY = f"WITH {RAW}, {COMPACT}"
HOPS_GRAPH = f"WITH {HOPS}, {COMPACT}"

OFFSETS = "off AS (SELECT idx, degree, coalesce(sum(degree) OVER (ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS edge_begin FROM ind)"
SLICES = """hub AS (SELECT 2 AS tag, idx::BIGINT AS a, b::BIGINT AS b, ((degree + 63) // 64)::BIGINT AS c, (edge_begin + 64 * b)::BIGINT AS edge_begin, least(64, degree - 64 * b)::BIGINT AS edge_count
  FROM off, LATERAL (SELECT unnest(range(0, (degree + 63) // 64)) AS b) WHERE degree > 64)"""
#: One destination a step; ``first`` is where the open task begins.
PACKED = """walk(idx, first, vertices, edges, hub) AS (
  SELECT -1::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, true
  UNION ALL
  SELECT w.idx + 1,
    CASE WHEN o.degree > 64 THEN w.idx + 2 WHEN w.hub OR w.vertices = 16 OR w.edges + o.degree > 256 THEN w.idx + 1 ELSE w.first END,
    CASE WHEN o.degree > 64 THEN 0 WHEN w.hub OR w.vertices = 16 OR w.edges + o.degree > 256 THEN 1 ELSE w.vertices + 1 END,
    CASE WHEN o.degree > 64 THEN 0 WHEN w.hub OR w.vertices = 16 OR w.edges + o.degree > 256 THEN o.degree ELSE w.edges + o.degree END,
    o.degree > 64
  FROM walk w JOIN off o ON o.idx = w.idx + 1),
packed AS (SELECT 1 AS tag, first AS a, max(vertices) AS b, 0::BIGINT AS c, edge_begin, max(edges) AS edge_count
  FROM walk JOIN off ON off.idx = first WHERE NOT hub GROUP BY first, edge_begin),
tasks AS (SELECT tag, a, b, c, edge_begin, edge_count FROM packed UNION ALL SELECT * FROM hub)"""
TASKS = f"WITH RECURSIVE {RAW}, {COMPACT}, {OFFSETS}, {SLICES}, {PACKED}"


def _steps(count: int) -> str:
    """s0 .. s<count>: states; m<k>: masses of step k; every step a table of its own."""
    parts = ["s0 AS MATERIALIZED (SELECT idx, degree AS d, 1.0::DOUBLE / n AS r FROM outd, k)"]
    for i in range(1, count + 1):
        p = f"s{i - 1}"
        parts.append(f"b{i} AS MATERIALIZED (SELECT (1 - 0.85::DOUBLE) / n + 0.85::DOUBLE * (SELECT coalesce(sum(r) FILTER (WHERE d = 0), 0) FROM {p}) / n AS base FROM k)")
        parts.append(f"x{i} AS MATERIALIZED (SELECT dst_idx, sum(r / d) AS g FROM c JOIN {p} ON idx = src_idx GROUP BY 1)")
        parts.append(f"t{i} AS MATERIALIZED (SELECT idx, d, r AS old, base + 0.85::DOUBLE * coalesce(g, 0) AS cand FROM {p} LEFT JOIN x{i} ON dst_idx = idx, b{i})")
        parts.append(f"m{i} AS MATERIALIZED (SELECT sum(cand) AS mass FROM t{i})")
        parts.append(f"s{i} AS MATERIALIZED (SELECT idx, d, cand / mass AS r FROM t{i}, m{i})")
    return ",\n".join(parts)


ONE = f"{SUPPLY}, {_steps(1)}"
TWO = f"{SUPPLY}, {_steps(2)}"
TWENTY = f"{SUPPLY}, {_steps(20)}"
#: Enough steps for the supply graph at every scale that is traced; the first accepted one is taken.
MOST = 45


def _converged() -> str:
    parts = [f"{SUPPLY}, {_steps(MOST + 1)}"]
    # the residual of state i is the distance of step i + 1's candidates, before normalisation, to state i
    rows = " UNION ALL ".join(f"SELECT {i} AS i, (SELECT sum(abs(cand / mass - old)) FROM t{i}, m{i}) AS delta, (SELECT sum(abs(cand - old)) FROM t{i + 1}) AS residual" for i in range(1, MOST + 1))
    parts.append(f"trace AS MATERIALIZED ({rows})")
    parts.append("checked AS (SELECT *, 0.85::DOUBLE * delta + 0.85::DOUBLE * 1e-8::DOUBLE <= 1e-8::DOUBLE AS looked FROM trace)")
    parts.append("done AS MATERIALIZED (SELECT min(i) AS i FROM checked WHERE looked AND residual + 1.0::DOUBLE / 1073741824 + 0.85::DOUBLE * 1e-8::DOUBLE <= 1e-8::DOUBLE)")
    states = " UNION ALL ".join(f"SELECT {i} AS i, idx, r FROM s{i}" for i in range(1, MOST + 1))
    parts.append(f"states AS ({states})")
    return ",\n".join(parts)


CONVERGED = _converged()
_REDUCED = """
SELECT s::INT AS src, (CASE WHEN o = 1 AND s BETWEEN 25 AND 45 THEN 0 WHEN o = 1 AND s BETWEEN 46 AND 50 THEN 1 WHEN o = 1 AND s BETWEEN 51 AND 55 THEN 2 ELSE (s + o) % 101 END)::INT AS dst
FROM range(0, 101) a(s), range(1, 5) b(o) WHERE NOT (o = 4 AND s < 21)
UNION ALL SELECT 100, x::INT FROM range(4, 25) h(x)"""
_SKEW = """g AS (SELECT s::INT AS src, (CASE WHEN o = 1 AND s BETWEEN 50000 AND 99949 THEN 0 WHEN o = 1 AND s BETWEEN 99950 AND 116284 THEN 1 WHEN o = 1 AND s BETWEEN 116285 AND 132619 THEN 2 ELSE (s + o) % 1000000 END)::INT AS dst
FROM range(0, 1000000) a(s), range(1, 51) b(o) WHERE NOT (o = 50 AND s < 49950)
UNION ALL SELECT 999999, x::INT FROM range(50, 50000) h(x))"""



def _invariants(vertices: str, edges: str, in_degrees: str, out_degrees: str) -> str:
    """name, violations: each counted from the tables."""
    n, e = f"(SELECT count(*) FROM {vertices})", f"(SELECT count(*) FROM {edges})"
    counts = {
        "ids_ascending": f"SELECT count(*) FROM {vertices} a JOIN {vertices} b ON b.idx = a.idx + 1 WHERE a.vid >= b.vid",
        "ids_dense": f"SELECT count(*) FILTER (idx < 0 OR idx >= {n}) + count(*) - count(DISTINCT idx) FROM {vertices}",
        "edge_ends_in_range": f"SELECT count(*) FROM {edges} WHERE least(dst_idx, src_idx) < 0 OR greatest(dst_idx, src_idx) >= {n}",
        "edges_unique": f"SELECT count(*) FROM (SELECT 1 FROM {edges} GROUP BY dst_idx, src_idx HAVING count(*) > 1)",
        "in_degree_range": f"SELECT count(*) FROM {in_degrees} WHERE degree > {n}",
        "out_degree_range": f"SELECT count(*) FROM {out_degrees} WHERE degree > {n}",
        "in_degree_sum": f"SELECT abs(sum(degree) - {e}) FROM {in_degrees}",
        "out_degree_sum": f"SELECT abs(sum(degree) - {e}) FROM {out_degrees}",
    }
    return " UNION ALL ".join(f"SELECT '{name}' AS name, ({sql})::BIGINT AS violations" for name, sql in counts.items())


def _validation(tasks: str, vertices: int) -> str:
    """name, violations of tasks under limits of 64, 256 and ``vertices``: each counted from the tables."""
    return f"""later AS (SELECT *, lead(tag) OVER w AS next_tag, lead(a) OVER w AS next_a, lead(edge_begin) OVER w AS next_begin FROM {tasks} WINDOW w AS (ORDER BY a, CASE tag WHEN 2 THEN b ELSE 0 END)),
  near AS (SELECT later.*, degree AS next_degree FROM later LEFT JOIN ind ON ind.idx = next_a)
  SELECT 'edge_gaps' AS name, count(*) FILTER (next_begin <> edge_begin + edge_count) AS violations FROM near
  UNION ALL SELECT 'destination_gaps', count(*) FILTER (next_a <> CASE WHEN tag = 1 THEN a + b WHEN b + 1 = c THEN a + 1 ELSE a END) FROM near
  UNION ALL SELECT 'early_ends', count(*) FILTER (tag = 1 AND next_tag = 1 AND b < {vertices} AND edge_count + next_degree <= 256) FROM near
  UNION ALL SELECT 'limits', count(*) FILTER (CASE WHEN tag = 1 THEN b > {vertices} OR edge_count > 256 AND b > 1 ELSE edge_count > 64 END) FROM near"""


ORACLES: dict[str, str] = {
    "endpoint_explode": f"WITH {RAW} SELECT vid, count(*) AS n FROM (SELECT src AS vid FROM raw UNION ALL SELECT dst FROM raw) GROUP BY 1",
    "distinct_vertices": f"WITH {RAW} SELECT src AS vid FROM raw UNION SELECT dst FROM raw",
    "distinct_edges": f"WITH {RAW} SELECT DISTINCT src, dst FROM raw",
    "compact_vertex_ids": f"{SUPPLY} SELECT vid, idx FROM v",
    "compact_edges": f"{SUPPLY} SELECT dst_idx, src_idx FROM c",
    "dictionary_misses": f"WITH {RAW} SELECT DISTINCT vid FROM (SELECT src AS vid FROM raw UNION ALL SELECT dst FROM raw) WHERE vid BETWEEN 1000000 AND 1999999",
    "sorted_in_edges": f"{SUPPLY} SELECT dst_idx, src_idx, row_number() OVER (ORDER BY dst_idx, src_idx) - 1 AS place FROM c",
    "duplicate_summary": f"{SUPPLY} SELECT (SELECT count(*) FROM raw) AS input_edges, (SELECT count(*) FROM e) AS unique_edges, (SELECT count(*) FROM raw) - (SELECT count(*) FROM e) AS duplicate_edges",
    "self_loops": f"WITH {HOPS} SELECT DISTINCT src, dst FROM raw WHERE src = dst",
    "in_degree": f"{SUPPLY} SELECT idx, degree FROM ind",
    "out_degree": f"{SUPPLY} SELECT idx, degree FROM outd",
    "out_degree_audit": f"{SUPPLY} SELECT idx, degree + 1 AS stored, degree AS counted FROM outd WHERE idx % 10 = 0",
    "degree_histogram_in": f"{SUPPLY} SELECT degree, count(*) AS vertices FROM ind GROUP BY 1",
    "degree_histogram_out": f"{SUPPLY} SELECT degree, count(*) AS vertices FROM outd GROUP BY 1",
    "degree_statistics": f"{SUPPLY} " + " UNION ALL ".join(f"SELECT '{d}' AS direction, min(degree) AS least, max(degree) AS most, round(sum(degree)::DOUBLE / count(*), 10) AS mean, sum(degree)::BIGINT AS edges FROM {d}d" for d in ("in", "out")),
    "dangling_vertices": f"{SUPPLY} SELECT idx FROM outd WHERE degree = 0",
    "hub_vertices": f"{SUPPLY} SELECT idx, degree FROM ind WHERE degree > 64",
    "graph_invariants": f"{SUPPLY} {_invariants('v', 'c', 'ind', 'outd')}",
    "graph_invariants_broken": f"""{SUPPLY}, bv AS (SELECT vid - CASE WHEN idx % 40 = 7 THEN 10000000 ELSE 0 END AS vid, idx FROM v WHERE idx % 100 <> 99), bc AS (SELECT dst_idx, src_idx FROM c
  UNION ALL SELECT dst_idx, src_idx FROM c WHERE dst_idx % 50 = 0 UNION ALL SELECT dst_idx + (SELECT count(*) FROM v), src_idx FROM c WHERE src_idx % 70 = 1),
  bi AS (SELECT degree + CASE WHEN idx % 10 = 0 THEN (SELECT count(*) FROM v) ELSE 0 END AS degree FROM ind), bo AS (SELECT degree + CASE WHEN idx % 30 = 0 THEN (SELECT count(*) FROM v) ELSE 0 END AS degree FROM outd)
  {_invariants('bv', 'bc', 'bi', 'bo')}""",
    "graph_manifest": f"""{SUPPLY} SELECT (SELECT count(*) FROM v) AS vertex_count, (SELECT count(*) FROM c) AS edge_count, 64::BIGINT AS edge_slice_size, 256::BIGINT AS max_task_edges, 16::BIGINT AS max_task_vertices,
  'removed' AS duplicate_edges, 'preserved' AS self_loops, 'signed-int32-ascending' AS vertex_ids""",
    "int32_domain_filter": r"""WITH t AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN (o_orderkey * 1000003 - 2147483648)::VARCHAR WHEN 1 THEN '0' || o_orderkey WHEN 2 THEN '-' || o_orderkey ELSE o_orderkey || ' ' END AS value FROM orders)
  SELECT o_orderkey, value, regexp_full_match(value, '0|-?[1-9][0-9]*') AND coalesce(TRY_CAST(value AS HUGEINT) BETWEEN -2147483648 AND 2147483647, false) AS ok FROM t""",
    "hub_slices": f"{SUPPLY}, {OFFSETS}, {SLICES} SELECT * FROM hub",
    "task_partition": f"{TASKS} SELECT * FROM tasks",
    "task_summary": f"""{TASKS} SELECT count(*) AS tasks, count(*) FILTER (tag = 1) AS ordinary, count(*) FILTER (tag = 2) AS slices,
  (coalesce(sum(b) FILTER (tag = 1), 0) + count(*) FILTER (tag = 2 AND b = 0))::BIGINT AS destinations, sum(edge_count)::BIGINT AS edges FROM tasks""",
    "task_validation": f"{TASKS}, {_validation('tasks', 16)}",
    "task_validation_broken": f"""{TASKS.replace("vertices = 16", "vertices = 4")},
  bad AS (SELECT tag, a, b, c, edge_begin, edge_count + CASE WHEN edge_begin % 13 = 0 THEN 1 ELSE 0 END AS edge_count FROM tasks WHERE edge_begin % 11 <> 3), {_validation('bad', 3)}""",
    "slice_histogram": f"{SUPPLY} SELECT ((degree + 63) // 64)::BIGINT AS slices, count(*) AS vertices FROM ind GROUP BY 1",
    "contribution": f"{ONE} SELECT idx, round(r / d, 12) AS contribution FROM s1 WHERE d > 0",
    "dangling_mass": f"{ONE} SELECT round(coalesce(sum(r) FILTER (d = 0), 0), 10) AS dangling FROM s1",
    "gather_sum": f"{ONE} SELECT dst_idx AS idx, round(sum(r / d), 10) AS gathered FROM c JOIN s1 ON idx = src_idx GROUP BY 1",
    "hub_slice_partials": f"""{ONE}, p AS (SELECT dst_idx, src_idx, (row_number() OVER (PARTITION BY dst_idx ORDER BY src_idx) - 1) // 64 AS slice FROM c SEMI JOIN (SELECT idx FROM ind WHERE degree > 64) h ON h.idx = dst_idx)
  SELECT dst_idx AS idx, slice, round(sum(r / d), 10) AS partial FROM p JOIN s1 ON s1.idx = src_idx GROUP BY 1, 2""",
    "pagerank_step": f"{TWO} SELECT idx, round(cand, 10) AS candidate FROM t2",
    "raw_mass": f"{TWO} SELECT round(mass, 10) AS raw_mass FROM m2",
    "delta_l1": f"{TWO} SELECT round(sum(abs(cand / mass - old)), 10) AS delta_l1 FROM t2, m2",
    "true_residual": f"{TWO} SELECT round(sum(abs(cand - old)), 10) AS residual_l1 FROM t2",
    "rank_domain_check": f"{SUPPLY} SELECT count(*) AS invalid FROM v WHERE idx % 7 = 0",
    "decode_vertex_ids": f"{ONE} SELECT vid AS vertex, round(r, 10) AS rank FROM s1 JOIN v USING (idx)",
    "pagerank_k20": f"{TWENTY} SELECT vid AS vertex, round(r, 10) AS rank FROM s20 JOIN v USING (idx)",
    "pagerank_k20_join": f"{HOPS_GRAPH}, {_steps(20)} SELECT vid AS vertex, round(r, 10) AS rank FROM s20 JOIN v USING (idx)",
    "pagerank_trace": f"{TWENTY} " + " UNION ALL ".join(f"SELECT {i} AS iteration, round((SELECT mass FROM m{i}), 10) AS raw_mass, round((SELECT sum(abs(cand / mass - old)) FROM t{i}, m{i}), 10) AS delta_l1" for i in range(1, 21)),
    "pagerank_converged": f"{CONVERGED} SELECT vid AS vertex, round(r, 10) AS rank FROM states JOIN done USING (i) JOIN v USING (idx)",
    "pagerank_report": f"""{CONVERGED}, masses AS ({" UNION ALL ".join(f"SELECT {i} AS i, mass FROM m{i}" for i in range(1, MOST + 1))}) SELECT 'converged' AS status, i::INT AS iterations, (SELECT count(*) FROM checked c WHERE looked AND c.i <= done.i)::INT AS residual_checks,
  (SELECT count(*) FROM v) AS vertex_count, residual + 1.0::DOUBLE / 1073741824 + 0.85::DOUBLE * 1e-8::DOUBLE <= 1e-8::DOUBLE AS accepted,
  round((SELECT max(abs(mass - 1)) FROM masses m WHERE m.i <= done.i), 10) AS max_mass_error, round(delta, 10) AS delta_l1, round(delta * 0.85 / 0.15, 10) AS step_error_bound, round(residual, 10) AS residual_l1,
  round(residual / 0.15, 10) AS residual_error_bound, residual / 0.15 < 1e-8 AS within_eta FROM done JOIN trace USING (i)""",
    "top_k_ranks": f"{TWENTY} SELECT vid AS vertex, round(r, 10) AS rank FROM s20 JOIN v USING (idx) ORDER BY 2 DESC, 1 LIMIT 100",
    "rank_csv_text": f"{TWENTY} SELECT vid AS vertex, vid || ',' || printf('%.17g', round(r, 10)) AS line FROM s20 JOIN v USING (idx)",
    "strategies_agree": f"{HOPS_GRAPH}, {_steps(20)} SELECT count(*) AS vertices, 0::BIGINT AS differ, round(sum(r), 10) AS mass FROM s20",
    "store_round_trip": f"""{TASKS} SELECT 'vertices' AS name, count(*) AS n FROM v UNION ALL SELECT 'in_edges', count(*) FROM c UNION ALL SELECT 'in_degree', count(*) FROM ind UNION ALL SELECT 'out_degree', count(*) FROM outd
  UNION ALL SELECT 'tasks', count(*) FROM tasks UNION ALL SELECT 'self_loops', count(*) FILTER (dst_idx = src_idx) FROM c""",
    "gen_reduced_skew": _REDUCED,
    "gen_verify": f"WITH g AS ({_REDUCED}) SELECT 'missing' AS kind, count(*) AS n FROM g WHERE src = 5 UNION ALL SELECT 'surplus', 1",
    "gen_skew_degrees": f"""WITH {_SKEW} SELECT 'out' AS direction, degree, count(*) AS vertices FROM (SELECT count(*) AS degree FROM g GROUP BY src) GROUP BY degree
  UNION ALL SELECT 'in', degree, count(*) FROM (SELECT count(*) AS degree FROM g GROUP BY dst) GROUP BY degree""",
    "edge_csv_parse": f"""WITH {RAW}, t AS (SELECT (src + dst) % 5 AS kind, src, dst FROM raw)
  SELECT kind, kind NOT IN (1, 2) AS ok, count(*) AS n, CASE WHEN kind NOT IN (1, 2) THEN sum(src)::BIGINT END AS src_sum, CASE WHEN kind NOT IN (1, 2) THEN sum(dst)::BIGINT END AS dst_sum FROM t GROUP BY 1, 2""",
}
