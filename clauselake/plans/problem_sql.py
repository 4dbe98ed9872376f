"""DuckDB statements for the queries of problem_queries."""

_K = "nullif(lower(trim({c}, ' \t')), '')"


def _k(c: str) -> str:
    return _K.format(c=c)


def _first(row: str, *refs: str) -> str:
    """The earliest row of each key, ties by the references (null first) and the key."""
    order = ", ".join(f"({r} IS NOT NULL)::INT, {r}" for r in refs)
    return f"SELECT * FROM {{tab}} WHERE {_k(row)} IS NOT NULL QUALIFY row_number() OVER (PARTITION BY {_k(row)} ORDER BY created_at NULLS FIRST, {order}, {row}) = 1"


def _refs(tab: str, row: str, ref: str) -> str:
    return f"SELECT '{tab}' AS tab_name, {row} AS row_key, {_k(ref)} AS ref, created_at FROM ({_first(row, ref).format(tab=tab)})"


def _target(tab: str, k: str, status: str) -> str:
    return f"SELECT {_k(k)} AS k, min(created_at) AS first_at, max_by(coalesce(lower(trim({status}, ' \t')) = 'deleted', false), (created_at, coalesce(lower(trim({status}, ' \t')) = 'deleted', false))) AS del FROM {tab} GROUP BY 1"


def _states(refs: str, target: str) -> str:
    return f"""SELECT r.tab_name, r.row_key, r.created_at, CASE WHEN r.ref IS NULL THEN 'none' WHEN t.k IS NULL THEN 'missing'
      WHEN t.del THEN 'deleted' WHEN t.first_at > r.created_at THEN 'late' ELSE 'ok' END AS ref_state
      FROM ({refs}) r LEFT JOIN ({target}) t ON r.ref = t.k"""


_DOC, _CLAUSE = _target("documents", "document_id", "status"), _target("clauses", "clause_id", "review_status")
_P1 = " UNION ALL ".join([
    _states(_refs("clauses", "clause_id", "document_id"), _DOC),
    _states(_refs("clause_units", "clause_unit_id", "clause_id"), _CLAUSE),
    _states(_refs("canonical_obligation_sources", "id", "clause_id"), _CLAUSE),
])

_DEL = "coalesce(lower(trim(review_status, ' \t')) = 'deleted', false)"
_PAIRS = f"""WITH r AS (SELECT id AS row_key, {_k('document_id')} AS d, {_k('clause_id')} AS c, created_at AS ts FROM ({_first('id', 'document_id', 'clause_id').format(tab='canonical_obligation_sources')})),
t AS (SELECT {_k('document_id')} AS d, {_k('clause_id')} AS c, max_by({_DEL}, (created_at, {_DEL})) AS del, min(created_at) AS ts0 FROM clauses GROUP BY 1, 2)"""

_TREE = f"""WITH RECURSIVE latest AS (
  SELECT {_k('clause_unit_id')} AS k, min(clause_unit_id) AS node_id, nullif(max_by(coalesce({_k('parent_unit_id')}, ''), created_at), '') AS p FROM clause_units GROUP BY 1),
nodes AS (SELECT l.k, l.node_id, q.k AS p FROM latest l LEFT JOIN latest q ON l.p = q.k),
tree AS (
  SELECT k, node_id, node_id AS root_id, 0 AS depth, node_id AS unit_path FROM nodes WHERE p IS NULL
  UNION ALL SELECT n.k, n.node_id, t.root_id, t.depth + 1, t.unit_path || ' > ' || n.node_id FROM nodes n JOIN tree t ON n.p = t.k)"""
_WALK = f"""{_TREE},
rest AS (SELECT * FROM nodes WHERE k NOT IN (SELECT k FROM tree)),
walk AS (
  SELECT k, k AS cur, [k] AS seen, false AS done FROM rest
  UNION ALL SELECT w.k, r.p, CASE WHEN list_contains(w.seen, r.p) THEN w.seen ELSE list_append(w.seen, r.p) END, list_contains(w.seen, r.p)
  FROM walk w JOIN rest r ON w.cur = r.k WHERE NOT w.done),
ends AS (SELECT k, list_position(seen, cur) - 1 AS steps, list_min(seen[list_position(seen, cur):]) AS low FROM walk WHERE done)"""

_ROUND = f"""{_TREE},
rest AS (SELECT * FROM nodes WHERE k NOT IN (SELECT k FROM tree)),
walk AS (
  SELECT k, k AS cur, [k] AS seen, [node_id] AS names, false AS done FROM rest
  UNION ALL SELECT w.k, r.p, CASE WHEN list_contains(w.seen, r.p) THEN w.seen ELSE list_append(w.seen, r.p) END, CASE WHEN list_contains(w.seen, r.p) THEN w.names ELSE list_append(w.names, n.node_id) END, list_contains(w.seen, r.p)
  FROM walk w JOIN rest r ON w.cur = r.k JOIN rest n ON r.p = n.k WHERE NOT w.done),
ends AS (SELECT names, list_position(seen, cur) - 1 AS steps FROM walk WHERE done)"""

SQL = {
    "p1_found": f"SELECT tab_name, row_key, ref_state, strftime(created_at, '%Y-%m') AS ref_month FROM ({_P1}) WHERE ref_state IN ('missing', 'deleted', 'late')",
    "p1_states": f"SELECT tab_name, row_key, ref_state FROM ({_P1})",
    "p1_report": f"SELECT tab_name, strftime(created_at, '%Y-%m') AS ref_month, ref_state, count(*) AS n_rows FROM ({_P1}) GROUP BY 1, 2, 3",
    "p1_composite": f"""{_PAIRS},
td AS (SELECT d, bool_and(del) AS del, min(ts0) FILTER (NOT del) AS first_at FROM t WHERE d IS NOT NULL GROUP BY 1),
tc AS (SELECT c, bool_and(del) AS del, min(ts0) FILTER (NOT del) AS first_at FROM t WHERE c IS NOT NULL GROUP BY 1)
SELECT r.row_key, CASE WHEN r.d IS NULL AND r.c IS NULL THEN 'none' WHEN coalesce(t.del, td.del, tc.del) IS NULL THEN 'missing'
  WHEN coalesce(t.del, td.del, tc.del) THEN 'deleted' WHEN coalesce(t.ts0, td.first_at, tc.first_at) > r.ts THEN 'late' ELSE 'ok' END AS ref_state
FROM r LEFT JOIN t ON r.d = t.d AND r.c = t.c LEFT JOIN td ON r.c IS NULL AND r.d = td.d LEFT JOIN tc ON r.d IS NULL AND r.c = tc.c""",
    "p1_full": f"""{_PAIRS}
SELECT r.row_key, CASE WHEN r.d IS NULL AND r.c IS NULL THEN 'none' WHEN r.d IS NULL OR r.c IS NULL THEN 'invalid' WHEN t.del IS NULL THEN 'missing'
  WHEN t.del THEN 'deleted' WHEN t.ts0 > r.ts THEN 'late' ELSE 'ok' END AS ref_state FROM r LEFT JOIN t ON r.d = t.d AND r.c = t.c""",
    "p4_found": f"""{_WALK}
SELECT node_id AS clause_unit_id, root_id AS root_unit_id, depth AS unit_depth, 'tree' AS node_state FROM tree
UNION ALL SELECT n.node_id, m.node_id, e.steps::INTEGER, CASE WHEN e.steps = 0 THEN 'cycle' ELSE 'below_cycle' END FROM ends e JOIN nodes n ON n.k = e.k JOIN nodes m ON m.k = e.low""",
    "p4_paths": f"{_TREE} SELECT node_id AS clause_unit_id, unit_path FROM tree",
    "p4_descendants": f"""{_TREE},
up AS (SELECT k, node_id, p AS cur, 1 AS distance FROM nodes WHERE k IN (SELECT k FROM tree) AND p IS NOT NULL
  UNION ALL SELECT u.k, u.node_id, n.p, u.distance + 1 FROM up u JOIN nodes n ON u.cur = n.k WHERE n.p IS NOT NULL)
SELECT n.node_id AS ancestor_id, u.node_id AS descendant_id, u.distance FROM up u JOIN nodes n ON u.cur = n.k""",
    "p4_cycle_paths": f"""{_ROUND} SELECT names[1] AS clause_unit_id, array_to_string(list_reverse(names[1:steps + 1]), ' > ') AS unit_path, CASE WHEN steps = 0 THEN 'cycle' ELSE 'below_cycle' END AS node_state FROM ends""",
    "p4_cycle_descendants": f"""{_ROUND} SELECT names[i] AS ancestor_id, names[1] AS descendant_id, (i - 1)::INTEGER AS distance FROM (SELECT names, unnest(range(2, len(names) + 1)) AS i FROM ends WHERE steps > 0)""",
}
