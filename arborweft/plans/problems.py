"""Queries of the general problems (2, 3, 7) and the SQL they are held against."""

from __future__ import annotations

from arborweft.operators import hierarchy, orphans, skew

QUERIES = {
    "p2_found": skew.found,
    "p2_targets": lambda s, d: skew.flat(skew.target_results(s, d)),
    "p2_files": lambda s, d: skew.flat(skew.file_results(s, d)),
    "p3_found": hierarchy.found,
    "p3_tree": lambda s, d: hierarchy.tree(hierarchy.links(s, d)),
    "p3_descendants": lambda s, d: hierarchy.descendants(hierarchy.links(s, d)),
    "p3_back_edges": hierarchy.back_edges,
    "p7_found": orphans.found,
    "p7_report": orphans.report,
}

_LINKS = """l AS (SELECT DISTINCT kind AS edge_kind, CASE kind WHEN 'extends' THEN target ELSE source END AS parent, CASE kind WHEN 'extends' THEN source ELSE target END AS child
 FROM edges WHERE kind IN ('contains','extends') AND source IS NOT NULL AND target IS NOT NULL),
r(edge_kind, a, b) AS (SELECT edge_kind, parent, child FROM l UNION SELECT r.edge_kind, r.a, l.child FROM r JOIN l ON r.edge_kind = l.edge_kind AND r.b = l.parent)"""

_LIVE = """WITH n AS (SELECT id, max(coalesce(updated_at, -9007199254740992)) AS u FROM nodes WHERE id IS NOT NULL GROUP BY id),
g AS (SELECT node_id, max(removed_at) AS r FROM removed_nodes GROUP BY node_id),
live AS (SELECT id FROM n LEFT JOIN g ON id = node_id WHERE r IS NULL OR r <= u),
refs AS (SELECT 'edges' AS table_name, 'source' AS column_name, coalesce(strftime(loaded_at, '%Y-%m'), '') AS period, CAST(id AS VARCHAR) AS record_id, source AS key FROM edges
 UNION ALL SELECT 'edges', 'target', coalesce(strftime(loaded_at, '%Y-%m'), ''), CAST(id AS VARCHAR), target FROM edges
 UNION ALL SELECT 'unresolved_refs', 'from_node_id', coalesce(strftime(loaded_at, '%Y-%m'), ''), id, from_node_id FROM unresolved_refs),
bad AS (SELECT refs.* FROM refs ANTI JOIN live ON key = id WHERE key IS NOT NULL)"""


def _per_key(table: str, key: str, at: str) -> str:
    return f"""WITH e AS (SELECT {key} AS key, {at} AS tm, CAST(id AS VARCHAR) AS id, coalesce(kind, '') AS kind, {at} - lag({at}) OVER (PARTITION BY {key} ORDER BY {at} NULLS FIRST, CAST(id AS VARCHAR) NULLS FIRST) AS gap FROM {table}),
k AS (SELECT key, string_agg(kind || '=' || n, ',' ORDER BY kind) AS kinds FROM (SELECT key, kind, count(*) AS n FROM e GROUP BY ALL) GROUP BY key),
w AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY tm DESC NULLS LAST, id DESC NULLS LAST) AS rn FROM e)
SELECT w.key, count(*) AS n_rows, min(tm) AS first_at, max(tm) AS last_at, max(id) FILTER (rn = 1) AS last_id, max(gap) AS max_gap_us, any_value(kinds) AS kinds
FROM w JOIN k ON w.key IS NOT DISTINCT FROM k.key GROUP BY w.key"""


ORACLE = {
    "p2_found": """SELECT 'edges' AS table_name, target AS key_value FROM edges WHERE target IS NOT NULL GROUP BY target HAVING count(*) > 0.02 * (SELECT count(*) FROM edges)
 UNION ALL SELECT 'nodes', file_path FROM nodes WHERE file_path IS NOT NULL GROUP BY file_path HAVING count(*) > 0.02 * (SELECT count(*) FROM nodes)""",
    "p2_targets": _per_key("edges", "target", "epoch_us(loaded_at)"),
    "p2_files": _per_key("nodes", "file_path", "(updated_at * 1000000)"),
    "p3_found": f"WITH RECURSIVE {_LINKS} SELECT x.edge_kind, x.a AS node_id, min(x.b) AS cycle_id FROM r x JOIN r y ON x.edge_kind = y.edge_kind AND x.a = y.b AND x.b = y.a GROUP BY 1, 2",
    "p3_descendants": f"WITH RECURSIVE {_LINKS} SELECT edge_kind, a AS ancestor_id, b AS descendant_id FROM r",
    "p3_tree": f"""WITH RECURSIVE {_LINKS},
ids AS (SELECT edge_kind, parent AS v FROM l UNION SELECT edge_kind, child FROM l),
pp AS (SELECT edge_kind, child AS v, min(parent) AS up FROM l WHERE parent <> child GROUP BY 1, 2),
up(edge_kind, v, a) AS (SELECT * FROM pp UNION SELECT up.edge_kind, up.v, pp.up FROM up JOIN pp ON up.edge_kind = pp.edge_kind AND up.a = pp.v),
ring AS (SELECT edge_kind, v FROM up WHERE v = a),
cut AS (SELECT up.edge_kind, v FROM up JOIN ring USING (edge_kind, v) GROUP BY 1, 2 HAVING min(a) = v),
tree(edge_kind, node_id, root_id, depth, path) AS (
 SELECT edge_kind, v, v, 0, v FROM ids WHERE NOT EXISTS (SELECT 1 FROM pp WHERE pp.edge_kind = ids.edge_kind AND pp.v = ids.v) OR EXISTS (SELECT 1 FROM cut WHERE cut.edge_kind = ids.edge_kind AND cut.v = ids.v)
 UNION ALL SELECT pp.edge_kind, pp.v, root_id, depth + 1, path || '/' || pp.v FROM tree JOIN pp ON pp.edge_kind = tree.edge_kind AND pp.up = tree.node_id
  WHERE NOT EXISTS (SELECT 1 FROM cut WHERE cut.edge_kind = pp.edge_kind AND cut.v = pp.v))
SELECT edge_kind, node_id, root_id, depth, path, EXISTS (SELECT 1 FROM r WHERE r.edge_kind = tree.edge_kind AND r.a = node_id AND r.b = node_id) AS in_loop FROM tree""",
    "p7_found": f"{_LIVE} SELECT DISTINCT table_name, column_name, record_id FROM bad",
    "p7_report": f"{_LIVE} SELECT table_name, column_name, period, count(DISTINCT record_id || '|' || key) AS n_records, count(DISTINCT key) AS n_keys FROM bad GROUP BY ALL",
}
