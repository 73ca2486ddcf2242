"""Storage, traversal and whole-graph queries, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborweft.operators import hierarchy, model, traverse
from arborweft.operators.model import CONTAINERS, sql
from arborweft.sources.tables import Scratch, load

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def put(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLE[name] = oracle
        return fn

    return put


_IN = lambda xs: "(" + ", ".join(f"'{x}'" for x in xs) + ")"

# --- storage (D1-D19) -------------------------------------------------------------------------------------------------


@query("graph_stats", sql("SELECT (SELECT count(*) FROM n) AS n_nodes, (SELECT count(*) FROM e) AS n_edges, (SELECT count(*) FROM f) AS n_files, (SELECT epoch_us(max(indexed_at)) FROM f) AS last_indexed_us"))
def graph_stats(s: SparkSession, d: str) -> DataFrame:
    """Counts of nodes, edges and files, and the latest indexing time."""
    count = lambda t, c: t.agg(F.count("*").alias(c))
    one = [count(model.nodes(s, d, "id"), "n_nodes"), count(model.edges(s, d, "source"), "n_edges"), model.files(s, d, "path", "indexed_at").agg(F.count("*").alias("n_files"), F.unix_micros(F.max("indexed_at").cast("timestamp")).alias("last_indexed_us"))]
    k = F.lit(1).alias("k")
    return one[0].withColumn("k", k).join(one[1].withColumn("k", k), "k").join(one[2].withColumn("k", k), "k").drop("k")


@query("node_kinds", sql("SELECT kind, language, count(*) AS n FROM n GROUP BY 1, 2"))
def node_kinds(s, d):
    """Nodes by kind and language."""
    return model.nodes(s, d, "id", "kind", "language").groupBy("kind", "language").agg(F.count("*").alias("n"))


_ROW = ("id", "kind", "name", "qualified_name", "file_path", "language", "start_line", "end_line", "is_exported")
_COLS = ", ".join(_ROW)


def _latest_of(s, d, keep, cols: tuple) -> DataFrame:
    """The latest rows that pass a filter. Ids of which any version passes come first, by a filtered scan; only their versions
    are aggregated, and the filter is asked again of the latest."""
    names = [c for c in cols if c != "id"]
    ids = load(s, d, "nodes").filter(keep & F.col("id").isNotNull()).select("id").distinct()
    some = load(s, d, "nodes").select("id", *names, "updated_at").join(ids, "id", "left_semi")
    return model.latest(some, "id", "updated_at", ["id", *names]).filter(keep).select(*cols)


@query("nodes_by_kind", sql(f"SELECT {_COLS} FROM n WHERE kind = 'table'"))
def nodes_by_kind(s, d):
    """D3: the tables among the nodes."""
    return _latest_of(s, d, F.col("kind") == "table", _ROW)


@query("nodes_by_name", sql("SELECT id, kind, name FROM n WHERE lower(name) = 'limit'"))
def nodes_by_name(s, d):
    """Case-insensitive lookup by name."""
    return _latest_of(s, d, F.lower("name") == "limit", ("id", "kind", "name"))


@query("nodes_by_ids", sql("SELECT id, kind, name FROM n WHERE id IN (SELECT target FROM e WHERE kind = 'extends')"))
def nodes_by_ids(s, d):
    """Hydrate a set of ids; ids without a node give no row."""
    ids = load(s, d, "edges").filter("kind = 'extends' and target is not null").select(F.col("target").alias("id")).distinct()
    return model.nodes(s, d, "id", "kind", "name").join(ids, "id", "left_semi")


@query("node_point", sql("SELECT id, name, file_path FROM n WHERE id = (SELECT min(id) FROM nodes WHERE kind = 'class')"))
def node_point(s, d):
    """One node by id."""
    first = load(s, d, "nodes").filter("kind = 'class'").agg(F.min("id")).first()[0]
    return model.latest(load(s, d, "nodes").filter(F.col("id") == first), "id", "updated_at", ["id", "name", "file_path"])


@query("nodes_in_file", sql("SELECT id, name, start_line FROM n WHERE file_path = (SELECT min(file_path) FROM nodes WHERE kind = 'method')"))
def nodes_in_file(s, d):
    """The nodes of one file."""
    first = load(s, d, "nodes").filter("kind = 'method'").agg(F.min("file_path")).first()[0]
    return _latest_of(s, d, F.col("file_path") == first, ("id", "name", "start_line", "file_path")).drop("file_path")


@query("edges_by_source", sql("SELECT e.id, source, target, kind FROM e WHERE source IN (SELECT id FROM nodes WHERE kind = 'table')"))
def edges_by_source(s, d):
    """Outgoing edges of a set of nodes."""
    src = load(s, d, "nodes").filter("kind = 'table'").select(F.col("id").alias("source")).distinct()
    return model.edges(s, d, "source", "target", "kind").join(src, "source", "left_semi").select("id", "source", "target", "kind")


@query("edges_by_provenance", sql("SELECT id, source, target, kind, provenance FROM e WHERE provenance = 'heuristic'"))
def edges_by_provenance(s, d):
    """D8."""
    return load(s, d, "edges").filter("provenance = 'heuristic'").select("id", "source", "target", "kind", "provenance").dropDuplicates(["id"])


@query("node_metrics", sql("SELECT n.id, count(DISTINCT i.id) AS in_degree, count(DISTINCT o.id) AS out_degree FROM n LEFT JOIN e i ON i.target = n.id LEFT JOIN e o ON o.source = n.id WHERE n.kind IN ('function', 'method', 'class') GROUP BY n.id"))
def node_metrics(s, d):
    """In- and out-degree. Both counts are made per key before any join, so a hot target is one row there."""
    e = model.edges(s, d, "source", "target")
    ends = e.select(F.explode(F.array(F.struct(F.col("target").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")), F.struct(F.col("source").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")))).alias("x")).select("x.*")
    deg = ends.groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    n = model.nodes(s, d, "id", "kind").filter(F.col("kind").isin("function", "method", "class")).select("id")
    return n.join(deg, "id", "left").select("id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("in_degree", "out_degree")))


@query("file_list", sql("SELECT path, language, node_count FROM f WHERE path LIKE 'aldermoor/%' AND regexp_matches(path, '/[^/]*_test[0-9]*\\.[^/]*$')"))
def file_list(s, d):
    """Files by prefix and a glob on the base name."""
    return model.files(s, d, "path", "language", "node_count").filter(F.col("path").startswith("aldermoor/") & F.col("path").rlike(r"/[^/]*_test[0-9]*\.[^/]*$"))


@query(
    "upsert_latest",
    "SELECT id, kind, name, CASE WHEN updated_at % 2 = 0 THEN updated_at + 10 ELSE updated_at END AS updated_at FROM (SELECT * FROM nodes WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST) = 1)",
)
def upsert_latest(s, d):
    """Insert or replace by key: a batch of newer rows (here the even ones, ten seconds later) over the stored ones."""
    old = load(s, d, "nodes").select("id", "kind", "name", "updated_at")
    new = model.nodes(s, d, "id", "kind", "name", "updated_at").filter("updated_at % 2 = 0").withColumn("updated_at", F.col("updated_at") + 10).select(*old.columns)
    return model.latest(old.union(new), "id", "updated_at", ["id", "kind", "name", "updated_at"])


@query(
    "cascade_delete",
    sql("""SELECT 'nodes' AS table_name, count(*) AS n_left FROM n WHERE file_path NOT LIKE '%.sql' OR file_path IS NULL
UNION ALL SELECT 'edges', count(*) FROM e WHERE NOT EXISTS (SELECT 1 FROM n WHERE file_path LIKE '%.sql' AND (n.id = e.source OR n.id = e.target))
UNION ALL SELECT 'unresolved_refs', count(*) FROM r WHERE NOT EXISTS (SELECT 1 FROM n WHERE file_path LIKE '%.sql' AND n.id = r.from_node_id)"""),
)
def cascade_delete(s, d):
    """Delete the nodes of some files with all edges at either end and all references that start there."""
    n = model.nodes(s, d, "id", "file_path")
    gone = Scratch(s, "cascade").write(n.filter(F.col("file_path").endswith(".sql")).select("id"))
    left = lambda t, c: t.join(gone.withColumnRenamed("id", c), c, "left_anti")
    e = left(left(model.edges(s, d, "source", "target"), "source"), "target")
    r = left(model.refs(s, d, "from_node_id"), "from_node_id")
    count = lambda t, name: t.agg(F.lit(name).alias("table_name"), F.count("*").alias("n_left"))
    return count(left(n, "id"), "nodes").union(count(e, "edges")).union(count(r, "unresolved_refs"))


@query("refs_page", sql("SELECT id, reference_name FROM r WHERE id > (SELECT min(id) FROM r WHERE reference_kind = 'extends') ORDER BY id LIMIT 500"))
def refs_page(s, d):
    """A keyset page, the 500 references after a cursor (the page is the feature)."""
    cursor = load(s, d, "unresolved_refs").filter("reference_kind = 'extends'").agg(F.min("id")).first()[0]
    return model.refs(s, d, "reference_name").filter(F.col("id") > cursor).orderBy("id").limit(500)


# --- traversal (G1-G24) -----------------------------------------------------------------------------------------------

_CALLER = "(SELECT source AS id FROM e WHERE kind = 'calls' AND source LIKE 'function:%' AND target NOT LIKE 'package:%' GROUP BY source ORDER BY count(DISTINCT target) DESC, source LIMIT 1)"
_CALLED = "(SELECT target AS id FROM e WHERE kind = 'calls' AND target LIKE 'function:%' GROUP BY target ORDER BY count(DISTINCT source) DESC, target LIMIT 1)"
_BASE = "(SELECT target AS id FROM e WHERE kind = 'extends' GROUP BY target ORDER BY count(DISTINCT source) DESC, target LIMIT 1)"


def _top(e: DataFrame, by: str, other: str) -> DataFrame:
    """The key with most partners (ties: least id), as one seed row."""
    top = e.select(by, other).distinct().groupBy(by).agg(F.count(other).alias("n")).orderBy(F.desc("n"), by).limit(1)
    return top.select(F.col(by).alias("origin"), F.col(by).alias("id"))


def _stored(s, d) -> DataFrame:
    """The edges as they are stored, for walks: repeated rows are made distinct among the hits, not before."""
    return load(s, d, "edges").select("id", *_E4)


def _caller(e: DataFrame) -> DataFrame:
    return _top(e.filter("kind = 'calls' and source like 'function:%' and target not like 'package:%'"), "source", "target")


def _called(e: DataFrame) -> DataFrame:
    return _top(e.filter("kind = 'calls' and target like 'function:%'"), "target", "source")


def _base(e: DataFrame) -> DataFrame:
    return _top(e.filter("kind = 'extends'"), "target", "source")


def _walk_sql(start: str, near: str, far: str, kinds: str, depth: int) -> str:
    stop = f"AND w.d < {depth}" if depth else ""
    # with UNION, and no depth bound, the depth column is dropped so that loops end
    if depth:
        return sql(f", st AS {start}, w(id, d) AS (SELECT id, 0 FROM st UNION SELECT e.{far}, w.d + 1 FROM w JOIN e ON e.{near} = w.id AND {kinds} {stop} WHERE e.{far} IS NOT NULL) SELECT id AS node_id, min(d) AS depth FROM w GROUP BY id")
    return sql(f", st AS {start}, w(id) AS (SELECT id FROM st UNION SELECT e.{far} FROM w JOIN e ON e.{near} = w.id AND {kinds} WHERE e.{far} IS NOT NULL) SELECT id AS node_id FROM w")


_CALL = "e.kind IN " + _IN(traverse.CALL_KINDS)
_TYPE = "e.kind IN " + _IN(traverse.TYPE_KINDS)
_E4 = ("source", "target", "kind")


def _walk(name: str, seed, start_sql: str, incoming: bool, kinds: tuple, kinds_sql: str, depth: int, with_depth: bool = True) -> None:
    near, far = ("target", "source") if incoming else ("source", "target")

    @query(name, _walk_sql(start_sql, near, far, kinds_sql, depth))
    def run(s, d):
        e = _stored(s, d)
        got, _ = traverse.bfs(e, seed(e), depth, incoming, kinds)
        return got.select(F.col("id").alias("node_id"), *(["depth"] if with_depth else []))


_walk("callees_d1", _caller, _CALLER, False, traverse.CALL_KINDS, _CALL, 1)  # G1
_walk("callees_d2", _caller, _CALLER, False, traverse.CALL_KINDS, _CALL, 2)  # G12
_walk("callers_d2", _called, _CALLED, True, traverse.CALL_KINDS, _CALL, 2)  # G2
_walk("type_descendants", _base, _BASE, True, traverse.TYPE_KINDS, _TYPE, 0, False)  # G7, G13
_walk("type_ancestors", lambda e: _top(e.filter("kind = 'extends'"), "source", "target"), "(SELECT source AS id FROM e WHERE kind = 'extends' GROUP BY source ORDER BY count(DISTINCT target) DESC, source LIMIT 1)", False, traverse.TYPE_KINDS, _TYPE, 0, False)

_IMPACT_SEED = f""", st AS {_BASE}, kids AS (SELECT DISTINCT e.target AS id FROM st JOIN n ON n.id = st.id AND n.kind IN {_IN(CONTAINERS)} JOIN e ON e.source = st.id AND e.kind = 'contains' WHERE e.target IS NOT NULL),
sd AS (SELECT id FROM kids UNION ALL SELECT st.id FROM st JOIN n ON n.id = st.id WHERE NOT EXISTS (SELECT 1 FROM kids)),
w(id, d) AS (SELECT id, 0 FROM sd UNION SELECT e.source, w.d + 1 FROM w JOIN e ON e.target = w.id AND e.kind <> 'contains' WHERE w.d < 3 AND e.source IS NOT NULL),
lv AS (SELECT id, min(d) AS depth FROM w GROUP BY id)"""


def _impact(s, d):
    e = _stored(s, d)
    return traverse.impact(load(s, d, "nodes").select("id", "kind", "updated_at"), e, Scratch(s, "base").write(_base(e)))


@query("impact_radius", sql(_IMPACT_SEED + " SELECT id AS node_id, depth FROM lv"))
def impact_radius(s, d):
    """What depends on the most extended class, by way of what the class contains."""
    return _impact(s, d)[0].select(F.col("id").alias("node_id"), "depth")


@query("impact_edges", sql(_IMPACT_SEED + " SELECT e.id AS edge_id, e.source, e.target, e.kind FROM lv JOIN e ON e.target = lv.id AND e.kind <> 'contains' WHERE lv.depth < 3 AND e.source IS NOT NULL"))
def impact_edges(s, d):
    """Every edge of each level, those back to visited nodes too."""
    kept = _impact(s, d)[1]
    return _stored(s, d).join(kept.select(F.col("edge_id").alias("id")).distinct(), "id", "left_semi").dropDuplicates(["id"]).select(F.col("id").alias("edge_id"), *_E4)


@query(
    "callee_edges",
    sql(f""", st AS {_CALLER}, w(id, d) AS (SELECT id, 0 FROM st UNION SELECT e.target, w.d + 1 FROM w JOIN e ON e.source = w.id AND {_CALL} WHERE w.d < 3 AND e.target IS NOT NULL), lv AS (SELECT id, min(d) AS depth FROM w GROUP BY id)
SELECT e.id AS edge_id FROM lv a JOIN e ON e.source = a.id AND {_CALL} JOIN lv b ON b.id = e.target WHERE b.depth = a.depth + 1 AND a.depth < 3"""),
)
def callee_edges(s, d):
    """The edge rule of a plain walk: an edge stays when its far end was unvisited at the start of its level."""
    e = _stored(s, d)
    return traverse.bfs(e, _caller(e), 3, False, traverse.CALL_KINDS)[1].select("edge_id").distinct()


_PATH = """, st AS (SELECT min(source) AS id FROM e WHERE kind = 'contains' AND source LIKE 'file:%' AND target IN (SELECT source FROM e WHERE kind = 'extends')),
w(id, d) AS (SELECT id, 0 FROM st UNION SELECT e.target, w.d + 1 FROM w JOIN e ON e.source = w.id WHERE w.d < 6 AND e.target IS NOT NULL), lv AS (SELECT id, min(d) AS depth FROM w GROUP BY id),
far AS (SELECT id, depth FROM lv ORDER BY depth DESC, id LIMIT 1),
pr AS (SELECT b.id, arg_min(a.id, (CASE e.kind WHEN 'contains' THEN 0 WHEN 'calls' THEN 1 ELSE 2 END, a.id)) AS parent FROM lv a JOIN e ON e.source = a.id JOIN lv b ON b.id = e.target AND b.depth = a.depth + 1 GROUP BY b.id),
p(step, id) AS (SELECT depth, id FROM far UNION ALL SELECT p.step - 1, pr.parent FROM p JOIN pr ON pr.id = p.id)"""


def _path(s, d):
    e = _stored(s, d)
    holders = e.filter("kind = 'contains' and source like 'file:%'").join(e.filter("kind = 'extends'").select(F.col("source").alias("target")).distinct(), "target", "left_semi")
    start = Scratch(s, "start").write(holders.agg(F.min("source").alias("id")))
    got, _ = traverse.bfs(e, start.select(F.col("id").alias("origin"), "id"), 6)
    goal = Scratch(s, "goal").write(got.orderBy(F.desc("depth"), "id").limit(1).select("id"))
    return traverse.shortest_path(e, start, goal)


@query("shortest_path_nodes", sql(_PATH + " SELECT step, id AS node_id FROM p"))
def shortest_path_nodes(s, d):
    """A shortest path; ties go to the first edge kind, then the least id."""
    return _path(s, d).select("step", F.col("id").alias("node_id"))


@query("shortest_path_len", sql(_PATH + " SELECT max(step) AS hops FROM p"))
def shortest_path_len(s, d):
    return _path(s, d).agg(F.max("step").alias("hops"))


def file_imports(s, d) -> DataFrame:
    """(from_path, to_path): import edges lifted to files by the file of either end. G14, G15 and G16 all stand on it."""
    p = model.nodes(s, d, "id", "file_path").filter("file_path is not null")
    e = load(s, d, "edges").filter("kind = 'imports'").select("source", "target").distinct()
    j = e.join(p.select(F.col("id").alias("source"), F.col("file_path").alias("from_path")), "source").join(p.select(F.col("id").alias("target"), F.col("file_path").alias("to_path")), "target")
    return j.filter("from_path <> to_path").select("from_path", "to_path").distinct()


_FI = ", fi AS (SELECT DISTINCT a.file_path AS from_path, b.file_path AS to_path FROM e JOIN n a ON a.id = e.source JOIN n b ON b.id = e.target WHERE e.kind = 'imports' AND a.file_path <> b.file_path)"


@query("file_dependencies", sql(_FI + " SELECT fi.from_path, fi.to_path, f.language FROM fi JOIN f ON f.path = fi.to_path"))
def file_dependencies(s, d):
    """Per file the files it imports from."""
    return file_imports(s, d).join(model.files(s, d, "path", "language").withColumnRenamed("path", "to_path"), "to_path").select("from_path", "to_path", "language")


@query("file_dependents", sql(_FI + " SELECT f.path, count(DISTINCT from_path) AS n_dependents FROM f LEFT JOIN fi ON fi.to_path = f.path GROUP BY f.path"))
def file_dependents(s, d):
    """Per file how many files import from it."""
    n = file_imports(s, d).groupBy(F.col("to_path").alias("path")).agg(F.count("*").alias("n"))
    return model.files(s, d, "path", "language").join(n, "path", "left").select("path", F.coalesce("n", F.lit(0)).alias("n_dependents"))


def is_test(path):
    """Test files by their base name."""
    base = F.substring_index(path, "/", -1)
    return base.endswith("_test.go") | base.contains(".test.") | base.contains(".spec.") | base.startswith("test_") | base.rlike(r"_test(\.[^.]*)?$")


@query(
    "affected_files",
    sql(_FI + """, w(origin, path, d) AS (SELECT DISTINCT to_path, to_path, 0 FROM fi WHERE to_path LIKE 'aldermoor/%' UNION SELECT w.origin, fi.from_path, w.d + 1 FROM w JOIN fi ON fi.to_path = w.path WHERE w.d < 5)
SELECT origin AS changed, path, min(d) AS depth FROM w WHERE path <> origin AND regexp_matches(path, '_(test|index)[0-9]*\\.[^/]*$') GROUP BY 1, 2"""),
)
def affected_files(s, d):
    """Test files (glob *_test*, *_index*) that depend on a changed file, to depth 5; every changed file on its own."""
    fi = Scratch(s, "imports").write(file_imports(s, d).select(F.monotonically_increasing_id().alias("id"), F.col("from_path").alias("source"), F.col("to_path").alias("target"), F.lit("imports").alias("kind")))
    seeds = fi.filter(F.col("target").startswith("aldermoor/")).select(F.col("target").alias("origin"), F.col("target").alias("id")).distinct()
    got, _ = traverse.bfs(fi, seeds, 5, incoming=True)
    return got.filter("id <> origin").filter(F.col("id").rlike(r"_(test|index)[0-9]*\.[^/]*$")).select(F.col("origin").alias("changed"), F.col("id").alias("path"), "depth")


@query(
    "multi_def_impact",
    sql(""", st AS (SELECT id FROM n WHERE name = 'entry'), w(origin, id, d) AS (SELECT id, id, 0 FROM st UNION SELECT w.origin, e.source, w.d + 1 FROM w JOIN e ON e.target = w.id AND e.kind <> 'contains' WHERE w.d < 3 AND e.source IS NOT NULL)
SELECT origin, id AS node_id, min(d) AS depth FROM w GROUP BY 1, 2"""),
)
def multi_def_impact(s, d):
    """Every definition of a name walks on its own; the origin column keeps them apart."""
    st = model.nodes(s, d, "id", "name").filter("name = 'entry'").select(F.col("id").alias("origin"), "id")
    got, _ = traverse.bfs(_stored(s, d), st, 3, incoming=True, skip=("contains",))
    return got.select("origin", F.col("id").alias("node_id"), "depth")


@query(
    "local_subgraph",
    sql(f""", st AS {_BASE}, u AS (SELECT source AS a, target AS b FROM e UNION SELECT target, source FROM e), w(id, d) AS (SELECT id, 0 FROM st UNION SELECT u.b, w.d + 1 FROM w JOIN u ON u.a = w.id WHERE w.d < 2 AND u.b IS NOT NULL AND w.id NOT LIKE 'package:%')
SELECT DISTINCT source, target, kind FROM e WHERE source <> target AND source IN (SELECT id FROM w) AND target IN (SELECT id FROM w)"""),
)
def local_subgraph(s, d):
    """Both directions to depth 2 (packages are not walked through), then the induced edges without self loops."""
    e = _stored(s, d)
    ends = lambda a, b: e.select("id", F.col(a).alias("source"), F.col(b).alias("target"), "kind")
    both = ends("source", "target").union(ends("target", "source")).filter("source not like 'package:%'")
    got, _ = traverse.bfs(both, Scratch(s, "base").write(_base(e)), 2)
    ids = Scratch(s, "inside").write(got.select("id").distinct())
    return e.filter("source <> target").join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi").select("source", "target", "kind").distinct()


@query("node_context", sql(f", st AS {_CALLED} SELECT 'caller' AS side, e.id AS edge_id, source AS node_id FROM e JOIN st ON st.id = e.target WHERE {_CALL} AND source <> st.id UNION ALL SELECT 'callee', e.id, target FROM e JOIN st ON st.id = e.source WHERE {_CALL} AND target <> st.id"))
def node_context(s, d):
    """Callers and callees at depth 1 with their edges."""
    e = _stored(s, d)
    st = Scratch(s, "context").write(_called(e))
    c = e.filter(F.col("kind").isin(*traverse.CALL_KINDS))
    into = c.join(st.select(F.col("id").alias("target")), "target").filter("source <> target").select(F.lit("caller").alias("side"), F.col("id").alias("edge_id"), F.col("source").alias("node_id"))
    return into.union(c.join(st.select(F.col("id").alias("source")), "source").filter("source <> target").select(F.lit("callee"), "id", "target")).distinct()


# --- whole-graph reports (G8, G9, G18-G31) ----------------------------------------------------------------------------


@query("dead_code", sql("SELECT id, kind, name FROM n WHERE kind IN ('function', 'method', 'class') AND NOT coalesce(is_exported, false) AND id NOT IN (SELECT target FROM e WHERE kind <> 'contains' AND target IS NOT NULL)"))
def dead_code(s, d):
    """Functions, methods and classes that are not exported and that nothing but their container points to."""
    used = load(s, d, "edges").filter("kind <> 'contains' and target is not null").select(F.col("target").alias("id")).distinct()
    return model.nodes(s, d, "id", "kind", "name", "is_exported").filter(F.col("kind").isin(*model.DEAD_KINDS) & ~F.coalesce("is_exported", F.lit(False))).join(used, "id", "left_anti").select("id", "kind", "name")


def _import_links(s, d) -> DataFrame:
    e = load(s, d, "edges").filter("kind = 'imports' and source like 'file:%' and target like 'file:%'")
    return e.select(F.lit("imports").alias("edge_kind"), F.col("source").alias("parent"), F.col("target").alias("child")).distinct()


@query("circular_components", sql(", l AS (SELECT DISTINCT source, target FROM e WHERE kind = 'imports' AND source LIKE 'file:%' AND target LIKE 'file:%'), w(a, b) AS (SELECT source, target FROM l UNION SELECT w.a, l.target FROM w JOIN l ON w.b = l.source) SELECT x.a AS node_id, min(x.b) AS component FROM w x JOIN w y ON x.a = y.b AND x.b = y.a GROUP BY 1"))
def circular_components(s, d):
    """Files that import each other in a circle, with the least file of the circle's strong component."""
    return hierarchy.loop_members(_import_links(s, d)).select("node_id", F.col("cycle_id").alias("component"))


@query("import_cycles")
def import_cycles(s, d):
    """The back edges of the depth-first traversal of file imports, files in order of id. No SQL: the order of a
    depth-first traversal is sequential; tests compare it with a plain traversal."""
    return hierarchy.back_edges_of(_import_links(s, d)).select("parent", "child")


@query("export_dedup", sql("SELECT DISTINCT source, target, kind FROM e"))
def export_dedup(s, d):
    """The graph's edges once per source, target and kind."""
    return load(s, d, "edges").select(*_E4).distinct()


@query(
    "graph_fingerprint",
    sql("SELECT sha256(count(*) || ':' || sum(CAST(CAST('0x' || substr(sha256(line), 1, 15) AS BIGINT) AS HUGEINT)) || ':' || sum(CAST(CAST('0x' || substr(sha256(line), 16, 15) AS BIGINT) AS HUGEINT))) AS fingerprint FROM (SELECT 'n' || chr(9) || n.id || chr(9) || name || chr(9) || coalesce(start_line, 0) AS line FROM n UNION SELECT 'e' || chr(9) || source || chr(9) || target || chr(9) || kind FROM e) WHERE line IS NOT NULL"),
)
def graph_fingerprint(s, d):
    """One hash of the set of nodes (id, name, line) and edges (source, target, kind). It sums two 60-bit parts of each
    line's hash, so it needs no global order and combines on the map side, unlike a hash over the sorted lines."""
    t = F.lit("\t")
    n = model.nodes(s, d, "id", "name", "start_line").select(F.concat(F.lit("n\t"), "id", t, "name", t, F.coalesce("start_line", F.lit(0)).cast("string")).alias("line"))
    e = load(s, d, "edges").select(F.concat(F.lit("e\t"), "source", t, "target", t, "kind").alias("line"))
    h = n.union(e).filter("line is not null").distinct().select(F.sha2("line", 256).alias("h"))
    part = lambda at: F.coalesce(F.sum(F.conv(F.substring("h", at, 15), 16, 10).cast("decimal(38,0)")), F.lit(0)).cast("string")
    return h.agg(F.sha2(F.concat_ws(":", F.count("*").cast("string"), part(1), part(16)), 256).alias("fingerprint"))


@query("orphan_nodes", sql("SELECT id, kind FROM n WHERE id NOT IN (SELECT target FROM e WHERE target IS NOT NULL)"))
def orphan_nodes(s, d):
    """Nodes without any incoming edge."""
    into = load(s, d, "edges").filter("target is not null").select(F.col("target").alias("id")).distinct()
    return model.nodes(s, d, "id", "kind").join(into, "id", "left_anti")


@query("top_container", sql("SELECT language, arg_max(file_path, (n_symbols, file_path)) AS file_path, max(n_symbols) AS n_symbols FROM (SELECT language, file_path, count(*) AS n_symbols FROM n WHERE kind IN ('function', 'method') AND file_path IS NOT NULL GROUP BY 1, 2) GROUP BY language"))
def top_container(s, d):
    """Per language the file with most functions; ties go to the greatest path."""
    per = model.nodes(s, d, "id", "kind", "language", "file_path").filter("kind in ('function', 'method') and file_path is not null").groupBy("language", "file_path").agg(F.count("*").alias("n_symbols"))
    return per.groupBy("language").agg(F.max(F.struct("n_symbols", "file_path")).alias("m")).select("language", "m.file_path", "m.n_symbols")


@query(
    "merge_subgraphs",
    sql(f", a AS {_CALLER}, b AS {_CALLED}, pick AS (SELECT e.* FROM e JOIN a ON e.source = a.id UNION ALL SELECT e.* FROM e JOIN b ON e.target = b.id) SELECT DISTINCT source, target, kind, line, col FROM pick"),
)
def merge_subgraphs(s, d):
    """Two result graphs in one: edges once per source, target, kind, line and column."""
    e = model.edges(s, d, "source", "target", "kind", "line", "col")
    out = e.join(_caller(e).select(F.col("id").alias("source")), "source", "left_semi")
    into = e.join(_called(e).select(F.col("id").alias("target")), "target", "left_semi").select(*out.columns)
    return out.union(into).select("source", "target", "kind", "line", "col").distinct()


@query(
    "container_outline",
    sql("SELECT c.id AS container_id, m.id AS member_id, m.start_line FROM n c JOIN n m ON m.file_path = c.file_path AND m.id <> c.id AND m.start_line >= c.start_line AND m.end_line <= c.end_line WHERE c.kind IN ('class', 'struct') AND m.kind IN ('method', 'function', 'field')"),
)
def container_outline(s, d):
    """Members whose line range lies inside the container's. A range join: both sides are cut into blocks of 256 lines,
    so a file that holds a third of all rows spreads over its blocks; containers appear in each block they touch."""
    n = model.nodes(s, d, "id", "kind", "file_path", "start_line", "end_line")
    block = lambda c: F.floor(F.col(c) / 256)
    c = n.filter("kind in ('class', 'struct') and start_line <= end_line").select(F.col("id").alias("container_id"), "file_path", F.col("start_line").alias("lo"), F.col("end_line").alias("hi"), F.explode(F.sequence(block("start_line"), block("end_line"))).alias("b"))
    m = n.filter("kind in ('method', 'function', 'field')").select(F.col("id").alias("member_id"), "file_path", "start_line", "end_line", block("start_line").alias("b"))
    return c.join(m, ["file_path", "b"]).filter("member_id <> container_id and start_line >= lo and end_line <= hi").select("container_id", "member_id", "start_line")


@query(
    "node_trail",
    sql("SELECT target AS id, source AS caller, rn, dynamic FROM (SELECT target, source, row_number() OVER (PARTITION BY target ORDER BY source) AS rn, dynamic FROM (SELECT target, source, bool_or(coalesce(provenance, '') IN ('heuristic', 'string-match')) AS dynamic FROM e WHERE kind = 'calls' AND target IN (SELECT id FROM nodes WHERE kind IN ('function', 'method')) AND source IS NOT NULL GROUP BY 1, 2)) WHERE rn <= 12"),
)
def node_trail(s, d):
    """The first 12 callers of each symbol by id (the cut is the feature); dynamic marks pairs with a guessed edge.

    Pairs are made first; then a bounded collection keeps the 12 least per task before the shuffle, so a hot symbol sends
    12 rows per task."""
    sym = load(s, d, "nodes").filter("kind in ('function', 'method')").select(F.col("id").alias("target")).distinct()
    e = load(s, d, "edges").filter("kind = 'calls' and source is not null").join(sym, "target", "left_semi")
    pair = e.groupBy("target", "source").agg(F.max(F.coalesce("provenance", F.lit("")).isin("heuristic", "string-match")).alias("dynamic"))
    from pyspark.sql import Window

    rn = pair.withColumn("rn", F.row_number().over(Window.partitionBy("target").orderBy("source")))  # filtered to rank 12: Spark cuts before the shuffle
    return rn.filter("rn <= 12").select(F.col("target").alias("id"), F.col("source").alias("caller"), F.col("rn").cast("long").alias("rn"), "dynamic")


@query("source_lines", sql("SELECT n.id, array_to_string(string_split(content, chr(10))[start_line:end_line], chr(10)) AS code FROM n JOIN source_texts t ON t.path = n.file_path WHERE n.kind = 'function' AND t.content IS NOT NULL AND start_line >= 1 AND end_line >= start_line"))
def source_lines(s, d):
    """The source text of a symbol by path and lines. Symbols are grouped per file before the join: a text is shuffled
    once, not once per symbol."""
    n = model.nodes(s, d, "id", "kind", "file_path", "start_line", "end_line").filter("kind = 'function' and start_line >= 1 and end_line >= start_line")
    # files with many symbols come in chunks of 500 lines, so no row grows with a file's symbols
    by = n.groupBy(F.col("file_path").alias("path"), F.floor(F.col("start_line") / 500).alias("c")).agg(F.collect_list(F.struct("id", "start_line", "end_line")).alias("x"))
    t = load(s, d, "source_texts").filter("content is not null").select("path", F.split("content", "\n").alias("lines"))
    j = by.join(t, "path").select("lines", F.explode("x").alias("x"))
    return j.select("x.id", F.array_join(F.slice("lines", F.col("x.start_line"), F.col("x.end_line") - F.col("x.start_line") + 1), "\n").alias("code"))


@query(
    "index_upsert_guard",
    sql("SELECT id FROM e WHERE source IN (SELECT id FROM n) AND target IN (SELECT id FROM n)"),
)
def index_upsert_guard(s, d):
    """Edges are stored only when both ends exist."""
    ids = Scratch(s, "ids").write(load(s, d, "nodes").filter("id is not null").select("id").distinct())
    e = model.edges(s, d, "source", "target")
    return e.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi").select("id")


# --- further reads of the graph ---------------------------------------------------------------------------------------


def walk(s, d, starts: DataFrame, direction: str, kinds: tuple | None, depth: int) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges within `depth` (0: all) of the starts (origin, id), outgoing or incoming, over the kinds (None: all)."""
    if direction not in ("outgoing", "incoming"):
        raise ValueError(f"direction must be outgoing or incoming, not {direction!r}")
    return traverse.bfs(_stored(s, d), starts, depth, direction == "incoming", kinds)


@query("traverse_kinds", sql(f", st AS {_BASE}, w(id, d) AS (SELECT id, 0 FROM st UNION SELECT e.source, w.d + 1 FROM w JOIN e ON e.target = w.id AND e.kind IN ('extends', 'calls') AND w.d < 2 WHERE e.source IS NOT NULL) SELECT id AS node_id, min(d) AS depth FROM w GROUP BY id"))
def traverse_kinds(s, d):
    """Two levels of incoming extends and calls edges. Unlike the reference's entry, the edge kinds are honoured."""
    got, _ = walk(s, d, _base(_stored(s, d)), "incoming", ("extends", "calls"), 2)
    return got.select(F.col("id").alias("node_id"), "depth")


_IS_TEST = "(ends_with(b, '_test.go') OR contains(b, '.test.') OR contains(b, '.spec.') OR starts_with(b, 'test_') OR regexp_matches(b, '_test(\\.[^.]*)?$'))"


@query("test_files", sql(f"SELECT path, {_IS_TEST} AS is_test FROM (SELECT path, string_split(path, '/')[-1] AS b FROM f)"))
def test_files(s, d):
    """Which files are tests by their base name."""
    return model.files(s, d, "path", "language").select("path", is_test(F.col("path")).alias("is_test"))


test_files.__test__ = False


@query("callers_limited", sql(f", st AS {_CALLED}, w(id, d) AS (SELECT id, 0 FROM st UNION SELECT e.source, w.d + 1 FROM w JOIN e ON e.target = w.id AND {_CALL} AND w.d < 2 WHERE e.source IS NOT NULL), lv AS (SELECT DISTINCT id FROM w WHERE id NOT IN (SELECT id FROM st)) SELECT n.id, n.kind, n.name FROM lv JOIN n ON n.id = lv.id ORDER BY n.id LIMIT 20"))
def callers_limited(s, d):
    """Callers to depth 2, the first 20 by id (the cut is the feature)."""
    e = _stored(s, d)
    got, _ = traverse.bfs(e, _called(e), 2, True, traverse.CALL_KINDS)
    ids = Scratch(s, "callers").write(got.filter("depth > 0").select("id").distinct())
    # the latest rows of these ids only
    n = load(s, d, "nodes").select("id", "kind", "name", "updated_at").join(ids, "id", "left_semi")
    return model.latest(n, "id", "updated_at", ["id", "kind", "name"]).orderBy("id").limit(20)


@query("callee_trail", sql("SELECT source AS id, target AS callee, rn, dynamic FROM (SELECT source, target, row_number() OVER (PARTITION BY source ORDER BY target) AS rn, dynamic FROM (SELECT source, target, bool_or(coalesce(provenance, '') IN ('heuristic', 'string-match')) AS dynamic FROM e WHERE kind = 'calls' AND source IN (SELECT id FROM nodes WHERE kind IN ('function', 'method')) AND target IS NOT NULL GROUP BY 1, 2)) WHERE rn <= 12"))
def callee_trail(s, d):
    """The first 12 callees of each symbol by id, the other half of node_trail."""
    from pyspark.sql import Window

    sym = load(s, d, "nodes").filter("kind in ('function', 'method')").select(F.col("id").alias("source")).distinct()
    e = load(s, d, "edges").filter("kind = 'calls' and target is not null").join(sym, "source", "left_semi")
    pair = e.groupBy("source", "target").agg(F.max(F.coalesce("provenance", F.lit("")).isin("heuristic", "string-match")).alias("dynamic"))
    rn = pair.withColumn("rn", F.row_number().over(Window.partitionBy("source").orderBy("target"))).filter("rn <= 12")
    return rn.select(F.col("source").alias("id"), F.col("target").alias("callee"), F.col("rn").cast("long").alias("rn"), "dynamic")


@query("sql_types", sql("SELECT id, kind, name FROM n WHERE language = 'sql' AND kind IN ('type_alias', 'enum')"))
def sql_types(s, d):
    """V3: types of SQL texts (type aliases; the stored graph calls some of them enum)."""
    return model.nodes(s, d, "id", "kind", "name", "language").filter("language = 'sql' and kind in ('type_alias', 'enum')").select("id", "kind", "name")
