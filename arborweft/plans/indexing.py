"""Scans and the incremental index, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from arborweft.operators import indexing as op
from arborweft.operators import model
from arborweft.operators.model import sql
from arborweft.plans.drift import _SNAP, manifests
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


# two paths that can't be read stand for read errors
_UNREAD = "ends_with(path, '7.go')"
_SCAN = f"scan AS (SELECT path, CASE WHEN {_UNREAD} THEN NULL ELSE h END AS h FROM new WHERE path IS NOT NULL), was AS (SELECT path, h FROM old WHERE path IS NOT NULL)"
_ACT = "CASE WHEN s.path IS NULL THEN 'prune' WHEN s.h IS NULL THEN 'error' WHEN w.path IS NOT NULL AND w.h IS NOT DISTINCT FROM s.h{} THEN 'skip' ELSE 'index' END"


def _scan(s, d):
    old, new = manifests(s, d)
    return old, new.withColumn("h", F.when(~F.col("path").endswith("7.go"), F.col("h")))


@query("index_actions", f"WITH {_SNAP}, {_SCAN} SELECT coalesce(s.path, w.path) AS path, {_ACT.format('')} AS action FROM scan s FULL JOIN was w ON w.path = s.path")
def index_actions(s, d):
    """What an incremental pass does with each file."""
    return op.actions(*_scan(s, d))


@query("index_forced", f"WITH {_SNAP}, {_SCAN} SELECT action, count(*) AS n FROM (SELECT {_ACT.format(' AND false')} AS action FROM scan s FULL JOIN was w ON w.path = s.path) GROUP BY 1")
def index_forced(s, d):
    """The same when the stored extractor version is another one."""
    return op.actions(*_scan(s, d), force=op.forced("6", "7")).groupBy("action").agg(F.count("*").alias("n"))


@query("index_subset", f"WITH {_SNAP}, {_SCAN} SELECT s.path, {_ACT.format('')} AS action FROM scan s LEFT JOIN was w ON w.path = s.path WHERE starts_with(s.path, 'aldermoor/')")
def index_subset(s, d):
    """Only the paths of a subset, deliberately without pruning."""
    old, scan = _scan(s, d)
    return op.actions(old, scan, subset=scan.filter(F.col("path").startswith("aldermoor/")))


_T = f"""{_SNAP.replace('old AS', 'old AS', 1)}, {_SCAN}, a AS (SELECT coalesce(s.path, w.path) AS path, {_ACT.format('')} AS action FROM scan s FULL JOIN was w ON w.path = s.path)"""


@query(
    "index_store",
    f"WITH {model.SQL.replace(chr(10), ' ')}, {_T}, n2 AS (SELECT * FROM n WHERE file_path IS NULL OR file_path NOT IN (SELECT path FROM a WHERE action = 'prune')), hit AS (SELECT n.id FROM n JOIN a ON a.path = n.file_path WHERE a.action IN ('index', 'prune')), again AS (SELECT n.id FROM n JOIN a ON a.path = n.file_path WHERE a.action = 'index')"
    + """ SELECT 'nodes' AS table_name, count(*) AS n_rows FROM n2
 UNION ALL SELECT 'edges', (SELECT count(*) FROM e WHERE (source IS NULL OR source NOT IN (SELECT id FROM hit)) AND (target IS NULL OR target NOT IN (SELECT id FROM hit))) + (SELECT count(*) FROM e WHERE source IN (SELECT id FROM again) AND target IN (SELECT id FROM n2))
 UNION ALL SELECT 'unresolved_refs', (SELECT count(*) FROM r WHERE from_node_id IS NULL OR from_node_id NOT IN (SELECT id FROM hit)) + (SELECT count(*) FROM r WHERE from_node_id IN (SELECT id FROM again))
 UNION ALL SELECT 'files', count(*) FROM f WHERE path NOT IN (SELECT path FROM a WHERE action = 'prune')""",
)
def index_store(s, d):
    """The sizes of all tables after a pass that reads the changed files again and finds in them what is stored."""
    scratch = Scratch(s, "index")
    plan = scratch.write(op.actions(*_scan(s, d)))
    n = scratch.write(model.nodes(s, d, "id", "kind", "file_path"))
    e, r = scratch.write(model.edges(s, d, "source", "target", "kind")), scratch.write(model.refs(s, d, "from_node_id"))
    f = model.files(s, d, "path", "content_hash")
    again = plan.filter("action = 'index'").select("path")
    new_n = n.join(again.withColumnRenamed("path", "file_path"), "file_path", "left_semi").select(*n.columns)
    own = scratch.write(new_n.select("id").distinct())
    new_e = e.join(own.withColumnRenamed("id", "source"), "source", "left_semi").select(*e.columns)
    new_r = r.join(own.withColumnRenamed("id", "from_node_id"), "from_node_id", "left_semi").select(*r.columns)
    out = op.store(n, e, r, f, plan, new_n, new_e, new_r, f.join(again, "path", "left_semi"))
    got = None
    for name, t in out.items():
        one = t.agg(F.lit(name).alias("table_name"), F.count("*").alias("n_rows"))
        got = one if got is None else got.union(one)
    return got


@query("clear_and_swap", "SELECT 'after swap' AS step, count(*) AS n_rows FROM (SELECT DISTINCT path FROM files WHERE path IS NOT NULL) UNION ALL SELECT 'after compaction', count(*) FROM (SELECT DISTINCT path FROM files WHERE path IS NOT NULL) UNION ALL SELECT 'after clear', 0")
def clear_and_swap(s, d):
    """D15, D16, D19 on a copy of the files in the shared folder."""
    scratch = Scratch(s, "swap")
    at = f"{scratch.base}/table"
    op.swap(load(s, d, "files").select("path").filter("path is not null"), at)
    op.swap(s.read.parquet(at).distinct(), at)
    out = [("after swap", s.read.parquet(at).count())]
    op.compact(s, at)
    out.append(("after compaction", s.read.parquet(at).count()))
    op.clear(s, at)
    out.append(("after clear", s.read.parquet(at).count()))
    return s.createDataFrame(out, "step string, n_rows long")


# --- storage reads that the graph queries leave out -------------------------------------------------------------------


@query("all_nodes", sql("SELECT id, kind, name FROM n ORDER BY id"))
def all_nodes(s, d):
    """All nodes in order of id."""
    return model.nodes(s, d, "id", "kind", "name").orderBy("id")


@query("edges_by_target", sql("SELECT e.id, source, target, kind FROM e WHERE target IN (SELECT id FROM nodes WHERE kind = 'column')"))
def edges_by_target(s, d):
    """Incoming edges of a set of nodes. The scan meets the few targets first; only hits are made distinct."""
    ids = Scratch(s, "targets").write(load(s, d, "nodes").filter("kind = 'column'").select(F.col("id").alias("target")).distinct())
    return load(s, d, "edges").select("id", "source", "target", "kind").join(ids, "target", "left_semi").select("id", "source", "target", "kind").dropDuplicates(["id"])


@query("file_point", sql("SELECT q.path, f.language, f.path IS NOT NULL AS found FROM (VALUES ('no/such/file'), ((SELECT min(path) FROM files))) AS q(path) LEFT JOIN f ON f.path = q.path WHERE q.path IS NOT NULL"))
def file_point(s, d):
    """Files by path; a path without a row gives nulls."""
    first = load(s, d, "files").agg(F.min("path")).first()[0]
    ask = s.createDataFrame([(p,) for p in ("no/such/file", first) if p], "path string")
    rows = load(s, d, "files").filter(F.col("path").isin(*[r[0] for r in ask.collect()]))
    f = model.latest(rows, "path", "indexed_at", ["path", "language"]).withColumn("f", F.lit(True))
    return ask.join(f, "path", "left").select("path", "language", F.coalesce("f", F.lit(False)).alias("found"))


@query("files_after_delete", sql("SELECT path FROM f WHERE path NOT LIKE '%_test%'"))
def files_after_delete(s, d):
    """What stays when files are deleted."""
    f = model.files(s, d, "path", "language").select("path")
    return f.join(f.filter("path like '%_test%'"), "path", "left_anti")


@query("refs_by_kind", sql("SELECT id, reference_name FROM r WHERE reference_kind = 'extends'"))
def refs_by_kind(s, d):
    """The filter reaches the scan, before references are made distinct."""
    return load(s, d, "unresolved_refs").filter("reference_kind = 'extends'").select("id", "reference_name").dropDuplicates(["id"])


@query("refs_after_changes", sql("SELECT coalesce(reference_kind, '') AS kind, count(*) AS n FROM (SELECT id, reference_kind FROM r WHERE reference_kind <> 'imports' AND (file_path IS NULL OR file_path NOT LIKE '%.sql') UNION SELECT 'new:' || id, 'calls' FROM r WHERE reference_kind = 'calls' UNION SELECT id, reference_kind FROM r WHERE reference_kind = 'extends') GROUP BY 1"))
def refs_after_changes(s, d):
    """References deleted by ids (imports) and by file, then a batch put in that ignores ids that are there already."""
    r = model.refs(s, d, "reference_kind", "file_path")
    ids = r.filter("reference_kind = 'imports'").select("id")
    kept = r.join(ids, "id", "left_anti").filter("reference_kind is not null and (file_path is null or file_path not like '%.sql')").select("id", "reference_kind")
    batch = r.filter("reference_kind = 'calls'").select(F.concat(F.lit("new:"), "id").alias("id"), "reference_kind").union(r.filter("reference_kind = 'extends'").select("id", "reference_kind"))
    out = kept.union(batch.join(kept.select("id"), "id", "left_anti"))
    return out.groupBy(F.coalesce("reference_kind", F.lit("")).alias("kind")).agg(F.count("*").alias("n"))


@query("edges_after_changes", sql("SELECT kind, count(*) AS n FROM (SELECT kind FROM e WHERE kind <> 'type_of' UNION ALL SELECT kind FROM e WHERE kind = 'writes') GROUP BY 1"))
def edges_after_changes(s, d):
    """Edges put in as they come, without a test for repeats, and deleted by id."""
    e = model.edges(s, d, "kind")
    gone = e.filter("kind = 'type_of'").select("id")
    return e.join(gone, "id", "left_anti").select("kind").union(e.filter("kind = 'writes'").select("kind")).groupBy("kind").agg(F.count("*").alias("n"))
