"""Pages, plans, ledgers and members, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborweft.operators import model
from arborweft.operators import pages as op
from arborweft.operators.model import sql
from arborweft.plans.drift import _SNAP, NEW_START, OLD_END, TODAY, diff
from arborweft.sources.tables import load

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def put(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLE[name] = oracle
        return fn

    return put


# Pages with a link of every kind, and what the links lead to.
PAGES = (
    ("zqwiki/a.md", "[b](b.md) and [up](../zqtop.md#part) ![img](no.png) `[code](x.md)` [out](https://x.y) [mail](mailto:a@b) [here](#top)\n```\n[fenced](b.md)\n```\n[[B page|the b]] [[Twin]] [[nobody]]\n[far](../../zqtop.md) [gone](gone.md) [root](/zqtop.md) [doc](/guide.md)"),
    ("zqwiki/b.md", "[back](./a.md) [again](a.md)"), ("zqwiki/deep/b page.md", "no links"), ("zqtop.md", "[[a]]"), ("docs/guide.md", ""), ("zqwiki/twin.md", ""), ("zqwiki/deep/more/Twin.md", ""), ("zqwiki/none.md", None),
)
LINKS = (
    ("zqwiki/a.md", 0, "b.md", "page", "zqwiki/b.md", False), ("zqwiki/a.md", 1, "../zqtop.md#part", "page", "zqtop.md", False), ("zqwiki/a.md", 2, "https://x.y", "external", None, False), ("zqwiki/a.md", 3, "mailto:a@b", "external", None, False), ("zqwiki/a.md", 4, "#top", "none", None, False),
    ("zqwiki/a.md", 5, "B page", "page", "zqwiki/deep/b page.md", False), ("zqwiki/a.md", 6, "Twin", "page", "zqwiki/twin.md", True), ("zqwiki/a.md", 7, "nobody", "broken", None, False), ("zqwiki/a.md", 8, "../../zqtop.md", "page", "zqtop.md", False), ("zqwiki/a.md", 9, "gone.md", "broken", None, False),
    ("zqwiki/a.md", 10, "/zqtop.md", "page", "zqtop.md", False), ("zqwiki/a.md", 11, "/guide.md", "page", "docs/guide.md", False), ("zqwiki/b.md", 0, "./a.md", "page", "zqwiki/a.md", False), ("zqwiki/b.md", 1, "a.md", "page", "zqwiki/a.md", False), ("zqtop.md", 0, "a", "page", "zqwiki/a.md", False),
)
_IN = {"zqwiki/a.md": 2, "zqwiki/b.md": 1, "zqtop.md": 1, "zqwiki/deep/b page.md": 1, "zqwiki/twin.md": 1, "docs/guide.md": 1}


def pages(s, d) -> DataFrame:
    """(path, text): the documents as pages of their source, and the fixed ones. Path: source/doc_id.md."""
    t = load(s, d, "documents").filter("doc_id is not null").select(F.concat_ws("/", F.coalesce("source", F.lit("loose")), F.concat(F.col("doc_id").cast("string"), F.lit(".md"))).alias("path"), "text")
    return t.union(s.createDataFrame(list(PAGES), "path string, text string"))


def _v(*rows: tuple) -> str:
    return "VALUES " + ", ".join("(" + ", ".join("NULL" if x is None else str(x).upper() if isinstance(x, bool) else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'" for x in r) + ")" for r in rows)


@query("page_links", f"SELECT path, no, target, outcome, resolved, ambiguous FROM ({_v(*LINKS)}) AS v(path, no, target, outcome, resolved, ambiguous)")
def page_links(s, d):
    """L1-L4: the links of all pages in document order and what they lead to. The SQL holds the fixed pages' links, read by
    hand; the stored documents of the test sizes hold none."""
    p = pages(s, d)
    return op.resolve(op.links(p), p)


@query("page_inbound", "SELECT path, n_inbound FROM (" + _v(*[(p, _IN.get(p, 0)) for p, _ in PAGES]) + ") AS v(path, n_inbound) UNION ALL SELECT coalesce(source, 'loose') || '/' || doc_id || '.md', 0 FROM documents WHERE doc_id IS NOT NULL")
def page_inbound(s, d):
    """How many pages link to each page; 0 marks an orphan."""
    p = pages(s, d)
    return op.inbound(op.resolve(op.links(p), p), p)


@query("provenance_overlay", sql("SELECT DISTINCT source, target, kind FROM e WHERE kind IN ('imports', 'references') AND source IN (SELECT id FROM n WHERE starts_with(file_path, 'aldermoor/')) AND target IN (SELECT id FROM n WHERE starts_with(file_path, 'aldermoor/'))"))
def provenance_overlay(s, d):
    """The edges of a scope: those of which both ends are present in it."""
    ids = model.nodes(s, d, "id", "file_path").filter(F.col("file_path").startswith("aldermoor/")).select("id")
    e = load(s, d, "edges").filter("kind in ('imports', 'references')").select("source", "target", "kind")
    return e.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi").select("source", "target", "kind").distinct()


_MEMBER = "split_part(path, '/', 1)"
_STATE = lambda cond: f"SELECT {_MEMBER} AS member, CASE WHEN count(DISTINCT path) > 5 THEN 'large' ELSE 'small' END AS status FROM files WHERE path IS NOT NULL AND {cond} GROUP BY 1"


@query("wiki_stale", f"""WITH rec AS ({_STATE(f"indexed_at < TIMESTAMP '{OLD_END}'")}), live AS ({_STATE(f"indexed_at >= TIMESTAMP '{NEW_START}'")}), m AS (SELECT {_MEMBER} AS member, max(indexed_at) AS changed FROM files WHERE path IS NOT NULL GROUP BY 1),
l AS (SELECT 0 AS rank, CASE WHEN live.member IS NULL THEN 'DRIFT removed ' || rec.member WHEN rec.member IS NULL THEN 'DRIFT added ' || live.member WHEN rec.status <> live.status THEN 'DRIFT status ' || rec.member || ' ' || rec.status || '→' || live.status END AS line FROM rec FULL JOIN live ON rec.member = live.member
UNION ALL SELECT 1, 'STALE ' || doc_id FROM documents JOIN m ON m.member = split_part(source, '/', 1) WHERE coalesce(m.changed > updated_at, true)) SELECT * FROM l WHERE line IS NOT NULL""")
def wiki_stale(s, d):
    """Members recorded and found, and documents older than the last change of their member (or without a time)."""
    f = load(s, d, "files").filter("path is not null").select("path", "indexed_at", F.substring_index("path", "/", 1).alias("member"))
    at = lambda x: F.lit(x).cast("timestamp_ntz")
    state = lambda t: t.select("member", "path").distinct().groupBy("member").agg(F.when(F.count("*") > 5, "large").otherwise("small").alias("status"))
    changed = f.groupBy("member").agg(F.max("indexed_at").alias("changed_at"))
    a = load(s, d, "documents").select(F.col("doc_id").cast("string").alias("artefact"), F.substring_index("source", "/", 1).alias("member"), F.col("updated_at").alias("made_at")).join(changed, "member")
    return op.stale(state(f.filter(F.col("indexed_at") < at(OLD_END))), state(f.filter(F.col("indexed_at") >= at(NEW_START))), a)


@query("bucket_changes", f"""WITH b AS (SELECT source, title, sha256(text) AS h, updated_at FROM documents WHERE source IS NOT NULL AND title IS NOT NULL), o AS (SELECT source || '/' || title AS path, min(h) AS h FROM b WHERE updated_at < TIMESTAMP '{OLD_END}' GROUP BY 1), w AS (SELECT source || '/' || title AS path, min(h) AS h FROM b WHERE updated_at >= TIMESTAMP '{NEW_START}' GROUP BY 1)
SELECT path, status FROM (SELECT coalesce(o.path, w.path) AS path, CASE WHEN o.path IS NULL THEN 'added' WHEN w.path IS NULL THEN 'removed' WHEN o.h IS DISTINCT FROM w.h THEN 'changed' END AS status FROM o FULL JOIN w ON w.path = o.path) WHERE status IS NOT NULL""")
def bucket_changes(s, d):
    """A bucket's pages against its baseline: added, changed and removed. Without a baseline all are added."""
    b = load(s, d, "documents").filter("source is not null and title is not null").select(F.concat_ws("/", "source", "title").alias("path"), F.sha2("text", 256).alias("h"), "updated_at")
    at = lambda x: F.lit(x).cast("timestamp_ntz")
    one = lambda t: t.groupBy("path").agg(F.min("h").alias("h"))
    return diff(one(b.filter(F.col("updated_at") < at(OLD_END))), one(b.filter(F.col("updated_at") >= at(NEW_START))))


@query("topic_index", "SELECT split_part(source, '/', 1) AS member, split_part(source, '/', 2) AS topic, count(*) AS n_pages, count(*) FILTER (title IS NULL) AS n_untitled FROM documents WHERE source IS NOT NULL GROUP BY 1, 2")
def topic_index(s, d):
    """Pages per topic of a bucket."""
    p = F.split("source", "/")
    t = load(s, d, "documents").filter("source is not null")
    return t.groupBy(F.get(p, 0).alias("member"), F.coalesce(F.get(p, 1), F.lit("")).alias("topic")).agg(F.count("*").alias("n_pages"), F.count(F.when(F.col("title").isNull(), 1)).alias("n_untitled"))


# Follow-ups with each case of age and staleness: (id, kind, severity, created, review_by, rank, age, stale) as of TODAY.
FOLLOWUPS = (
    ("f1", "finding", "risk", "2026-06-01", "2026-06-15", 0, 29, True), ("f2", "finding", "nit", "2026-06-01", "2026-07-15", 1, 29, False), ("f3", "plan", "question", "2026-01-01", "2026-02-01", 2, 180, False), ("f4", "finding", "question", "2027-01-01", "soon", 2, -1, False), ("f5", "finding", "odd", "never", None, 3, -1, False),
)


@query("followup_list", "SELECT id, rank, age_days, stale FROM (" + _v(*[(r[0], *r[5:]) for r in FOLLOWUPS]) + ") AS v(id, rank, age_days, stale) ORDER BY rank, id")
def followup_list(s, d):
    """Follow-ups by severity, then id; age in days, -1 for a date in the future or none; stale past the day of review,
    except plans and days that can't be read. Over fixed follow-ups: the stored ones (severity_list) have no day of review."""
    f = s.createDataFrame([r[:5] for r in FOLLOWUPS], "id string, kind string, severity string, created string, review_by string")
    day, today = (lambda c: F.col(c).try_cast("date")), F.lit(TODAY).cast("date")
    rank = F.when(F.col("severity") == "risk", 0).when(F.col("severity") == "nit", 1).when(F.col("severity") == "question", 2).otherwise(3)
    age = F.when(day("created").isNull() | (day("created") > today), -1).otherwise(F.datediff(today, day("created")))
    stale = F.coalesce((today > day("review_by")) & (F.col("kind") != "plan"), F.lit(False))
    return f.select("id", rank.alias("rank"), age.alias("age_days"), stale.alias("stale")).orderBy("rank", "id")


_PLANS = "SELECT split_part(path, '/', 1) || '/' || split_part(path, '/', 2) AS slug, path AS doc, content_hash AS sha, min(member) AS checkout, max(indexed_at) AS tm FROM files WHERE path IS NOT NULL AND content_hash IS NOT NULL GROUP BY 1, 2, 3"


@query("plan_rows", f"WITH v AS ({_PLANS}), d AS (SELECT slug, doc, count(*) AS n, max(tm) AS tm, string_agg(substr(sha, 1, 7) || '@' || coalesce(checkout, ''), ' ' ORDER BY tm DESC, sha) AS versions FROM v GROUP BY 1, 2) SELECT slug, count(*) AS n_docs, sum(n)::BIGINT AS n_versions, epoch_us(max(tm)) AS updated_us, string_agg(doc || ': ' || versions, '; ' ORDER BY doc) AS docs FROM d GROUP BY slug ORDER BY updated_us DESC, slug")
def plan_rows(s, d):
    """Rows of plans: slug, its documents, the versions of each (newest first) with a checkout, last update; newest rows
    first. Versions are made distinct before they are nested; the nesting is by document, then by slug."""
    p = F.split("path", "/")
    f = load(s, d, "files").filter("path is not null and content_hash is not null")
    v = f.groupBy(F.concat_ws("/", F.get(p, 0), F.coalesce(F.get(p, 1), F.lit(""))).alias("slug"), F.col("path").alias("doc"), F.col("content_hash").alias("sha")).agg(F.min("member").alias("checkout"), F.max("indexed_at").alias("at"))
    label = F.concat(F.substring("sha", 1, 7), F.lit("@"), F.coalesce("checkout", F.lit("")))
    one = v.groupBy("slug", "doc").agg(F.count("*").alias("n"), F.max("at").alias("at"), F.array_sort(F.collect_list(F.struct((-F.unix_micros(F.col("at").cast("timestamp"))).alias("o"), "sha", label.alias("label")))).alias("x"))
    one = one.withColumn("line", F.concat("doc", F.lit(": "), F.array_join(F.transform("x", lambda e: e["label"]), " ")))
    out = one.groupBy("slug").agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_versions"), F.unix_micros(F.max("at").cast("timestamp")).alias("updated_us"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc", "line"))), lambda e: e["line"]), "; ").alias("docs"))
    return out.orderBy(F.desc("updated_us"), "slug")


# a member inside another one: the longest prefix wins
_NESTED = ("aldermoor/src", "aldermoor-src")


@query("member_route", sql(f"SELECT f.path, arg_max(m.member, length(m.root)) AS member FROM f JOIN (SELECT member, member AS root FROM members UNION ALL VALUES ('{_NESTED[1]}', '{_NESTED[0]}')) m ON f.path = m.root OR starts_with(f.path, m.root || '/') GROUP BY f.path"))
def member_route(s, d):
    """M4: the member whose root is the longest prefix of a path: an equi-join of the roots with all beginnings of each path."""
    m = load(s, d, "members").select("member", F.col("member").alias("root")).union(s.createDataFrame([(_NESTED[1], _NESTED[0])], "member string, root string"))
    p = F.split("path", "/")
    f = model.files(s, d, "path", "language").select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(p)), lambda i: F.array_join(F.slice(p, 1, i), "/"))).alias("root"))
    return f.join(m, "root").groupBy("path").agg(F.max(F.struct(F.length("root").alias("n"), "member")).alias("x")).select("path", "x.member")


@query("change_events", f"WITH {_SNAP}, c AS (SELECT coalesce(o.path, w.path) AS path FROM (SELECT * FROM old WHERE path IS NOT NULL) o FULL JOIN (SELECT * FROM new WHERE path IS NOT NULL) w ON w.path = o.path WHERE o.path IS NULL OR w.path IS NULL OR o.h IS DISTINCT FROM w.h) SELECT split_part(path, '/', 1) AS member, count(*) AS n_changed, CASE WHEN count(*) <= 100 THEN string_agg(path, ',' ORDER BY path) END AS paths FROM c GROUP BY 1")
def change_events(s, d):
    """Changed paths of each member; the list is left out where there are more than a hundred."""
    from arborweft.plans.drift import manifests
    from arborweft.streaming.bus import change_event

    old, new = manifests(s, d)
    c = diff(old.filter("path is not null"), new.filter("path is not null")).select("path", F.substring_index("path", "/", 1).alias("member"))
    return change_event(c, "member")
