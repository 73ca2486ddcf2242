"""Scans, diffs, ledgers, the SQL schema view and interval owners, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arborweft.functions.text import glob_regex
from arborweft.operators import intervals, model
from arborweft.operators.model import sql
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


OLD_END, NEW_START, TODAY = "2025-11-01", "2025-04-01", "2026-06-30"
_SNAP = f"""old AS (SELECT path, arg_max(content_hash, indexed_at) AS h FROM files WHERE indexed_at < TIMESTAMP '{OLD_END}' GROUP BY path),
new AS (SELECT path, arg_max(content_hash, indexed_at) AS h FROM files WHERE indexed_at >= TIMESTAMP '{NEW_START}' GROUP BY path)"""


def manifests(s, d) -> tuple[DataFrame, DataFrame]:
    """(path, h) of two states of the files: as of OLD_END, and what was indexed since NEW_START."""
    f = load(s, d, "files").select("path", "content_hash", "indexed_at")
    last = lambda t: t.groupBy("path").agg(F.max(F.struct("indexed_at", "content_hash")).alias("x")).select("path", F.col("x.content_hash").alias("h"))
    return last(f.filter(F.col("indexed_at") < F.lit(OLD_END).cast("timestamp_ntz"))), last(f.filter(F.col("indexed_at") >= F.lit(NEW_START).cast("timestamp_ntz")))


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, status): added, removed or changed between two manifests (path, h); equal entries give no row."""
    j = old.withColumnRenamed("h", "h0").withColumn("o", F.lit(True)).join(new.withColumn("w", F.lit(True)), "path", "full")
    st = F.when(F.col("o").isNull(), "added").when(F.col("w").isNull(), "removed").when(~F.col("h0").eqNullSafe(F.col("h")), "changed")
    return j.select("path", st.alias("status")).filter("status is not null")


@query("manifest_diff", f"WITH {_SNAP} SELECT coalesce(old.path, new.path) AS path, CASE WHEN old.path IS NULL THEN 'added' WHEN new.path IS NULL THEN 'removed' ELSE 'changed' END AS status FROM old FULL JOIN new ON old.path = new.path WHERE old.path IS NULL OR new.path IS NULL OR old.h IS DISTINCT FROM new.h")
def manifest_diff(s, d):
    """Added, removed and changed files between two states."""
    return diff(*manifests(s, d))


@query("line_delta", "WITH a AS (SELECT path, unnest(string_split(content, chr(10))) AS line, 1 AS w FROM source_texts WHERE content IS NOT NULL UNION ALL SELECT path, unnest(string_split(replace(content, chr(13), ''), chr(10))), -1 FROM source_texts WHERE content IS NOT NULL) SELECT path, sum(abs(w))::BIGINT AS delta FROM (SELECT path, line, sum(w) AS w FROM a GROUP BY 1, 2) GROUP BY path HAVING sum(abs(w)) > 0")
def line_delta(s, d):
    """Multiset difference of the lines of two versions (here: with and without carriage returns), in lines. Content
    decides, not time. One pass with signed counts; only texts that differ are split."""
    t = load(s, d, "source_texts").filter(F.col("content").contains("\r")).select("path", "content")
    both = t.select("path", F.explode(F.array(F.struct(F.col("content").alias("c"), F.lit(1).alias("w")), F.struct(F.replace("content", F.lit("\r"), F.lit("")).alias("c"), F.lit(-1).alias("w")))).alias("x"))
    lines = both.select("path", F.explode(F.split("x.c", "\n")).alias("line"), F.col("x.w").alias("w")).groupBy("path", "line").agg(F.sum("w").alias("w"))
    return lines.groupBy("path").agg(F.sum(F.abs("w")).alias("delta")).filter("delta > 0")


@query("language_stats", sql("SELECT language, loc, n_files, CAST(floor(100.0 * loc / sum(loc) OVER ()) AS BIGINT) AS pct FROM (SELECT f.language, sum(len(string_split(content, chr(10))))::BIGINT AS loc, count(*) AS n_files FROM f JOIN source_texts t ON t.path = f.path WHERE content IS NOT NULL GROUP BY 1) ORDER BY loc DESC, n_files DESC, language LIMIT 10"))
def language_stats(s, d):
    """Lines, files and whole percent per language, the ten largest (the cut is the feature)."""
    t = load(s, d, "source_texts").filter("content is not null").select("path", F.size(F.split("content", "\n")).alias("n"))
    per = model.files(s, d, "path", "language").join(t, "path").groupBy("language").agg(F.sum("n").alias("loc"), F.count("*").alias("n_files"))
    total = per.agg(F.sum("loc")).first()[0] or 1  # one number over a few languages
    return per.withColumn("pct", F.floor(F.lit(100.0) * F.col("loc") / total)).orderBy(F.desc("loc"), F.desc("n_files"), "language").limit(10)


@query("file_meta", "SELECT path, substr(sha256(content), 1, 7) AS sha7, len(string_split(content, chr(10))) - CASE WHEN ends_with(content, chr(10)) OR content = '' THEN 1 ELSE 0 END AS n_lines, length(content) AS n_chars, strlen(content) AS n_bytes FROM source_texts WHERE content IS NOT NULL")
def file_meta(s, d):
    """C2."""
    c = F.col("content")
    return load(s, d, "source_texts").filter("content is not null").select("path", F.substring(F.sha2(c, 256), 1, 7).alias("sha7"), (F.size(F.split(c, "\n")) - F.when(c.endswith("\n") | (c == ""), 1).otherwise(0)).cast("long").alias("n_lines"), F.length(c).cast("long").alias("n_chars"), F.octet_length(c).cast("long").alias("n_bytes"))


_FU = """fu AS (SELECT doc_id, regexp_extract(text, '^---\\n(?:[^\\n]*\\n)*?id: ([^\\n]*)', 1) AS fid, regexp_extract(text, '^---\\n(?:[^\\n]*\\n)*?severity: ([^\\n]*)', 1) AS severity, regexp_extract(text, '^---\\n(?:[^\\n]*\\n)*?status: ([^\\n]*)', 1) AS status, updated_at FROM documents WHERE starts_with(text, '---' || chr(10)))"""
_RANK = "CASE severity WHEN 'risk' THEN 0 WHEN 'high' THEN 0 WHEN 'nit' THEN 1 WHEN 'medium' THEN 1 WHEN 'question' THEN 2 ELSE 3 END"
_AGE = f"CASE WHEN updated_at IS NULL OR CAST(updated_at AS DATE) > DATE '{TODAY}' THEN -1 ELSE date_diff('day', CAST(updated_at AS DATE), DATE '{TODAY}') END"


def followups(s, d) -> DataFrame:
    """Follow-ups: documents with front matter. Fields that are missing are ''."""
    field = lambda k: F.regexp_extract("text", f"^---\\n(?:[^\\n]*\\n)*?{k}: ([^\\n]*)", 1)
    t = load(s, d, "documents").filter(F.col("text").startswith("---\n"))
    return t.select("doc_id", field("id").alias("fid"), field("severity").alias("severity"), field("status").alias("status"), "updated_at")


def _age(at):
    day = F.to_date(at)
    return F.when(day.isNull() | (day > F.lit(TODAY).cast("date")), -1).otherwise(F.datediff(F.lit(TODAY).cast("date"), day))


@query("severity_list", f"WITH {_FU} SELECT doc_id, fid, severity, status, {_RANK} AS rank, {_AGE} AS age_days, status = 'open' AND {_AGE} > 90 AS stale FROM fu")
def severity_list(s, d):
    """Rank by severity, age in days (-1 for a future or missing date), stale after 90 days when open."""
    f = followups(s, d)
    rank = F.when(F.col("severity").isin("risk", "high"), 0).when(F.col("severity").isin("nit", "medium"), 1).when(F.col("severity") == "question", 2).otherwise(3)
    return f.select("doc_id", "fid", "severity", "status", rank.alias("rank"), _age("updated_at").cast("long").alias("age_days"), ((F.col("status") == "open") & (_age("updated_at") > 90)).alias("stale"))


@query("severity_counts", f"WITH {_FU} SELECT severity, count(*) AS n, sum(CASE WHEN status = 'open' THEN 1 ELSE 0 END)::BIGINT AS n_open, sum(CASE WHEN status = 'open' AND {_AGE} > 90 THEN 1 ELSE 0 END)::BIGINT AS n_stale FROM fu GROUP BY severity")
def severity_counts(s, d):
    """C11."""
    opened = F.col("status") == "open"
    return followups(s, d).groupBy("severity").agg(F.count("*").alias("n"), F.sum(opened.cast("long")).alias("n_open"), F.sum((opened & (_age("updated_at") > 90)).cast("long")).alias("n_stale"))


@query("pending_changes", sql("SELECT f.language, count(*) AS n_files, sum(CASE WHEN t.path IS NULL OR t.content_hash IS DISTINCT FROM f.content_hash THEN 1 ELSE 0 END)::BIGINT AS n_pending FROM f LEFT JOIN source_texts t ON t.path = f.path GROUP BY 1"))
def pending_changes(s, d):
    """Files whose stored text is missing or has another hash."""
    t = load(s, d, "source_texts").select("path", F.col("content_hash").alias("h"))
    j = model.files(s, d, "path", "language", "content_hash").join(t, "path", "left")
    return j.groupBy("language").agg(F.count("*").alias("n_files"), F.sum((~F.col("h").eqNullSafe(F.col("content_hash"))).cast("long")).alias("n_pending"))


@query("staleness_nudge", sql(f"SELECT split_part(path, '/', 1) AS member, bool_or(len(errors) > 0) AS dirty, max(date_diff('day', CAST(indexed_at AS DATE), DATE '{TODAY}')) AS oldest_days, CASE WHEN bool_or(len(errors) > 0) THEN 'dirty' WHEN max(date_diff('day', CAST(indexed_at AS DATE), DATE '{TODAY}')) > 400 THEN 'stale' ELSE 'fresh' END AS state FROM f GROUP BY 1"))
def staleness_nudge(s, d):
    """A dirty mark outranks age."""
    f = model.files(s, d, "path", "errors", "indexed_at")
    age = F.datediff(F.lit(TODAY).cast("date"), F.to_date("indexed_at"))
    g = f.groupBy(F.substring_index("path", "/", 1).alias("member")).agg(F.max(F.size("errors") > 0).alias("dirty"), F.max(age).cast("long").alias("oldest_days"))
    return g.withColumn("state", F.when(F.col("dirty"), "dirty").when(F.col("oldest_days") > 400, "stale").otherwise("fresh"))


@query("tree_counts", sql("SELECT array_to_string(string_split(path, '/')[1:k], '/') AS folder, k AS depth, count(*) AS n_files, sum(size)::BIGINT AS bytes FROM (SELECT path, size, unnest(generate_series(1, len(string_split(path, '/')) - 1)) AS k FROM f) GROUP BY 1, 2"))
def tree_counts(s, d):
    """Files and bytes under every folder. Each path is repeated per ancestor and combined on the map side."""
    parts = F.split("path", "/")
    t = model.files(s, d, "path", "size").filter(F.size(parts) > 1).select("path", "size", F.explode(F.sequence(F.lit(1), F.size(parts) - 1)).alias("depth"))
    return t.groupBy(F.array_join(F.slice(parts, 1, F.col("depth")), "/").alias("folder"), F.col("depth").cast("long").alias("depth")).agg(F.count("*").alias("n_files"), F.sum("size").alias("bytes"))


@query("bucket_diff", f"WITH b AS (SELECT source AS bucket, title, sha256(text) AS h, updated_at FROM documents WHERE source IS NOT NULL AND title IS NOT NULL), o AS (SELECT DISTINCT bucket, title, h FROM b WHERE updated_at < TIMESTAMP '{OLD_END}'), w AS (SELECT DISTINCT bucket, title, h FROM b WHERE updated_at >= TIMESTAMP '{NEW_START}') SELECT coalesce(o.bucket, w.bucket) AS bucket, sum(CASE WHEN o.h IS NULL THEN 1 ELSE 0 END)::BIGINT AS n_added, sum(CASE WHEN w.h IS NULL THEN 1 ELSE 0 END)::BIGINT AS n_removed, sum(CASE WHEN o.h = w.h THEN 1 ELSE 0 END)::BIGINT AS n_kept FROM o FULL JOIN w ON o.bucket = w.bucket AND o.title = w.title AND o.h = w.h GROUP BY 1")
def bucket_diff(s, d):
    """Per wiki bucket the pages added to, removed from and kept since the baseline manifest. One aggregation over
    (bucket, title, hash) with two flags instead of a join."""
    t = load(s, d, "documents").filter("source is not null and title is not null").select(F.col("source").alias("bucket"), "title", F.sha2("text", 256).alias("h"), "updated_at")
    flag = lambda c: F.max(c.cast("int"))
    g = t.groupBy("bucket", "title", "h").agg(flag(F.coalesce(F.col("updated_at") < F.lit(OLD_END).cast("timestamp_ntz"), F.lit(False))).alias("o"), flag(F.coalesce(F.col("updated_at") >= F.lit(NEW_START).cast("timestamp_ntz"), F.lit(False))).alias("w")).filter("o + w > 0 and h is not null")
    return g.groupBy("bucket").agg(F.sum(((F.col("o") == 0)).cast("long")).alias("n_added"), F.sum((F.col("w") == 0).cast("long")).alias("n_removed"), F.sum((F.col("o") + F.col("w") == 2).cast("long")).alias("n_kept"))


@query("schema_view", sql("SELECT t.id, t.name, (SELECT count(DISTINCT c.target) FROM e c JOIN n k ON k.id = c.target AND k.kind = 'column' WHERE c.source = t.id AND c.kind = 'contains') AS n_columns, (SELECT count(DISTINCT source) FROM e WHERE e.target = t.id AND e.kind = 'references') AS n_referrers, (SELECT count(DISTINCT source) FROM e WHERE e.target = t.id AND e.kind = 'writes') AS n_writers FROM n t WHERE t.kind IN ('table', 'view')"))
def schema_view(s, d):
    """V1: per table and view its columns, distinct referrers and distinct writers."""
    n = model.nodes(s, d, "id", "kind", "name")
    e = load(s, d, "edges").select("source", "target", "kind").distinct()
    cols = e.filter("kind = 'contains'").join(n.filter("kind = 'column'").select(F.col("id").alias("target")), "target", "left_semi").groupBy(F.col("source").alias("id")).agg(F.count("*").alias("n_columns"))
    use = e.filter("kind in ('references', 'writes') and source is not null").groupBy(F.col("target").alias("id")).agg(F.sum((F.col("kind") == "references").cast("long")).alias("n_referrers"), F.sum((F.col("kind") == "writes").cast("long")).alias("n_writers"))
    t = n.filter("kind in ('table', 'view')").select("id", "name").join(cols, "id", "left").join(use, "id", "left")
    return t.select("id", "name", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_columns", "n_referrers", "n_writers")))


@query("routines_rw", sql("SELECT p.id, count(DISTINCT CASE WHEN e.kind = 'references' THEN e.target END) AS n_reads, count(DISTINCT CASE WHEN e.kind = 'writes' THEN e.target END) AS n_writes FROM n p LEFT JOIN e ON e.source = p.id WHERE p.language = 'sql' AND p.kind IN ('procedure', 'function') GROUP BY p.id"))
def routines_rw(s, d):
    """V2."""
    p = model.nodes(s, d, "id", "kind", "language").filter("language = 'sql' and kind in ('procedure', 'function')").select("id")
    e = load(s, d, "edges").filter("kind in ('references', 'writes') and target is not null").select(F.col("source").alias("id"), "target", "kind").distinct().groupBy("id").agg(F.sum((F.col("kind") == "references").cast("long")).alias("n_reads"), F.sum((F.col("kind") == "writes").cast("long")).alias("n_writes"))
    return p.join(e, "id", "left").select("id", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_reads", "n_writes")))


@query("metadata_lift", sql("SELECT id, TRY_CAST(json_extract_string(CASE WHEN json_valid(metadata) THEN metadata END, '$.loc') AS BIGINT) AS loc, json_extract_string(CASE WHEN json_valid(metadata) THEN metadata END, '$.scope') AS scope FROM n WHERE metadata IS NOT NULL"))
def metadata_lift(s, d):
    """V4: fields of the JSON metadata; unreadable JSON gives nulls."""
    return model.nodes(s, d, "id", "metadata").filter("metadata is not null").select("id", F.get_json_object("metadata", "$.loc").try_cast("long").alias("loc"), F.get_json_object("metadata", "$.scope").alias("scope"))


@query("interval_owner", sql("SELECT r.id AS ref_id, coalesce(arg_min(n.id, (n.end_line - n.start_line, n.id)), 'file:' || any_value(r.file_path)) AS owner FROM r LEFT JOIN n ON n.file_path = r.file_path AND n.kind IN ('function', 'method', 'class') AND n.start_line <= r.line AND n.end_line >= r.line WHERE r.file_path IS NOT NULL GROUP BY r.id"))
def interval_owner(s, d):
    """The narrowest symbol whose lines hold a reference, else its file. A range join in blocks of 256 lines."""
    n = model.nodes(s, d, "id", "kind", "file_path", "start_line", "end_line").filter("kind in ('function', 'method', 'class')")
    r = model.refs(s, d, "file_path", "line").filter("file_path is not null")
    return intervals.narrowest(r, n, "id").select(F.col("id").alias("ref_id"), "owner")


@query("nested_versions", "SELECT path, count(DISTINCT content_hash) AS n_versions, epoch_us(max(indexed_at)) AS updated_us, string_agg(DISTINCT substr(content_hash, 1, 7), ',' ORDER BY substr(content_hash, 1, 7)) AS versions FROM files WHERE path IS NOT NULL GROUP BY path")
def nested_versions(s, d):
    """Versions under each path. Versions are made distinct before they are nested."""
    v = load(s, d, "files").filter("path is not null").groupBy("path", "content_hash").agg(F.max("indexed_at").alias("at"))
    g = v.groupBy("path").agg(F.count("content_hash").alias("n_versions"), F.max("at").alias("at"), F.array_sort(F.collect_set(F.substring("content_hash", 1, 7))).alias("x"))
    return g.select("path", "n_versions", F.unix_micros(F.col("at").cast("timestamp")).alias("updated_us"), F.array_join("x", ",").alias("versions"))


@query("scan_filter", sql("SELECT path, CASE regexp_extract(path, '\\.([^./]+)$', 1) WHEN 'go' THEN 'go' WHEN 'py' THEN 'python' WHEN 'js' THEN 'javascript' WHEN 'ts' THEN 'typescript' WHEN 'java' THEN 'java' WHEN 'sql' THEN 'sql' END AS routed FROM f WHERE regexp_matches(path, '\\.(go|py|js|ts|java|sql)$') AND NOT regexp_matches(path, '(^|/)(node_modules|vendor)/') AND NOT regexp_matches(path, '/[^/]*\\.min\\.js$')"))
def scan_filter(s, d):
    """Routing by extension (others are skipped) and ignore globs."""
    ext = F.regexp_extract("path", r"\.([^./]+)$", 1)
    routes = {"go": "go", "py": "python", "js": "javascript", "ts": "typescript", "java": "java", "sql": "sql"}
    lang = F.create_map(*[F.lit(x) for kv in routes.items() for x in kv])
    ignored = F.col("path").rlike("(^|/)(node_modules|vendor)/") | F.substring_index("path", "/", -1).rlike(glob_regex("*.min.js"))
    return model.files(s, d, "path", "language").filter(ext.isin(*routes) & ~ignored).select("path", F.try_element_at(lang, ext).alias("routed"))


@query("prune_deleted", sql("SELECT f.path, f.language FROM f WHERE path NOT IN (SELECT path FROM source_texts WHERE content IS NOT NULL)"))
def prune_deleted(s, d):
    """Indexed paths without a text on disk."""
    return model.files(s, d, "path", "language").join(load(s, d, "source_texts").filter("content is not null").select("path"), "path", "left_anti").select("path", "language")


@query("identity", sql("SELECT id, CASE kind WHEN 'file' THEN 'file:' || file_path WHEN 'package' THEN 'package:npm/' || name ELSE kind || ':' || substr(sha256(file_path || ':' || kind || ':' || qualified_name || ':' || start_line), 1, 32) END AS computed FROM n WHERE file_path IS NOT NULL AND qualified_name IS NOT NULL AND start_line IS NOT NULL"))
def identity(s, d):
    """The identity formula of symbols over all nodes."""
    n = model.nodes(s, d, "id", "kind", "name", "file_path", "qualified_name", "start_line").filter("file_path is not null and qualified_name is not null and start_line is not null")
    return n.select("id", model.node_id(F.col("file_path"), F.col("kind"), F.when(F.col("kind") == "package", F.col("name")).otherwise(F.col("qualified_name")), F.col("start_line")).alias("computed"))


@query("path_member", sql("SELECT f.path, arg_max(m.member, length(m.member)) AS member, any_value(m.realm) AS realm FROM f JOIN members m ON starts_with(f.path, m.member || '/') GROUP BY f.path"))
def path_member(s, d):
    """M4: the member with the longest matching prefix. Members are few and fixed; the prefix is the first path part, an
    equi-join."""
    m = load(s, d, "members").select("member", "realm")
    return model.files(s, d, "path", "size").withColumn("member", F.substring_index("path", "/", 1)).join(m, "member").select("path", "member", "realm")
