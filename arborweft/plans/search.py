"""Search, context and flow queries."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from arborweft.operators import model, traverse
from arborweft.operators import search as op
from arborweft.operators.model import sql
from arborweft.plans.graph import _CALLER, _caller
from arborweft.sources.tables import Scratch, load

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
TEXT = "encode cache"


def query(name: str, oracle: str | None = None):
    def put(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLE[name] = oracle
        return fn

    return put


_COLS = ("id", "kind", "name", "qualified_name", "file_path", "language", "signature", "docstring", "is_exported")


def _nodes(s, d):
    return model.nodes(s, d, *_COLS)


_BONUS = "CAST(CASE " + " ".join(f"WHEN kind IN ({', '.join(repr(k) for k in ks)}) THEN {v}.0" for v, ks in op.KIND_BONUS.items()) + " ELSE 0.0 END AS DOUBLE)"
_PATHREL = "CAST(CASE WHEN coalesce(file_path, '') = '' THEN 0.0 ELSE greatest(0.0, 5.0 - 0.5 * (length(file_path) - length(replace(file_path, '/', '')))) END AS DOUBLE)"
_TEST = "coalesce(regexp_matches(lower(file_path), '(^|/)(test|spec|__tests__)(/|$)') OR regexp_matches(string_split(lower(file_path), '/')[-1], '_test\\.|\\.test\\.|\\.spec\\.'), false)"


def _named(q: str) -> str:
    return f"CASE WHEN lower(name) = '{q}' THEN 5.0 WHEN starts_with(lower(name), '{q}') THEN 3.0 WHEN contains(lower(name), '{q}') THEN 1.0 ELSE 0.0 END"


def _toks(c: str) -> str:
    return f"list_filter(regexp_split_to_array(lower(coalesce({c}, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')"


def _fts_sql(text: str, limit: int = 20) -> str:
    terms = text.lower().split()
    w = op.WEIGHTS
    tok = ", ".join(f"{_toks(c)} AS t_{c}" for c in w)
    tf = ", ".join("(" + " + ".join(f"{v} * len(list_filter(t_{c}, lambda t: starts_with(t, '{q}')))" for c, v in w.items()) + f") AS tf{i}, (" + " + ".join(f"len(list_filter(t_{c}, lambda t: starts_with(t, '{q}')))" for c in w) + f") > 0 AS has{i}" for i, q in enumerate(terms))
    ln = " + ".join(f"len(t_{c})" for c in w)
    st = ", ".join(f"count(*) FILTER (has{i}) AS df{i}" for i in range(len(terms)))
    sc = " + ".join(f"CASE WHEN has{i} THEN greatest(1e-6, ln((st.n - df{i} + 0.5) / (df{i} + 0.5))) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * len / av)) ELSE 0.0 END" for i in range(len(terms)))
    anyh = " OR ".join(f"has{i}" for i in range(len(terms)))
    return sql(f""", a AS (SELECT *, {tok} FROM n), b AS (SELECT *, {ln} AS len, {tf} FROM a), st AS (SELECT count(*) AS n, avg(len) AS av, {st} FROM b),
c AS (SELECT b.*, {sc} AS bm FROM b, st WHERE {anyh}), top AS (SELECT * FROM c ORDER BY round(bm, 9) DESC, id LIMIT {limit * op.OVERFETCH}),
z AS (SELECT id, kind, name, file_path, round(bm + {_BONUS} + {_PATHREL} + {_named(text)} - CASE WHEN {_TEST} THEN 15.0 ELSE 0.0 END, 6) AS score, 'fts' AS tier FROM top)
SELECT * FROM z ORDER BY score DESC, id LIMIT {limit}""")


@query("search_fts_bm25", _fts_sql(TEXT))
def search_fts_bm25(s, d):
    """Q2-Q8: weighted BM25 with token prefixes, over-fetched, rescored and cut to 20."""
    return op.fts(_nodes(s, d), op.Query.parse(TEXT), TEXT)


@query("search_like", sql(f"SELECT id, kind, name, file_path, round(base + {_BONUS} + {_PATHREL}, 6) AS score, 'like' AS tier FROM (SELECT *, CASE WHEN lower(name) = 'decode' THEN 1.0 WHEN starts_with(lower(name), 'decode') THEN 0.9 WHEN contains(lower(name), 'decode') THEN 0.8 WHEN contains(lower(qualified_name), 'decode') THEN 0.7 END AS base FROM n) WHERE base IS NOT NULL ORDER BY score DESC, id LIMIT 20"))
def search_like(s, d):
    """Q10."""
    return op.like(_nodes(s, d), op.Query("decode"))


@query("search_filter", sql(f"SELECT id, kind, name, file_path, round({_BONUS} + {_PATHREL} + CASE WHEN coalesce(is_exported, false) THEN 1.0 ELSE 0.0 END + {_named('cache')}, 6) AS score, 'filter' AS tier FROM n WHERE kind = 'function' AND language = 'go' AND contains(file_path, '/src/') AND contains(lower(name), 'cache') ORDER BY score DESC, id LIMIT 20"))
def search_filter(s, d):
    """Q9, Q13."""
    return op.search(_nodes(s, d), "kind:function lang:go path:/src/ name:cache")


@query("search_fuzzy", sql(f"SELECT id, kind, name, file_path, round((3.0 - damerau_levenshtein('limti', lower(name))) / 3.0 + {_BONUS} + {_PATHREL}, 6) AS score, 'fuzzy' AS tier FROM n WHERE abs(strlen(lower(name)) - 5) <= 2 AND damerau_levenshtein('limti', lower(name)) <= 2 ORDER BY score DESC, id LIMIT 20"))
def search_fuzzy(s, d):
    """Q11, Q12. On these names the SQL's unrestricted swaps give the same distances; tests compare with brute force."""
    return op.fuzzy(_nodes(s, d), op.Query("limTi"))


@query("search_tiered", sql(f"SELECT id, kind, name, file_path, round((3.0 - damerau_levenshtein('twgi0', lower(name))) / 3.0 + {_BONUS} + {_PATHREL}, 6) AS score, 'fuzzy' AS tier FROM n WHERE abs(strlen(lower(name)) - 5) <= 2 AND damerau_levenshtein('twgi0', lower(name)) <= 2 ORDER BY score DESC, id LIMIT 20"))
def search_tiered(s, d):
    """Q14, Q15: a misspelt name falls through the first two tiers to the fuzzy one."""
    return op.search(_nodes(s, d), "twgi0")


@query("kind_bonus", sql(f"SELECT kind, any_value({_BONUS}) AS bonus, count(*) AS n, round(sum({_PATHREL}), 6) AS relevance, CAST(sum(CASE WHEN {_TEST} THEN 1 ELSE 0 END) AS BIGINT) AS n_test FROM n GROUP BY kind"))
def kind_bonus(s, d):
    """Q5, Q6, Q8 over all nodes."""
    n = model.nodes(s, d, "id", "kind", "file_path")
    return n.groupBy("kind").agg(F.any_value(op.kind_bonus(F.col("kind"))).alias("bonus"), F.count("*").alias("n"), F.round(F.sum(op.path_relevance(F.col("file_path"))), 6).alias("relevance"), F.sum(op.in_test_file(F.col("file_path")).cast("long")).alias("n_test"))


_FED = "roster"


def _federated_sql() -> str:
    w = op.WEIGHTS
    tok = ", ".join(f"{_toks(c)} AS t_{c}" for c in w)
    hits = lambda c: f"len(list_filter(t_{c}, lambda t: starts_with(t, '{_FED}')))"
    return sql(f""", a AS (SELECT *, split_part(file_path, '/', 1) AS member, {tok} FROM n WHERE split_part(file_path, '/', 1) <> 'aldermoor'),
b AS (SELECT *, {" + ".join(f"len(t_{c})" for c in w)} AS len, {" + ".join(f"{v} * {hits(c)}" for c, v in w.items())} AS tf, ({" + ".join(hits(c) for c in w)}) > 0 AS has FROM a),
st AS (SELECT member, count(*) AS n, avg(len) AS av, count(*) FILTER (has) AS df FROM b GROUP BY member),
z AS (SELECT b.member, id, name, round(greatest(1e-6, ln((st.n - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / av)) + {_BONUS} + {_PATHREL} + {_named(_FED)} - CASE WHEN {_TEST} THEN 15.0 ELSE 0.0 END, 6) AS score FROM b JOIN st ON st.member = b.member WHERE has),
k AS (SELECT *, row_number() OVER (PARTITION BY member ORDER BY score DESC, id) AS rn FROM z)
SELECT members.member, id, name, score, rn FROM members LEFT JOIN k ON k.member = members.member AND rn <= 5 WHERE members.member <> 'aldermoor'""")


@query("federated_search", _federated_sql())
def federated_search(s, d):
    """Q17, M2, M3: the ranked search of every member (the best five; the cut is the feature) in one job; members without a hit
    keep a row of nulls."""
    n = _nodes(s, d).withColumn("member", F.substring_index("file_path", "/", 1))
    k = op.members_search(n, _FED, exclude=("aldermoor",))
    return load(s, d, "members").select("member").filter("member <> 'aldermoor'").join(k, "member", "left")


_GREP = "callers must hold"


@query("line_grep", f"SELECT path, line_no, decode(encode(trim(line, chr(9) || ' ' || chr(13)))[1:120]) AS snippet, n > 50 AS truncated FROM (SELECT path, line, line_no, count(*) OVER () AS n FROM (SELECT path, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS line_no FROM source_texts WHERE content IS NOT NULL) WHERE contains(lower(line), '{_GREP}') ORDER BY path, line_no LIMIT 50)")
def line_grep(s, d):
    """Q16: lines that hold a text in any letter case, the first 50 by path and line (the cap is the feature) with the flag that
    more were found; snippets are trimmed, then cut to 120 bytes. The file is tested before it is split into lines."""
    t = load(s, d, "source_texts").filter(F.lower("content").contains(_GREP)).select("path", F.posexplode(F.split("content", "\n")).alias("i", "line"))
    hit = t.filter(F.lower("line").contains(_GREP))
    some = hit.orderBy("path", "i").limit(51)  # one more than the cap tells that there are more
    n = some.count()
    cut = F.decode(F.substring(F.encode(F.trim("line", F.lit("\t \r")), "UTF-8"), 1, 120), "UTF-8")
    return some.orderBy("path", "i").limit(50).select("path", (F.col("i") + 1).cast("long").alias("line_no"), cut.alias("snippet"), F.lit(n > 50).alias("truncated"))


# --- context (X1-X6), call chains and flow (G27, G28) ------------------------------------------------------------------

CONTEXT = "rotate token"


def _seeds_sql() -> str:
    one = _fts_sql(CONTEXT)
    by_name = f"SELECT id FROM (SELECT id, round({_BONUS} + {_PATHREL} + CASE WHEN coalesce(is_exported, false) THEN 1.0 ELSE 0.0 END + {_named(CONTEXT)}, 6) AS score FROM n WHERE contains(lower(name), '{CONTEXT}') ORDER BY score DESC, id LIMIT 20)"
    return one, by_name


_FTS_SEEDS, _NAME_SEEDS = _seeds_sql()
_HEAD, _SEP, _TAIL_SQL = _FTS_SEEDS.rpartition("SELECT * FROM z")
_ST = f"{_HEAD.rstrip()}, hit AS (SELECT id FROM z{_TAIL_SQL}), nm AS ({_NAME_SEEDS}), sd AS (SELECT id FROM hit UNION SELECT id FROM nm)"


@query("context_seeds", f"{_ST} SELECT n.id, n.kind, n.name, n.file_path FROM n JOIN sd ON sd.id = n.id")
def context_seeds(s, d):
    """Seed symbols of a context: the search for the text, and for names that hold it."""
    n = Scratch(s, "nodes").write(_nodes(s, d))
    hit = op.search(n, CONTEXT).select("id").union(op.filters_only(n, op.Query(name=CONTEXT)).select("id")).distinct()
    return n.join(hit, "id", "left_semi").select("id", "kind", "name", "file_path")


@query("edge_dedup_provenance", sql("SELECT source, target, kind, id, coalesce(provenance, '') AS provenance FROM e QUALIFY row_number() OVER (PARTITION BY source, target, kind ORDER BY CASE WHEN provenance = 'heuristic' THEN 0 ELSE 1 END, id) = 1"))
def edge_dedup_provenance(s, d):
    """One edge per source, target and kind; heuristic provenance wins, else the least id. An aggregation with a
    map-side combine, no window."""
    e = load(s, d, "edges").groupBy("source", "target", "kind").agg(F.min(F.struct(F.when(F.col("provenance") == "heuristic", 0).otherwise(1).alias("o"), "id", F.coalesce("provenance", F.lit("")).alias("provenance"))).alias("m"))
    return e.select("source", "target", "kind", "m.id", "m.provenance")


def context_nodes(s, d):
    """Seeds (0), what they reach as callees (1) and as callers (2) within depth 2; the least label holds."""
    e = load(s, d, "edges").select("id", "source", "target", "kind")
    st = Scratch(s, "seeds").write(context_seeds(s, d).select(F.col("id").alias("origin"), "id"))
    down, _ = traverse.bfs(e, st, 2, False, traverse.CALL_KINDS)
    up, _ = traverse.bfs(e, st, 2, True, traverse.CALL_KINDS)
    lab = lambda t, k: t.select("id", F.when(F.col("depth") == 0, 0).otherwise(k).alias("label"))
    return lab(down, 1).union(lab(up, 2)).groupBy("id").agg(F.min("label").alias("label"))


@query("context_labels", f"""{_ST}, dn(o, id, d) AS (SELECT id, id, 0 FROM sd UNION SELECT o, e.target, d + 1 FROM dn JOIN e ON e.source = dn.id AND e.kind IN ('calls', 'references', 'imports') WHERE d < 2 AND e.target IS NOT NULL),
up(o, id, d) AS (SELECT id, id, 0 FROM sd UNION SELECT o, e.source, d + 1 FROM up JOIN e ON e.target = up.id AND e.kind IN ('calls', 'references', 'imports') WHERE d < 2 AND e.source IS NOT NULL)
SELECT id, min(label) AS label FROM (SELECT id, CASE WHEN d = 0 THEN 0 ELSE 1 END AS label FROM dn UNION ALL SELECT id, CASE WHEN d = 0 THEN 0 ELSE 2 END FROM up) GROUP BY id""")
def context_labels(s, d):
    return context_nodes(s, d)


def _capped(per_file: int, per_kind: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files: dict = {}
        kinds: dict = {}
        for b in batches:
            keep = []
            for i, (label, path, kind) in enumerate(zip(b.column(1).to_pylist(), b.column(3).to_pylist(), b.column(2).to_pylist())):
                if label and (files.get(path, 0) >= per_file or kinds.get(kind, 0) >= per_kind):
                    continue
                files[path] = files.get(path, 0) + 1
                kinds[kind] = kinds.get(kind, 0) + 1
                keep.append(i)
            yield b.take(pa.array(keep, pa.int64()))

    return run


@query("diversity_cap")
def diversity_cap(s, d):
    """At most 5 nodes a file and 8 a kind, greedy in order of label and id; seeds are exempt but counted. The caps depend
    on each other, so the candidates go through one task; with both caps bounded, so is what is kept. Candidates come from
    a walk of bounded depth. No SQL: greedy choice; tests compare with a plain loop."""
    c = context_nodes(s, d).join(model.nodes(s, d, "id", "kind", "file_path"), "id").select("id", "label", "kind", "file_path")
    # cuts that lose nothing bound the single task: a file takes 5 of a kind at most; at most 8 of each of 39 kinds are kept,
    # so with 20 seeds at most 66 files get full, and a kind's first 8 + 66 * 5 candidates hold all that can be kept of it
    first = lambda *k: F.row_number().over(Window.partitionBy(*k).orderBy("label", "id"))
    some = c.filter("label > 0").withColumn("rn", first("kind", "file_path")).filter("rn <= 5").withColumn("rn", first("kind")).filter("rn <= 338").drop("rn")
    few = c.filter("label = 0").union(some)
    return few.coalesce(1).sortWithinPartitions("label", "id").mapInArrow(_capped(5, 8), "id string, label int, kind string, file_path string")


@query("context_pack")
def context_pack(s, d):
    """What a context shows: the nodes that the caps leave, the edges between them (once per source, target and kind,
    heuristic ones first) in fixed order as one JSON row each, and whether the caps took anything away."""
    nodes = Scratch(s, "labels").write(context_nodes(s, d))
    kept = Scratch(s, "kept").write(diversity_cap(s, d).select("id", "label"))
    cut = kept.count() < nodes.count()
    e = load(s, d, "edges").select("id", "source", "target", "kind", "provenance")
    e = e.join(kept.select(F.col("id").alias("source")), "source", "left_semi").join(kept.select(F.col("id").alias("target")), "target", "left_semi")
    e = e.groupBy("source", "target", "kind").agg(F.min(F.struct(F.when(F.col("provenance") == "heuristic", 0).otherwise(1).alias("o"), "id", F.coalesce("provenance", F.lit("")).alias("provenance"))).alias("m"))
    edges = e.select(F.lit("edge").alias("part"), F.concat_ws(">", "source", "target", "kind").alias("key"), F.to_json(F.struct("source", "target", "kind", F.col("m.provenance").alias("provenance"))).alias("json"))
    n = model.latest(load(s, d, "nodes").join(kept.select("id"), "id", "left_semi"), "id", "updated_at", ["id", "kind", "name", "file_path"]).join(kept, "id")
    nodes = n.select(F.lit("node").alias("part"), F.col("id").alias("key"), F.to_json(F.struct("id", "kind", "name", "file_path", "label")).alias("json"))
    return nodes.union(edges).withColumn("truncated", F.lit(cut)).orderBy(F.desc("part"), "key")


@query(
    "call_chains",
    sql(f""", st AS {_CALLER}, c AS (SELECT DISTINCT source, target FROM e WHERE kind = 'calls' AND target NOT LIKE 'package:%' AND source IS NOT NULL), w(chain, id, n, looped) AS (SELECT [id], id, 1, false FROM st UNION ALL
SELECT list_append(w.chain, c.target), c.target, n + 1, list_contains(w.chain, c.target) FROM w JOIN c ON c.source = w.id WHERE n < 6 AND NOT looped)
SELECT array_to_string(chain, ' > ') AS chain, n FROM w WHERE n > 1 AND (looped OR n = 6 OR NOT EXISTS (SELECT 1 FROM c WHERE c.source = w.id))"""),
)
def call_chains(s, d):
    """All call chains from one symbol, at most six long; a chain that meets itself ends there. Chains are rows, one
    bounded join per step."""
    c = Scratch(s, "calls").write(load(s, d, "edges").filter("kind = 'calls' and source is not null and target not like 'package:%'").select("source", "target").distinct())
    st = _caller(load(s, d, "edges").select("id", "source", "target", "kind"))
    cur = st.select(F.array("id").alias("chain"), F.col("id").alias("source"))
    scratch, out = Scratch(s, "chains"), None
    for n in range(2, 7):
        step = cur.join(c, "source", "left").select("chain", "target")
        ended = step.filter("target is null").select("chain")
        more = scratch.write(step.filter("target is not null").select(F.concat("chain", F.array("target")).alias("chain"), F.col("target").alias("source"), F.array_contains("chain", F.col("target")).alias("looped")))
        done = more.filter("looped").select("chain").union(ended.filter(F.size("chain") > 1))
        out = done if out is None else out.union(done)
        cur = more.filter("not looped").select("chain", "source")
    out = out.union(cur.select("chain"))
    return out.select(F.array_join("chain", " > ").alias("chain"), F.size("chain").alias("n"))


@query("graph_json", sql("SELECT id, '{\"kind\":\"' || kind || '\",\"name\":\"' || name || '\",\"line\":' || coalesce(start_line, 0) || '}' AS json FROM n WHERE kind = 'class'"))
def graph_json(s, d):
    """Nodes as JSON."""
    return model.nodes(s, d, "id", "kind", "name", "start_line").filter("kind = 'class'").select("id", F.to_json(F.struct("kind", "name", F.coalesce("start_line", F.lit(0)).alias("line"))).alias("json"))
