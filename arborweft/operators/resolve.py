"""Resolution of textual references into typed edges by scored candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arborweft.functions.text import common_prefix
from arborweft.sources.tables import Scratch

# Built-in names per language family, whose references are dropped; languages of the JVM; scores; SQL object kinds;
# verbs of query builders.
BUILTINS = {
    ("javascript", "typescript"): {
        "Array", "Boolean", "Buffer", "Error", "JSON", "Math", "Number", "Object", "Promise", "RangeError", "String", "Symbol", "TypeError", "__dirname", "__filename", "clearInterval", "clearTimeout", "console", "exports", "isNaN", "isFinite",
        "module", "parseFloat", "parseInt", "process", "require", "setInterval", "setTimeout",
    },
    ("python",): {
        "Exception", "IndexError", "KeyError", "TypeError", "ValueError", "bool", "bytes", "delattr", "dict", "enumerate", "filter", "float", "getattr", "hasattr", "int", "isinstance", "issubclass", "len", "list", "map", "object", "open",
        "print", "range", "reversed", "set", "setattr", "sorted", "str", "super", "tuple", "type", "zip",
    },
    ("go",): {
        "append", "bool", "byte", "cap", "close", "complex", "copy", "delete", "error", "float32", "float64", "imag", "int", "int16", "int32", "int64", "int8", "len", "make", "new", "panic", "print", "println", "real", "recover", "rune", "string",
        "uint", "uint16", "uint32", "uint64", "uint8",
    },
    ("rust",): {"assert", "assert_eq", "assert_ne", "eprint", "eprintln", "format", "panic", "print", "println", "todo", "unimplemented", "unreachable", "vec"},
    ("java", "kotlin"): {"Boolean", "Double", "Exception", "Float", "Integer", "Long", "Math", "Object", "RuntimeException", "String", "System", "println"},
}
JVM, BIASED = ("java", "kotlin", "scala"), ("java", "cpp", "kotlin", "scala")
SAME_FILE, PROXIMITY, SAME_LANGUAGE, CROSS_LANGUAGE, AFFINITY, EXPORTED = 100.0, 80.0, 50.0, -80.0, 25.0, 10.0
SQL_KINDS = ("table", "view", "procedure", "function")
BUILDER_VERBS = {
    "call", "callproc", "column", "crossjoin", "deletefrom", "entityname", "field", "from", "from_", "fulljoin", "hascolumnname", "hastablename", "innerjoin", "insertinto", "into", "join", "joinraw", "leftjoin", "mergeinto", "replaceinto",
    "rightjoin", "selectfrom", "table", "table_", "tablename", "totable", "updatetable", "withtablename",
}
FUZZY_MAX_BYTES, FUZZY_FACTOR = 40, 0.6
#: Strategies in their order; the number stands in the results, 0 is unresolved.
FQN, IMPORT, PATH, QUALIFIED, QUALIFIED_TAIL, METHOD, SQL_EQUAL, SQL_TAIL, EXACT, FUZZY = range(1, 11)


def is_builtin(name: Column, language: Column) -> Column:
    """R2. A literal list of fixed size: no join."""
    out = F.lit(False)
    for langs, names in BUILTINS.items():
        out = out | (language.isin(*langs) & name.isin(*sorted(names)))
    return F.coalesce(out, F.lit(False))


def simple_name(name: Column) -> Column:
    """The last part of a dotted or '::' name."""
    return F.element_at(F.split(name, r"::|\."), -1)


def dirs(path: Column) -> Column:
    d = F.regexp_replace(path, "/?[^/]*$", "")
    return F.split(F.when(d == "", F.lit(".")).otherwise(d), "/")


def score(ref: str = "r", node: str = "n") -> Column:
    """Same file, path proximity, language, kind affinity, export, line distance."""
    c = lambda t, x: F.col(f"{t}.{x}")
    a, b = dirs(c(ref, "file_path")), dirs(c(node, "file_path"))
    near = F.lit(PROXIMITY) * common_prefix(a, b) / F.greatest(F.size(a), F.size(b))
    place = F.when(c(ref, "file_path") == c(node, "file_path"), F.lit(SAME_FILE)).otherwise(F.coalesce(near, F.lit(0.0)))
    known = c(ref, "language").isNotNull() & ~c(ref, "language").isin("", "unknown")
    lang = F.when(known, F.when(c(ref, "language") == c(node, "language"), SAME_LANGUAGE).otherwise(CROSS_LANGUAGE)).otherwise(0.0)
    fits = (c(ref, "reference_kind").isin("calls", "decorates") & c(node, "kind").isin("function", "method")) | ((c(ref, "reference_kind") == "instantiates") & c(node, "kind").isin("class", "struct"))
    line = F.when((c(ref, "line") > 0) & (c(node, "start_line") > 0), F.greatest(F.lit(0.0), F.lit(10.0) - F.abs(c(ref, "line") - c(node, "start_line")) / 10.0)).otherwise(0.0)
    return place + lang + F.when(fits, AFFINITY).otherwise(0.0) + F.when(F.coalesce(c(node, "is_exported"), F.lit(False)), EXPORTED).otherwise(0.0) + line


def _best(cand: DataFrame) -> DataFrame:
    """Per reference the candidate of the first strategy, then the greatest score, then the least id: one aggregation with
    a map-side combine instead of a sorted window."""
    first = F.col("bias") if "bias" in cand.columns else F.lit(1)
    pick = F.min(F.struct("strategy", (-F.round("score", 6)).alias("neg"), first.alias("b"), F.col("node_id"), "node_kind"))
    return cand.groupBy("ref_id").agg(pick.alias("m")).select("ref_id", "m.strategy", "m.node_id", "m.node_kind", (-F.col("m.neg")).alias("score"))


def _joined(refs: DataFrame, nodes: DataFrame, on: Column, strategy: int, more: Column | None = None) -> DataFrame:
    j = refs.alias("r").join(nodes.alias("n"), on)
    if more is not None:
        j = j.filter(more)
    return j.select(F.col("r.id").alias("ref_id"), F.lit(strategy).alias("strategy"), F.col("n.id").alias("node_id"), F.col("n.kind").alias("node_kind"), score().alias("score"))


def candidates_exact(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Equal names in any letter case."""
    return _joined(refs.withColumn("k", F.lower("reference_name")), nodes.withColumn("k", F.lower("name")), F.col("r.k") == F.col("n.k"), EXACT)


def _dots(name: Column) -> Column:
    return F.length(name) - F.length(F.replace(name, F.lit("."), F.lit("")))


def probes(refs: DataFrame) -> DataFrame:
    """One row per reference and strategy that a symbol's name can settle: strategy `st`, key `k` in lower case, whole name
    `full`, receiver `recv`. Import references have none: they resolve by path alone."""
    name, low = F.col("reference_name"), F.lower("reference_name")
    flat = ~name.contains("/")
    last = F.lower(simple_name(name))
    qualified = name.contains("::") | (flat & (_dots(name) >= 2))
    method = flat & name.rlike(r"^[^.]+\.[^.]+$")
    none = F.lit(None).cast("string")
    say = lambda on, st, key: F.when(on, F.struct(F.lit(st).alias("st"), key.alias("k")))
    each = F.filter(
        F.array(
            say(F.col("language").isin(*JVM) & name.contains("."), FQN, F.lower(F.substring_index(name, ".", -1))), say(qualified, QUALIFIED, last), say(method, METHOD, F.lower(F.substring_index(name, ".", -1))),
            say(method & (F.col("language") == "sql"), SQL_EQUAL, last), say(F.lit(True), EXACT, low),
        ),
        lambda x: x.isNotNull(),
    )
    r = refs.filter("reference_kind <> 'imports' and reference_name <> ''").withColumn("full", low)
    r = r.withColumn("recv", F.when(method, F.lower(F.substring(F.substring_index(name, ".", 1), 1, 4))).otherwise(none))
    return r.withColumn("x_", F.explode(each)).withColumn("st", F.col("x_.st")).withColumn("k", F.col("x_.k")).drop("x_")


def by_name(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Candidates of all strategies that go by name, from one join on (key = name in lower case). Keys without a
    symbol of that name (R3) find nothing there. `bias` puts candidates with the receiver's first letters in their qualified
    name first, for languages without type inference here."""
    n = nodes.filter("name is not null").withColumn("k", F.lower("name")).withColumn("q", F.lower("qualified_name"))
    j = probes(refs).alias("r").join(n.alias("n"), F.col("r.k") == F.col("n.k"))
    st, q, full = F.col("r.st"), F.col("n.q"), F.col("r.full")
    same = q == full
    tail = q.endswith(F.concat(F.lit("::"), full)) | q.endswith(F.concat(F.lit("."), full))
    got = (
        F.when((st == FQN) & same, FQN)
        .when((st == QUALIFIED) & same, QUALIFIED)
        .when((st == QUALIFIED) & tail, QUALIFIED_TAIL)
        .when((st == METHOD) & F.col("n.kind").isin("function", "method"), METHOD)
        .when((st == SQL_EQUAL) & same, SQL_EQUAL)
        .when((st == SQL_EQUAL) & tail, SQL_TAIL)
        .when(st == EXACT, EXACT)
    )
    words = F.split(F.coalesce(q, F.lit("")), "[:.]+")
    bias = F.when((got == METHOD) & F.col("r.language").isin(*BIASED) & F.exists(words, lambda w: w.startswith(F.col("r.recv"))), 0).otherwise(1)
    return j.select(F.col("r.id").alias("ref_id"), got.alias("strategy"), F.col("n.id").alias("node_id"), F.col("n.kind").alias("node_kind"), F.when(got == FQN, 200.0).otherwise(score()).alias("score"), bias.alias("bias")).filter("strategy is not null")


def by_path(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Names with a '/' that are the path of a file, as it stands or with one of the endings of the language."""
    r = refs.filter("reference_kind <> 'imports'").filter(F.col("reference_name").contains("/"))
    r = r.withColumn("path", F.explode(F.array_distinct(F.array_append(candidate_paths(F.col("reference_name"), F.col("language")), F.col("reference_name")))))
    n = nodes.filter("id like 'file:%'").withColumn("path", F.expr("substring(id, 6)"))
    j = r.alias("r").join(n.alias("n"), F.col("r.path") == F.col("n.path"))
    return j.select(F.col("r.id").alias("ref_id"), F.lit(PATH).alias("strategy"), F.col("n.id").alias("node_id"), F.col("n.kind").alias("node_kind"), score().alias("score"), F.when(F.col("r.path") == F.col("r.reference_name"), 0).otherwise(1).alias("bias"))


def _pieces(word: Column, length: Column) -> list[tuple[Column, Column]]:
    """(start from 1, length) of three pieces that make up a word."""
    a = F.floor(length / 3)
    b = F.floor((length - a) / 2)
    return [(F.lit(1), a), (a + 1, b), (a + b + 1, length - a - b)]


def _cuts(starts: Column, number: int, length: Column) -> Column:
    return F.transform(starts, lambda s: F.struct(F.lit(number).alias("i"), F.substring(F.col("a"), s.cast("int"), length.cast("int")).alias("piece")))


def similar_names(left: DataFrame, right: DataFrame) -> DataFrame:
    """(a, b, dist): pairs of distinct names within 1 edit (a up to 4 characters) or 2, equal names left out.

    Partition filter: a name within 2 edits shares one of the three pieces of the other, moved by at most 2 places. Pieces
    of the right side meet substrings of the left in an equi-join, so no name is compared with all others.
    """
    lw = left.select("a").filter("a is not null and a <> '' and octet_length(a) <= 40").distinct().withColumn("la", F.length("a"))
    rw = right.select("b").filter("b is not null and b <> ''").distinct().withColumn("lb", F.length("b"))
    own = rw.select("b", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col("lb").alias("len"), F.substring(F.col("b"), p.cast("int"), n.cast("int")).alias("piece")) for i, (p, n) in enumerate(_pieces(F.col("b"), F.col("lb")))])).alias("x")).select("b", "x.*")
    lens = lw.withColumn("len", F.explode(F.sequence(F.greatest(F.col("la") - 2, F.lit(1)), F.col("la") + 2)))
    probes = []
    for i, (p, n) in enumerate(_pieces(F.col("a"), F.col("len"))):
        at = F.filter(F.sequence(p - 2, p + 2), lambda s: s >= 1)
        probes.append(_cuts(at, i, n))
    probe = lens.select("a", "la", "len", F.explode(F.array_distinct(F.flatten(F.array(*probes)))).alias("x")).select("a", "la", "len", "x.*")
    pair = probe.join(own, ["i", "len", "piece"]).select("a", "la", "b").distinct()
    most = F.when(F.col("la") <= 4, 1).otherwise(2)
    d = pair.withColumn("dist", F.levenshtein("a", "b", 2))
    return d.filter((F.col("dist") > 0) & (F.col("dist") <= most)).select("a", "b", "dist")


def candidates_fuzzy(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Names within the bound, as the last strategy."""
    r = refs.withColumn("a", F.lower("reference_name"))
    n = nodes.withColumn("b", F.lower("name"))
    near = similar_names(r.select("a"), n.select("b"))
    j = r.join(near, "a").alias("r").join(n.alias("n"), F.col("r.b") == F.col("n.b"))
    return j.select(F.col("r.id").alias("ref_id"), F.lit(FUZZY).alias("strategy"), F.col("n.id").alias("node_id"), F.col("n.kind").alias("node_kind"), score().alias("score"))


def confidence(sc: Column, strategy: Column) -> Column:
    c = F.greatest(F.lit(0.0), F.least(F.lit(1.0), sc / 200.0))
    return F.round(F.when(strategy == FUZZY, c * FUZZY_FACTOR).otherwise(c), 6)


def promote(reference_kind: Column, node_kind: Column) -> Column:
    """R6."""
    return F.when((reference_kind == "calls") & node_kind.isin("class", "struct"), "instantiates").when((reference_kind == "extends") & node_kind.isin("interface", "trait", "protocol"), "implements").otherwise(reference_kind)


def cascade(refs: DataFrame, nodes: DataFrame, imports: DataFrame | None = None) -> DataFrame:
    """ref_id, strategy, node_id, score, confidence, edge_kind of each resolved reference.

    Built-in names are dropped first; SQL string references have their own passes. One join on the name serves all strategies
    that go by name, and one aggregation keeps the first of them; only what is then still open meets the names of similar
    spelling. imports (ref_id, target_id): what import references resolve to by path (operators/imports.py)."""
    scratch = Scratch(refs.sparkSession, "cascade")
    r = refs.filter(~is_builtin(F.col("reference_name"), F.col("language")) & ~F.col("reference_kind").isin("sql_string", "sql_fragment"))
    r = scratch.write(r)
    nodes = scratch.write(nodes)
    cand = by_name(r, nodes)
    if not r.filter("reference_kind <> 'imports' and contains(reference_name, '/')").isEmpty():
        cand = cand.unionByName(by_path(r, nodes))
    first = scratch.write(_best(cand))
    rest = r.filter((F.col("reference_kind") != "imports") & (F.octet_length("reference_name") <= FUZZY_MAX_BYTES)).join(first.select(F.col("ref_id").alias("id")), "id", "left_anti")
    done = first.unionByName(_best(candidates_fuzzy(rest, nodes)))
    if imports is not None:
        kinds = nodes.select(F.col("id").alias("target_id"), F.col("kind").alias("node_kind"))
        i = imports.filter("target_id is not null").join(kinds, "target_id", "left")
        done = done.unionByName(i.select("ref_id", F.lit(IMPORT).alias("strategy"), F.col("target_id").alias("node_id"), F.coalesce("node_kind", F.lit("package")).alias("node_kind"), F.lit(200.0).alias("score")))
    j = done.join(r.select(F.col("id").alias("ref_id"), "reference_kind"), "ref_id")
    return j.select("ref_id", "strategy", "node_id", "score", confidence(F.col("score"), F.col("strategy")).alias("confidence"), promote(F.col("reference_kind"), F.col("node_kind")).alias("edge_kind"))


def edges_of(resolved: DataFrame, refs: DataFrame) -> DataFrame:
    """The edges of resolved references: source, target, kind, line, metadata (refArgs, null without arguments) and
    provenance ('embedded' for SQL references outside SQL files)."""
    r = refs.select(F.col("id").alias("ref_id"), F.col("from_node_id").alias("source"), "line", "arguments", "language", "file_path")
    meta = F.when(F.size(F.coalesce("arguments", F.array().cast("array<string>"))) > 0, F.to_json(F.struct(F.col("arguments").alias("refArgs"))))
    embedded = (F.col("language") == "sql") & ~F.lower(F.coalesce("file_path", F.lit(""))).rlike(r"\.(sql|ddl|psql|pgsql|plsql|tsql)(\.jinja)?$")
    return resolved.join(r, "ref_id").select("ref_id", "source", F.col("node_id").alias("target"), F.col("edge_kind").alias("kind"), "line", meta.alias("metadata"), F.when(embedded, "embedded").otherwise("").alias("provenance"))


def all_candidates(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """ref_id, node_id, score of the candidates of every strategy, each once with its greatest score."""
    c = by_name(refs, nodes).unionByName(by_path(refs, nodes)).select("ref_id", "node_id", "score")
    return c.union(candidates_fuzzy(refs, nodes).select("ref_id", "node_id", "score")).groupBy("ref_id", "node_id").agg(F.max("score").alias("score"))


def best_exact(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    return _best(candidates_exact(refs, nodes))


def tier(builder: Column, fragment: Column) -> Column:
    """High for a query builder's verb, else medium; one lower for a fragment."""
    return F.when(builder, F.when(fragment, "medium").otherwise("high")).otherwise(F.when(fragment, "low").otherwise("medium"))


def string_match(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Dotless names of SQL objects in string references: edges to all matches if there are one to three."""
    r = refs.filter(F.col("reference_kind").isin("sql_string", "sql_fragment") & ~F.col("reference_name").contains(".") & F.col("from_node_id").isNotNull())
    n = nodes.filter(F.col("kind").isin(*SQL_KINDS)).select(F.lower("name").alias("k"), F.col("id").alias("target"))
    per = n.groupBy("k").agg(F.count("*").alias("n")).filter("n <= 3")  # an ambiguous name, however frequent, ends here
    hit = r.withColumn("k", F.lower("reference_name")).join(per, "k").join(n, "k")
    verb = F.lower(F.coalesce(simple_name(F.col("callee_expr")), F.lit(""))).isin(*sorted(BUILDER_VERBS))
    return hit.select(F.col("id").alias("ref_id"), F.col("from_node_id").alias("source"), "target", tier(verb, F.col("reference_kind") == "sql_fragment").alias("confidence"))


def column_match(refs: DataFrame, nodes: DataFrame, pass_a: DataFrame) -> DataFrame:
    """(ref_id, target, confidence): `x.y` names a column y of a table or view x, if one to three are called x; a bare
    name left over by pass A (ref_id, source, target) is a column of the tables and views that the same owner reaches there."""
    r = refs.filter(F.col("reference_kind").isin("sql_string", "sql_fragment") & F.col("from_node_id").isNotNull())
    tables = nodes.filter("kind in ('table', 'view')").select(F.col("id").alias("table_id"), F.lower("name").alias("x"), F.lower("qualified_name").alias("tq"))
    cols = nodes.filter("kind = 'column'").select(F.col("id").alias("target"), F.lower("qualified_name").alias("cq"))
    fragment = F.col("reference_kind") == "sql_fragment"
    few = tables.groupBy("x").agg(F.count("*").alias("n")).filter("n <= 3").select("x")
    dotted = r.filter(F.col("reference_name").contains(".")).withColumn("x", F.lower(F.substring_index("reference_name", ".", 1))).withColumn("y", F.lower(F.expr("substring(reference_name, locate('.', reference_name) + 1)")))
    dotted = dotted.join(few, "x").join(tables, "x").withColumn("cq", F.concat_ws(".", "tq", "y")).join(cols, "cq")
    dotted = dotted.select(F.col("id").alias("ref_id"), "target", F.when(fragment, "low").otherwise("medium").alias("confidence"))
    anchors = pass_a.select(F.col("source").alias("from_node_id"), F.col("target").alias("table_id")).distinct().join(tables.select("table_id", "tq"), "table_id")
    bare = r.filter(~F.col("reference_name").contains(".")).join(pass_a.select(F.col("ref_id").alias("id")).distinct(), "id", "left_anti")
    bare = bare.join(anchors, "from_node_id").withColumn("cq", F.concat_ws(".", "tq", F.lower("reference_name"))).join(cols, "cq")
    verb = F.lower(F.coalesce(simple_name(F.col("callee_expr")), F.lit(""))).isin(*sorted(BUILDER_VERBS))
    bare = bare.select(F.col("id").alias("ref_id"), "target", F.when(verb & ~fragment, "medium").otherwise("low").alias("confidence"))
    return dotted.union(bare).distinct()


def string_refs_left(refs: DataFrame) -> DataFrame:
    """References that stay after the string passes: consumed and left-over string references are all deleted."""
    return refs.filter(~F.coalesce(F.col("reference_kind").isin("sql_string", "sql_fragment"), F.lit(False)))


# Endings tried for a path without a known one, per language, in order ('' is the path as it stands); known ones.
ENDINGS = {
    "typescript": (".ts", ".tsx", ".d.ts", "/index.ts", "/index.tsx", "/index.d.ts"), "javascript": (".js", ".jsx", "/index.js", "/index.jsx"), "python": (".py", "/__init__.py"), "go": ("", ".go"), "rust": (".rs", "/mod.rs"), "java": (".java", "/package-info.java"),
    "kotlin": (".kt", ".kts"), "scala": (".scala", "/package.scala"), "ruby": (".rb", "/index.rb"), "php": (".php", "/index.php"), "swift": (".swift",),
}
OTHER_ENDINGS = (".ts", ".js", ".py", ".go", ".rs")
KNOWN_ENDINGS = r"\.(ts|tsx|js|jsx|py|go|rs|java|kt|scala|rb|php|swift|c|cpp|h|cs|lua|dart)$"


def candidate_paths(base: Column, language: Column) -> Column:
    """The paths to try for a base, in order."""
    out = F.transform(F.array(*[F.lit(e) for e in OTHER_ENDINGS]), lambda e: F.concat(base, e))
    for lang, ends in ENDINGS.items():
        out = F.when(language == lang, F.transform(F.array(*[F.lit(e) for e in ends]), lambda e: F.concat(base, e))).otherwise(out)
    return F.when(base.rlike(KNOWN_ENDINGS), F.array(base)).otherwise(out)


def npm_package(spec: Column) -> Column:
    """The package an external specifier belongs to."""
    plain = F.regexp_replace(spec, "^(.+?)[?#].*$", "$1")
    return (
        F.when(plain.contains("://"), F.lit(""))
        .when(plain.startswith("node:"), plain)
        .when(plain.startswith("@"), F.when(F.regexp_extract(plain, "^@[^/]*/([^/]+)", 1) != "", F.regexp_extract(plain, "^(@[^/]*/[^/]+)", 1)).otherwise(F.regexp_extract(plain, "^([^/]*)", 1)))
        .otherwise(F.substring_index(plain, "/", 1))
    )


def is_external(spec: Column, language: Column) -> Column:
    """Specifiers for which no file is expected."""
    relative = spec.startswith("./") | spec.startswith("../") | spec.isin(".", "..")
    js = language.isin("javascript", "typescript") & ~spec.rlike("^[./#]")
    py = (language == "python") & ~spec.contains(".")
    go = (language == "go") & ~F.substring_index(spec, "/", 1).contains(".")
    jvm = (language == "java") & spec.rlike(r"^(java|javax|android|kotlin|scala|org\.junit|org\.springframework)\.")
    return F.coalesce(~relative & (spec.contains("://") | spec.startswith("node:") | spec.startswith("@") | js | py | go | jvm), F.lit(False))


def reexports(edges: DataFrame, starts: DataFrame, kind: str = "exports", cap: int = 8) -> DataFrame:
    """(id, final, hops): follow the first edge of `kind` (least id) from each start until none is left, a node comes
    again, or after `cap` hops. Starts and first edges meet in one bounded join per hop."""
    first = edges.filter((F.col("kind") == kind) & F.col("target").isNotNull()).groupBy("source").agg(F.min(F.struct("id", "target")).alias("m")).select("source", F.col("m.target").alias("target"))
    cur = starts.select("id", F.col("id").alias("at"), F.array("id").alias("seen"))
    for _ in range(cap):
        step = cur.join(first.withColumnRenamed("source", "at"), "at", "left")
        go = F.col("target").isNotNull() & ~F.array_contains("seen", F.col("target"))
        cur = step.select("id", F.when(go, F.col("target")).otherwise(F.col("at")).alias("at"), F.when(go, F.concat("seen", F.array("target"))).otherwise(F.col("seen")).alias("seen"))
    return cur.select("id", F.col("at").alias("final"), (F.size("seen") - 1).alias("hops"))


def capped(pairs: DataFrame, keys: list[str], order: list[str], cap: int) -> DataFrame:
    """The first `cap` rows per key, the reference's fan-out cap. Spark cuts to the rank before it shuffles."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return pairs.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= cap).drop("rn")
