"""The text problems: fixtures by hand, brute force, round trips, dirty and empty tables, very long texts."""

import ast
import json
import random

import pytest
from pyspark.sql import functions as F

from arborweft.llm import catalog, conversations, docpairs, leakage, packing, provenance, quality
from arborweft.llm.syntax import check, peg
from tests.conftest import DATA, rows
from tests.test_oracle import compare


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_queries(spark, name):
    if name in catalog.ORACLE:
        compare(spark, name, catalog.QUERIES[name], catalog.ORACLE[name])
    else:
        assert catalog.QUERIES[name](spark, DATA).count() > 0


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_empty(spark, empty_dir, name):
    got = catalog.QUERIES[name](spark, empty_dir).count()
    assert got == (1 if name == "p8_fill" else 0)


@pytest.mark.parametrize("name", ["p1_found", "p4_found", "p5_found", "p6_found", "p9_found"])
def test_repeats_nulls_and_clashes_change_nothing(spark, data, dirty_dir, name):
    assert rows(catalog.QUERIES[name](spark, dirty_dir)) == rows(catalog.QUERIES[name](spark, data))


def test_null_document_is_not_prose(spark, data, dirty_dir):
    assert rows(catalog.QUERIES["p10_found"](spark, dirty_dir).filter("doc_id is not null")) == rows(catalog.QUERIES["p10_found"](spark, data))
    assert catalog.QUERIES["p10_found"](spark, dirty_dir).filter("doc_id is null").count() == 1


# --- problem 1 --------------------------------------------------------------------------------------------------------

SAYS = [
    "Clamps to the ring limit.", "Ersetzt die Zeile nur dann, wenn sie alt ist.", "// nolint:gocyclo\n// Negative offsets count from the end.", "/**\n * Waits for the lock.\n * @param x\n */", '"""Idempotent."""',
    "TODO: later\nNever blocks.", "@param x the row to start from", ":returns: a fresh copy", "次の行を返す。", "Copyright 2020 Someone.\n\nPanics on overflow.", "<summary>Merges both halves.</summary>",
]
SILENT = [
    None, "", "  \n", "//", "/** */", '""""""', "-----", "TODO", "FIXME write docs", "n/a", "placeholder docstring", "[description here]", "noqa: E501", "eslint-disable-next-line no-console", "type: ignore", "@inheritdoc", "{@inheritDoc}", "@param x\n@returns",
    ":param x:\n:return:", "Args:\n    x:\nReturns:", "SPDX-License-Identifier: MIT", "Copyright 2024 Foundry. All rights reserved.", "author: the team", "return x", "if (x) return 5;", "loadRows()", "Load the rows.", "loadRows", "This function loads rows.",
    "The load rows method.", "helper", "Constructor.", "getter", "See base class.", "#region rows", "==== rows ====", "<summary></summary>", "Method description.", "Auto-generated method stub",
]


@pytest.mark.parametrize("doc", SAYS)
def test_documentation_that_says_something(doc):
    assert docpairs.tells_something(doc, "loadRows", "(x)")


@pytest.mark.parametrize("doc", SILENT)
def test_documentation_that_says_nothing(doc):
    assert not docpairs.tells_something(doc, "loadRows", "(x)")


def test_lexer_keeps_every_character():
    r = random.Random(6)
    for lang in docpairs.LEXIS:
        for _ in range(200):
            t = "".join(r.choice("ab{}()/*'\"`\\\n-#$ ") for _ in range(60))
            parts = docpairs.lex(t, lang)
            assert "".join(t[a:b] for _, a, b in parts) == t


def test_functions_are_cut_with_their_comments():
    go = '// Adds "}" safely.\nfunc Add(a int) int {\n\ts := "}" // }\n\treturn a\n}\n\n// lost\n\nfunc Bare() {}\n'
    assert [(n, a, b, d) for n, a, b, _, d in docpairs.functions(go, "go")] == [("Add", 2, 5, '// Adds "}" safely.'), ("Bare", 9, 9, "")]
    py = 'class A:\n    # before\n    def f(self, x="def g(): {"):\n        """Says f."""\n        return 1\n\n    async def g(self):\n        pass\n'
    assert [(n, a, b, d) for n, a, b, _, d in docpairs.functions(py, "python")] == [("f", 3, 5, '"""Says f."""'), ("g", 7, 8, "")]
    js = "/** Doc. */\nfunction f(a) { return /[{]/.test(a) ? `${a}}` : '}'; }\n"
    assert [(n, a, b, d) for n, a, b, _, d in docpairs.functions(js, "javascript")] == [("f", 2, 2, "/** Doc. */")]


def test_functions_of_less_common_forms():
    cut = lambda t, lang: [(n, a, b, d) for n, a, b, _, d in docpairs.functions(t, lang)]
    java = 'class A {\n  /** Doc. */\n  @Override\n  @B(x = {1}, y = "(")\n  public int f() {\n    return g(1);\n  }\n\n  /** Two. */\n  @C public int h() { return 1; }\n}\n'
    assert cut(java, "java") == [("f", 5, 7, "/** Doc. */"), ("h", 10, 10, "/** Two. */")]
    ts = "class A {\n  /** Doc. */\n  @D()\n  private static async f(a: number): Promise<{ b: string }> {\n    return g(a);\n  }\n\n  /** Get. */\n  public get x() { return 1; }\n}\n\n/** Arrow. */\nexport const h = async (a: string): Promise<void> => {\n  i(a);\n};\n\n/** Short. */\nconst k = x => x + 1;\n\n/** Given. */\nlet m = function (a) { return a; };\nfoo(1);\nconst n = (1 + 2) * 3;\n"
    assert cut(ts, "typescript") == [("f", 4, 6, "/** Doc. */"), ("x", 9, 9, "/** Get. */"), ("h", 13, 15, "/** Arrow. */"), ("k", 18, 18, "/** Short. */"), ("m", 21, 21, "/** Given. */")]
    assert cut("foo(1)\nbar(function () { return 1 })\nclass A {\n}\n", "javascript") == []
    go = "// F does.\nfunc F(a int) (interface{}, error) {\n\treturn a, nil\n}\n\n// G does.\nfunc G() map[string]struct{} {\n\treturn nil\n}\n"
    assert cut(go, "go") == [("F", 2, 4, "// F does."), ("G", 7, 9, "// G does.")]


def test_pairs_come_from_the_texts_where_there_are_texts(spark):
    from datetime import datetime

    text = "package a\n\n// Add holds the lock.\nfunc Add(a int) int {\n\treturn a\n}\n\n// Old words.\nfunc Sub(a int) int {\n\treturn a\n}\n"
    node = lambda i, name, line, doc, path="a.go": (i, "function", name, path, "go", line, line + 2, doc, "(a int) int", 1)
    nodes = spark.createDataFrame(
        [node("1", "Add", 4, "Add holds the lock."), node("2", "Sub", 9, "Newer words than the text has."), node("3", "Add", 4, None), node("4", "Far", 4, "Waits for the ring.", "b.go"), node("5", "Far", 4, "TODO", "b.go"), node("6", "Moved", 30, "Counts the rows twice.")],
        "id string, kind string, name string, file_path string, language string, start_line int, end_line int, docstring string, signature string, updated_at long",
    )
    files = spark.createDataFrame([("a.go", "go", datetime(2025, 1, 1)), ("b.go", "go", datetime(2025, 1, 1))], "path string, language string, indexed_at timestamp_ntz")
    texts = spark.createDataFrame([("a.go", text), ("b.go", None)], "path string, content string")
    got = {r["node_id"]: (r["documentation"], r["origin"], r["code"]) for r in docpairs.pairs(nodes, files, texts).collect()}
    assert got == {"1": ("Add holds the lock.", "text", "func Add(a int) int {\n\treturn a\n}"), "2": ("Newer words than the text has.", "row", "func Sub(a int) int {\n\treturn a\n}"), "4": ("Waits for the ring.", "row", None), "6": ("Counts the rows twice.", "row", None)}


def test_long_java_text_is_cut_in_linear_time():
    import time

    body = "class A {\n" + "".join(f"  /** Holds row {i}. */\n  public Map<String, List<int[]>> get{i}(final int a) throws X {{\n    return call(a, {i}).of(x < {i} ? a : b);\n  }}\n" for i in range(4000)) + "}\n"
    start = time.time()
    assert sum(1 for _ in docpairs.functions(body, "java")) == 4000
    assert time.time() - start < 20


def test_copyright_as_a_subject_is_documentation():
    assert docpairs.tells_something("Copyright check of uploaded images.", "scan", "(a)")
    for doc in ("Copyright 2021 Acme.", "(c) 2020 Acme", "Copyright (c) The Acme Authors", "Copyright Acme Inc."):
        assert not docpairs.tells_something(doc, "scan", "(a)"), doc


# --- problem 4 --------------------------------------------------------------------------------------------------------

_ENTRY = "entry_id string, session_id string, member string, line_no int, entry_type string, role string, ts string, sidechain boolean, text string, blocks string, loaded_at timestamp_ntz"


def entries(spark, spec):
    """spec: (session, type, role, seconds or text, text, blocks)"""
    from datetime import datetime

    out = []
    for i, (s, kind, role, ts, text, blocks) in enumerate(spec):
        ts = f"2025-01-01T00:00:{ts:02d}Z" if isinstance(ts, int) else ts
        out.append((f"e{i}", s, "m", i, kind, role, ts, False, text, blocks, datetime(2025, 1, 1)))
    return spark.createDataFrame(out, _ENTRY)


def test_whole_and_broken_sessions(spark):
    u, a = "user", "assistant"
    spec = [
        ("ok", u, None, 1, "hi", None), ("ok", a, "Agent", "2025-01-01T01:00:02+01:00", "yo", None), ("ok", a, "", 3, "more", None), ("ok", u, "HUMAN", 4, None, json.dumps([{"type": "tool_result"}])), ("ok", a, a, 5, "end", None),
        ("first", a, a, 1, "x", None), ("late", u, u, 1, "x", None), ("twice", u, u, 1, "x", None), ("twice", u, u, 2, "x", None), ("twice", a, a, 3, "x", None),
        ("role", u, u, 1, "x", None), ("role", a, "narrator", 2, "x", None), ("time", u, u, 1, "x", None), ("time", a, a, "yesterday", "x", None), ("none", "summary", None, 1, "x", None),
        ("blank", u, u, 1, " \n", json.dumps([{"type": "text", "text": " "}])), ("bad", u, u, 1, None, "[{"), ("bad", u, u, 2, "q", None), ("bad", a, a, 3, "r", None), ("tie", u, u, 1, "q", None), ("tie", a, a, 1, "r", None),
    ]
    got = {r["session_id"]: r["whole"] for r in conversations.judge(entries(spark, spec)).collect()}
    assert {k for k, v in got.items() if v} == {"ok", "bad", "tie"} and set(got) == {s[0] for s in spec}


def test_one_session_over_many_partitions(spark):
    n = 4000
    rows_ = spark.range(n).select(
        F.concat(F.lit("e"), "id").alias("entry_id"), F.lit("big").alias("session_id"), F.lit("m").alias("member"), F.col("id").cast("int").alias("line_no"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("entry_type"),
        F.lit(None).cast("string").alias("role"), F.date_format(F.timestamp_seconds(F.col("id") + 1_700_000_000), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ts"), F.lit(False).alias("sidechain"), F.lit("t").alias("text"), F.lit(None).cast("string").alias("blocks"), F.lit("2025-01-01").cast("timestamp_ntz").alias("loaded_at"),
    )
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert rows(conversations.judge(rows_)) == [("big", n, True)]
        t = conversations.turns(rows_).orderBy("turn_no").collect()
        assert [r["turn_no"] for r in t] == list(range(1, n + 1)) and [r["entry_id"] for r in t[:3]] == ["e0", "e1", "e2"]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_clock_offset_is_the_least_squares_answer(spark):
    spec = [("s", "user", None, 10, "q", None), ("s", "assistant", None, 7, "r", None), ("s", "user", None, 20, "q", None), ("s", "assistant", None, 18, "r", None)]
    r = conversations.clock_offsets(entries(spark, spec)).first()
    assert (r["lowest_s"], r["highest_s"], r["offset_s"], r["feasible"]) == (3.0, 13.0, 3.0, True)


def neighbours(spec):
    """Per session its bounds [(lower, seconds)], by a plain loop over the spec of entries()."""
    out, last = {}, {}
    for s, role, _, at, _, _ in spec:
        if s in last and last[s][0] != role:
            out.setdefault(s, []).append((role == "assistant", last[s][1] - at if role == "assistant" else at - last[s][1]))
        last[s] = (role, at)
    return out


def test_clock_offset_of_contradicting_bounds_minimises_squares(spark):
    rnd = random.Random(7)
    spec = [(f"s{i}", rnd.choice(["user", "assistant"]), None, rnd.randrange(60), "t", None) for i in range(40) for _ in range(rnd.randrange(2, 14))]
    # offset >= 10 once, <= 0 three times: the midpoint of the extreme bounds is 5, the least squares answer is 2.5
    spec += [("x", r, None, t, "t", None) for r, t in (("user", 10), ("assistant", 0), ("user", 0), ("user", 20), ("assistant", 20), ("user", 20), ("assistant", 40), ("user", 40))]
    want = neighbours(spec)
    got = {r["session_id"]: r for r in conversations.clock_offsets(entries(spark, spec)).collect()}
    assert got.keys() == want.keys() and {r["feasible"] for r in got.values()} == {True, False}
    assert got["x"]["offset_s"] == 2.5
    for s, bounds in want.items():
        lo, hi = max([b for low, b in bounds if low], default=-1e9), min([b for low, b in bounds if not low], default=1e9)
        assert got[s]["n_pairs"] == len(bounds) and got[s]["feasible"] == (lo <= hi)
        if lo <= hi:
            assert got[s]["offset_s"] == min(max(0, lo), hi)
            continue
        for _ in range(100):
            x = (lo + hi) / 2
            slope = sum(x - b for low, b in bounds if (b > x if low else b < x))
            lo, hi = (x, hi) if slope > 0 else (lo, x)
        assert got[s]["offset_s"] == pytest.approx(x, abs=1e-6)


def test_clock_constraints_of_one_session_over_many_partitions(spark):
    """The tightest pairs lie on either side of line 4,096, and of every border between partitions."""
    n = 10_000
    late = (F.col("id") == 4095) | (F.col("id") % 1250 == 1249)
    rows_ = spark.range(n).select(
        F.concat(F.lit("e"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("entry_id"), F.lit("big").alias("session_id"), F.lit("m").alias("member"), F.col("id").cast("int").alias("line_no"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("entry_type"),
        F.lit(None).cast("string").alias("role"), F.date_format(F.timestamp_seconds(F.col("id") * 10 + F.when(late, 9).otherwise(0) + 1_700_000_000), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ts"), F.lit(False).alias("sidechain"), F.lit("t").alias("text"), F.lit(None).cast("string").alias("blocks"), F.lit("2025-01-01").cast("timestamp_ntz").alias("loaded_at"),
    )
    none = rows_.withColumn("line_no", F.lit(None).cast("int"))  # order by entry_id alone
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for df in (rows_, none):
            parts = conversations.messages(df).repartitionByRange("session_id", "line_no", "entry_id").withColumn("p", F.spark_partition_id())
            assert parts.select("p").distinct().count() > 1
            r = conversations.clock_offsets(df).first()
            assert (r["n_pairs"], r["lowest_s"], r["highest_s"], r["offset_s"], r["feasible"]) == (n - 1, -10.0, 1.0, 0.0, True)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_corrected_clocks_make_a_torn_session_whole(spark):
    spec = [("s", "user", None, 10, "q", None), ("s", "assistant", None, 7, "r", None), ("s", "user", None, 20, "q", None), ("s", "assistant", None, 18, "r", None), ("fine", "user", None, 1, "q", None), ("fine", "assistant", None, 2, "r", None)]
    got = {r["session_id"]: (r["offset_s"], r["whole"], r["whole_corrected"]) for r in conversations.corrected(entries(spark, spec)).collect()}
    assert got == {"s": (3.0, False, True), "fine": (0.0, True, True)}


# --- problem 5 --------------------------------------------------------------------------------------------------------

GOOD = {
    "go": ['package a\n\nimport (\n\t"fmt"\n\tx "y/z"\n)\n\ntype T[K comparable, V any] struct {\n\tm map[K]V `json:"m"`\n\t*Base\n}\n\nfunc (t *T[K, V]) F(a, b int, c ...string) (r int, err error) {\n\tfor i := 0; i < 3; i++ {\n\t\tif v, ok := t.m[k]; ok && v != nil {\n\t\t\tcontinue\n\t\t}\n\t}\n\tswitch x := y.(type) {\n\tcase int, []string:\n\t\treturn 1, nil\n\tdefault:\n\t}\n\tselect {\n\tcase c <- 1:\n\tcase v := <-d:\n\t\t_ = v\n\t}\n\tgo func() { defer close(c) }()\n\tz := []struct{ A int }{{1}, {A: 2}}\n\tfor range z {\n\t}\n\tvar q = [...]int{1, 2}\n\treturn Map[int, string](q[1:]...)\n}\n'],
    "java": ['package a.b;\nimport static java.util.List.*;\n\n@A(x = {1, 2})\npublic sealed interface S<T extends Comparable<T>> permits P, Q {\n    default <R> List<Map<String, R[]>> f(final int a, String... b) throws E, F {\n        int[] x = new int[]{1, 2}, y[] = {{1}};\n        for (var e : list) { label: while (true) { break label; } }\n        try (var r = open(); s) { } catch (A | B e) { throw e; } finally { }\n        Function<Integer, Integer> g = v -> v >>> 2, h = (int p, int q) -> { return p; };\n        var t = switch (k) { case 1, 2 -> "a"; case String s when s.isEmpty() -> { yield "b"; } default -> null; };\n        return (List<Map<String, R[]>>) a.<R>b().c(this::d, int[]::new)[0];\n    }\n    enum E { A(1) { void f() {} }, B; int x; }\n    record P(int a, @N String b) implements S { P { } }\n}\n'],
    "javascript": ["#!/usr/bin/env node\nimport a, { b as c } from './d'\nexport default class extends X {\n  static #p = 1\n  static { init() }\n  get x() { return this.#p }\n  async *gen() { yield* y; for await (const z of w) ; }\n}\nconst f = async ({ a = 1, ...r }, [b, , c] = []) => ({ ...r, [a]: b ?? c?.d?.[0] })\nlet t = `x ${`y ${1}`} {`\nlabel: for (;;) { break label }\nif (a) b\nelse c\nvar re = /[/}]/g.test(s) ? a / b / c : d\nreturn_ = 1\n"],
    "typescript": ["import type { A } from './a';\nabstract class B<T extends keyof A = any> implements C, D<T[]> {\n  private readonly x?: string = 'a';\n  constructor(public y: number, private z?: T) { super(); }\n  abstract f<K>(this: B, a: K | null): a is string;\n  get g(): [a: number, b?: string] { return this.x! as unknown as any; }\n  [key: string]: unknown;\n}\ntype M = { readonly [K in keyof A]?: A[K] extends (infer U)[] ? U : never } & typeof import('x');\nenum E { A = 1, B }\ndeclare module 'm' { export function f(x: number): void; }\nexport const h = <T,>(x: T): x is T => f<string>(x) satisfies boolean;\nfunction o(a: string): void;\nfunction o(a: any) { return <any>a; }\nnamespace N.P { export let x: Array<Map<string, number>> = []; }\n"],
    "python": ['@d(1)\nasync def f(a, /, b: int = 1, *c, d, **e) -> "x":\n    if (n := len(a)) > 1: return\n    async with x as y, z: pass\n    try:\n        print(f"{a!r:>{w}}", *b, **c)\n    except* (A, B) as e:\n        raise E from e\n    match p:\n        case {"a": [1, *_], **r} | C(x=0) if q: ...\n    return [i async for i in j if k], {**m}, lambda *a, k=1: (yield)\n\nclass A[T](B, metaclass=C): x: int = 1; y = """\n<<<<<<< HEAD\n"""\n'],
    "sql": ["WITH a AS (SELECT 1 AS x) SELECT a.x, count(*) FILTER (WHERE b > 1) OVER (PARTITION BY c ORDER BY d) FROM a LEFT JOIN b USING (x) WHERE y IN ('it''s', 'b') GROUP BY 1 HAVING sum(z) > 2 ORDER BY 1 DESC LIMIT 3;\nCREATE TABLE IF NOT EXISTS t (id BIGINT PRIMARY KEY, a VARCHAR(10) DEFAULT '(' NOT NULL, CONSTRAINT fk FOREIGN KEY (a) REFERENCES u (id) ON DELETE CASCADE);\nCREATE FUNCTION f(p BIGINT) RETURNS BIGINT AS $$\nDECLARE v int := 1;\nBEGIN\n  IF p > 1 THEN RETURN (SELECT count(*) FROM t WHERE id = p); ELSE v := v + 1; END IF;\n  FOR r IN SELECT * FROM t LOOP PERFORM g(r.id); END LOOP;\n  RETURN v;\nEND;\n$$ LANGUAGE plpgsql;\nINSERT INTO t (a) VALUES (1), (2) ON CONFLICT (a) DO UPDATE SET a = excluded.a;\nALTER TABLE t ADD COLUMN z NUMERIC(10, 2);\n-- end"],
}


@pytest.mark.parametrize("lang", sorted(GOOD))
def test_valid_sources(lang):
    for t in GOOD[lang]:
        assert check.verdict(t, lang) is None
        assert check.verdict(t.replace("\n", "\r\n"), lang) is None
    assert check.verdict("", lang) is None or lang in ("go",)


@pytest.mark.parametrize("lang", sorted(GOOD))
def test_damaged_sources(lang):
    t = GOOD[lang][0]
    assert check.verdict("import {{ project.slug }} from\n" + t, lang)[0] == "template"
    lines = t.split("\n")
    k = len(lines) // 2
    assert check.verdict("\n".join([*lines[:k], "<<<<<<< HEAD", lines[k], "=======", lines[k], ">>>>>>> other", *lines[k + 1 :]]), lang)[0] in ("conflict", "other", "truncated", "template")
    assert check.verdict(t + "\n)", lang) is not None
    assert check.verdict("The second pass needs 9 seconds, or so it seems; nobody knows.", lang) is not None
    for other in GOOD:
        if other != lang and (lang, other) != ("typescript", "javascript"):
            assert check.verdict(GOOD[other][0], lang) is not None, other


def test_routine_bodies_conflicts_and_depth():
    far = "x INT DEFAULT 1, " * 40
    f = f"CREATE FUNCTION f({far}y INT) RETURNS INT AS $$\nBEGIN\n  RETURN %s;\nEND;\n$$ COST 10 LANGUAGE plpgsql;\n"
    assert check.verdict(f % "1", "sql") is None and check.verdict(f % "(1", "sql") is not None
    g = f"CREATE FUNCTION f({far}y INT) RETURNS INT LANGUAGE plpgsql AS $$\nBEGIN\n  RETURN %s;\nEND;\n$$;\n"
    assert check.verdict(g % "1", "sql") is None and check.verdict(g % "(1", "sql") is not None
    pad = "package a\n\n<<<<<<< HEAD\n" + "".join(f"var a{i} = {i}\n" for i in range(900)) + "func f( {\n"
    assert check.verdict(pad, "go")[0] == "conflict"
    assert check.verdict("x = " + "(" * 30_000 + "1" + ")" * 30_000 + "\n", "python") is None


def test_furthest_failure():
    assert check.verdict("package a\n\nfunc f() {\n\tx := [1\n}\n", "go")[1] == 4
    assert check.verdict("a = 1\nb = (2\n", "python") == ("truncated", 3, 1)


def test_python_agrees_with_the_compiler(spark, data):
    f = {r["path"]: r["language"] for r in check.latest_files(spark.read.parquet(f"{data}/files.parquet")).collect()}
    r = random.Random(1)
    for row in spark.read.parquet(f"{data}/source_texts.parquet").filter("content is not null").collect():
        if f.get(row["path"]) != "python":
            continue
        cut = row["content"]
        for text in (cut, cut[: r.randrange(len(cut) + 1)], cut.replace("(", "", 1), cut.replace(":", "", 1), cut.replace("    ", "   ", 1)):
            try:
                ast.parse(text)
                ok = True
            except (SyntaxError, ValueError) as e:
                if any(w in str(e) for w in ("f-string", "cannot assign", "expected 'except'", "positional", "keyword argument", "non-default", "parameter without a default")):
                    continue
                ok = False
            assert (check.verdict(text, "python") is None) == ok, text[-300:]


def test_grammar_compiler():
    p = peg.compile_grammar("Start <- Item* EOF\nItem <- 'a' &('b' / 'a') / 'b' !'b' / \"c\"+", "Start")
    run = lambda s: p([*s, "EOF"], [*s, ""], [False] * (len(s) + 1), [False] * (len(s) + 1))
    assert run("ab")[0] and run("cca")[0] is False and run("abb") == (False, 1) and run("")[0]


def test_deep_nesting_is_no_crash():
    assert check.verdict("a = " + "(" * 3000 + "1" + ")" * 3000 + "\n", "python") in (None, ("too deep", 1, 1))


# --- problem 6 --------------------------------------------------------------------------------------------------------

HAND = "def load(rows):\n    return [x for x in rows if x]\n\n\ndef save(rows):\n    write(rows)\n"


@pytest.mark.parametrize(
    "path, size, text",
    [
        ("a/node_modules/b/c.js", 9, HAND), ("a/x.min.js", 9, HAND), ("a/lib/tool-1.2.3/x.py", 9, HAND), ("a/x_pb2.py", 9, HAND), ("go.sum", 9, "x"), ("a/big.go", 31_000_000, None), ("a/x.py", 9, "# Code generated by tool. DO NOT EDIT.\n" + HAND),
        ("a/x.py", 9, "# Copyright 2024 Us\n# Generated from a.idl on 2024-01-01; do not modify by hand\n" + HAND), ("a/x.js", 9, "/*! lib v1.2.3 | MIT License */\n" + HAND), ("a/x.py", 9, "# Part of the lib project, release 1.2.3. See lib/LICENSE.\n" + HAND),
        ("a/x.py", 9, 'blob = "' + "QUJ4" * 100 + '"\n'), ("a/x.go", 9, "package a\n\nvar t = []int{\n" + "1, 2, 3, 4, 5, 6, 7, 8,\n" * 30 + "}\n"), ("a/x.js", 9, "".join(f"function g{i}(m){{return m[{i}]}}" for i in range(60))),
        ("a/x.js", 9, json.dumps({"a": [1, 2, {"b": "c" * 50}]})), ("a/x.sql", 9, "INSERT INTO t VALUES\n" + "".join(f"({i}, 'a'),\n" for i in range(40))),
    ],
)
def test_not_handwritten(path, size, text):
    assert provenance.reason(path, "x", size, text)


@pytest.mark.parametrize(
    "path, text",
    [
        ("a/generated_reports/x.py", HAND), ("a/vendor_portal/minify.py", HAND), ("a/x.py", "# Callers used to be auto-generated, this file is written by hand.\n" + HAND), ("a/x.py", "# Writes the words DO NOT EDIT on top of its own output.\n" + HAND),
        ("a/x.py", HAND + 'BANNER = "DO NOT EDIT: written by the scan command"\n'), ("a/x.py", "# Copyright 2024 Us, all rights reserved\n" + HAND), ("a/x.js", "import a from 'b';\nconst P = \"" + "ab|cd" * 200 + '";\nfunction f(a) {\n  return a;\n}\n'), ("a/x.py", "W = [" + "1, " * 30 + "]\n" + HAND * 3), ("a/x.py", None), ("a/x.py", ""),
    ],
)
def test_handwritten(path, text):
    assert provenance.reason(path, "x", 9, text) is None


def test_numbered_code_by_hand_and_by_a_tool():
    tests = "import unittest\n\nclass T(unittest.TestCase):\n" + "".join(f"    def test_case{i}(self):\n        {a}\n\n" for i, a in enumerate(("self.go(1)", "x = load()\n        self.assertEqual(x, 2)", "with self.assertRaises(E):\n            f()", "pass", "self.fail('no')", "for a in b:\n            g(a)"), 1))
    steps = "".join(f"def step{i}(rows):\n    return rows\n\n" for i in range(1, 6))
    for path in ("a/x.py", "a/gen/rules.py", "a/generated/x.py"):
        assert provenance.reason(path, "python", 9, tests) is None
    assert provenance.reason("a/x.py", "python", 9, steps) is None
    assert provenance.reason("app/gen/rules.go", "go", 9, "package gen\n\nfunc Rules() []Rule {\n\treturn load()\n}\n") is None
    assert provenance.reason("app/vendor/list.go", "go", 9, "package vendor\n\nfunc List() []string {\n\treturn load()\n}\n") is None
    written = "".join(f"function get{a}{i}(msg) {{ return msg[{i}]; }}\n" for i, a in enumerate(("Row", "Key", "Ring", "Node") * 4))
    assert provenance.reason("a/gen/x.js", "javascript", 9, written) and provenance.reason("a/x.js", "javascript", 9, written) is None
    assert provenance.reason("a/x.py", "python", 2_000, HAND) is None and provenance.reason("a/x.py", "python", 2_000, HAND, 1_000) == "size"


@pytest.mark.parametrize("head", ["/*\n" + " * licence text\n\n" * 40 + " * %s\n */\n", "// licence text\n" * 40 + "// %s\n", '"""\n' + "licence text\n" * 40 + '%s\n"""\n', "# licence text\n" * 40 + "# %s\n"])
def test_notice_below_a_long_licence(head):
    notice = "Code generated by protoc-gen-go. DO NOT EDIT."
    assert provenance.header_reason(head % notice + "x = 1\n") == "generation notice"
    assert provenance.header_reason(head % "the end" + "x = 1\ny = 2\n// " + notice) is None


# --- problem 8 --------------------------------------------------------------------------------------------------------


def test_tokens_make_the_text_again():
    enc = packing._encoder(packing.tokenizer_path())
    for t in ("", "Hello  wörld\n\n\t漢字 🙂", "a" * 500, "<|endoftext|>"):
        assert enc.decode(enc.encode_ordinary(t)) == t


def best_fit_by_rows(sizes, capacity):
    gaps, used = [], []
    for s in sorted(sizes, reverse=True):
        fit = [(g, i) for i, g in enumerate(gaps) if g >= s]
        if fit:
            i = min(fit)[1]
        else:
            gaps.append(capacity)
            i = len(gaps) - 1
        gaps[i] -= s
    return len(gaps)


@pytest.mark.parametrize("seed, partitions", [(0, 1), (1, 7), (2, 7), (3, 16)])
def test_supersteps_pack_like_best_fit(spark, seed, partitions):
    """In any number of ranges: nothing lost, nothing over the capacity, close to best fit by rows and to the bound."""
    r = random.Random(seed)
    cap = r.choice([50, 2048])
    sizes = [min(cap, max(1, int(r.expovariate(1 / (cap / 6))))) for _ in range(2000)] + [3] * 1500  # a size that a third shares
    docs = spark.createDataFrame(list(enumerate(sizes)), "doc_id long, n_tokens long")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        out = packing.pack(docs, cap).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    used = {}
    for x in out:
        used[x["container_id"]] = used.get(x["container_id"], 0) + x["n_tokens"]
    assert sorted((x["doc_id"], x["n_tokens"]) for x in out) == sorted(enumerate(sizes)) and max(used.values()) <= cap
    assert len(used) <= max(best_fit_by_rows(sizes, cap), -(-sum(sizes) // cap)) * 1.03 + 1


def test_brackets_are_stitched_over_ranges():
    r = random.Random(5)
    for _ in range(200):
        parts = [(p, r.randrange(5), r.randrange(5)) for p in range(r.randrange(1, 8))]
        stack, want = [], set()
        for p, slots, docs in parts:
            for k in range(slots):
                if stack:
                    want.add((*stack.pop(), p, k))
            stack += [(p, k) for k in range(docs)]
        spans = packing.stitch(parts)
        assert len(spans) <= 2 * len(parts)
        assert {(q, hi - 1 - k, p, at + k) for q, lo, hi, p, at in spans for k in range(hi - lo)} == want


def test_pack_every_document_once(spark):
    r = random.Random(3)
    counts = [(i, r.choice([0, 1, 5, 7, 7, 7, 33, 100, 101, 350])) for i in range(3000)] + [(None, 4), (7, None), (7, 7), (7, 7)]
    out = packing.pack(spark.createDataFrame(counts, "doc_id long, n_tokens long").repartition(5), 100).collect()
    by, got = {}, {}
    for x in out:
        by[x["container_id"]] = by.get(x["container_id"], 0) + x["n_tokens"]
        got.setdefault(x["doc_id"], []).append((x["piece_no"], x["first_token"], x["n_tokens"]))
    assert max(by.values()) <= 100 and set(by) == set(range(len(by)))
    total = sum(n or 0 for _, n in counts)
    assert sum(by.values()) == total and len(by) <= total / 100 * 1.02 + 2
    for i, n in counts[:3000]:
        if i != 7:
            pieces = sorted(got[i])
            assert sum(p[2] for p in pieces) == n and [p[1] for p in pieces] == [k * 100 for k in range(len(pieces))] and len(pieces) == max(1, -(-n // 100))
    assert len(got[7]) == 4 or counts[7][1] > 100


# --- problem 9 --------------------------------------------------------------------------------------------------------


def _items():
    r = random.Random(9)
    names = [f"{a}{b}" for a in "Brisk Fulm Kest Lanth Mord Nerr Oski Prand".split() for b in ("ale", "ion", "uth")]
    line = lambda: f"In {r.choice(names)}, the {r.choice(names)} ladder starves the {r.choice(names)} file whenever {r.randrange(999)} workers start beside {r.choice(names)}."
    return [(i, " ".join(line() for _ in range(4))) for i in range(40)], line


def test_leaks_in_disguise_and_near_misses():
    items, line = _items()
    ix = leakage.ItemIndex(items)
    t = items[5][1]
    w = t.split()
    hide = {
        "plain": f"Before. {t} After.", "upper": t.upper(), "bare": "".join(c for c in t.lower() if c.isalnum() or c == " "), "quote": "\n".join("> " + " ".join(w[i : i + 6]) for i in range(0, len(w), 6)), "numbered": "\n".join(f"  {i}: " + " ".join(w[i : i + 6]) for i in range(0, len(w), 6)),
        "html": " ".join(f"<b>{x}</b>" if i % 3 == 0 else x for i, x in enumerate(w)), "wide": t.translate({i: i + 0xFEE0 for i in range(33, 127)}), "zero": "​".join(w[:1]) + " " + " ".join(x + "​" for x in w[1:]), "spaces": "  ".join(w), "hyphen": t.replace("whenever", "when-\never"),
        "part": "x " * 50 + " ".join(w[9:27]) + " y" * 50, "changed": " ".join("other" if i % 10 == 4 else x for i, x in enumerate(w)), "lost": " ".join(x for i, x in enumerate(w) if i % 11 != 4), "code": " ".join(f"`{x}`" if i % 4 == 0 else x for i, x in enumerate(w)),
    }
    for name, text in hide.items():
        assert ix.search(text) == [5], name
    for name, text in {"short": "Someone asked about " + " ".join(w[9:20]) + " last time.", "alike": " ".join(line() for _ in range(6)), "third": " ".join("other" if i % 3 == 1 else x for i, x in enumerate(w)), "empty": "", "blank": " \n"}.items():
        assert ix.search(text) == [], name
    assert sorted(ix.search(t + " " + items[8][1])) == [5, 8]


def test_search_finds_what_brute_force_finds():
    items, line = _items()
    ix = leakage.ItemIndex(items)
    words = [leakage.normal_words(t) for _, t in items]
    r = random.Random(2)
    for _ in range(60):
        k = r.randrange(40)
        w = items[k][1].split()
        a = r.randrange(len(w) - 12)
        part = [x if r.random() > 0.06 else "other" for x in w[a : a + r.randrange(10, 40)]]
        text = " ".join([line(), *part, line()])
        doc = leakage.normal_words(text)
        want = {i for (i, _), ws in zip(items, words) if any(leakage.holds(ws, doc, d) for d in range(-len(ws), len(doc)))}
        assert set(ix.search(text)) == want


def test_short_items_count_as_a_whole():
    items = [(1, "The brisk ladder starves."), (2, "one two three four five six seven eight nine ten eleven"), (3, "缓存会保存每一行的副本"), (4, "?!"), (5, "Кэш хранит копию каждой строки, пока читатель не закроет файл, и никогда не пишет её дважды, даже если")]
    ix = leakage.ItemIndex(items)
    for text, want in {
        "so THE BRISK, ladder\n> starves now": [1], "the brisk ladder starve": [], "x one two three four five six seven eight nine ten eleven y": [2], "x one two three four other six seven eight nine ten eleven y": [2], "x one two three four five seven eight nine ten eleven y": [2],
        "x one two three other five six seven other nine ten eleven y": [], "one two three four five six seven": [], "据说缓存会保存每一行的副本，直到": [3], "缓存不会保存每一行的副本": [3], "缓存不会保存每行的副本": [], "": [], "Он сказал: кэш хранит копию каждой строки, пока читатель не закроет файл, и никогда не пишет её дважды, даже если": [5], "пока читатель спит": [],
    }.items():
        assert ix.search(text) == want, text


def test_many_added_words_and_repeats_are_found():
    items, line = _items()
    ix = leakage.ItemIndex(items)
    w = items[7][1].split()
    stretched = [y for i, x in enumerate(w) for y in ([x, "antidisestablishmentarianistically"] if i % 12 == 5 else [x])]
    assert ix.search(line() + " " + " ".join(stretched) + " " + line()) == [7]
    assert ix.search((" ".join(w[:20]) + " ") * 30) == [7]
    r = random.Random(4)
    words = [leakage.normal_words(t) for _, t in items]
    for _ in range(15):
        k = r.randrange(40)
        src, out = items[k][1].split(), []
        for x in src[r.randrange(8) :][: r.randrange(14, 48)]:
            z = r.random()
            out += ["averyverylongword" * 2, x] if z < 0.04 else [] if z < 0.07 else ["other"] if z < 0.1 else [x]
        text = " ".join([line(), *out, line()])
        doc = leakage.normal_words(text)
        want = {i for (i, _), ws in zip(items, words) if any(leakage.holds(ws, doc, d) for d in range(-len(ws), len(doc)))}
        assert set(ix.search(text)) == want


def test_blocks_of_items_give_the_same(spark):
    items, line = _items()
    docs = [(i, line() + " " + items[i][1] + " " + line()) for i in range(0, 40, 4)] + [(99, None)]
    d, it = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([*items, (None, "x"), (77, None)], "item_id long, text string")
    assert rows(leakage.leaks(d, it)) == rows(leakage.leaks(d, it, 500)) == sorted(((i, i) for i in range(0, 40, 4)), key=str)


# --- problem 10 -------------------------------------------------------------------------------------------------------

PROSE = "The first draft said that the cache keeps a copy of every row, but the tests show that it was written in a hurry. Nobody knows why the parser reads the file twice when the room is quiet."


def share(t):
    lab = quality.label_lines(t)
    total = sum(n for _, n in lab)
    return sum(n for s, n in lab if s == "prose") / total if total else 0.0


def test_line_labels():
    wrap = lambda t, n, p="": "\n".join(p + x for x in __import__("textwrap").wrap(t, n))
    for t in (PROSE, PROSE.lower().replace(".", "").replace(",", ""), PROSE.upper(), wrap(PROSE * 2, 30), wrap(PROSE, 60, "> "), "---\nid: 1\n---\n\n# Title\n\n" + PROSE, PROSE + "\n\n- one\n- two\n\n" + PROSE, "Niemand weiß mehr, warum das so ist; der Parser liest den Baum von außen nach innen bei jedem Speichern."):
        assert share(t) >= 0.5, t
    for t in ("", "\n \n", "- Build the cache of the row.\n" * 1 + "- Load the token.\n- Trim the edge after the node.\n- Seal a batch.", "Queue is stale\nThe frozen row of oak\nNo lease for the edge\nWhat to do with a node\nMerge the roots", "| a | b |\n|---|---|\n| 1 | the row of it |\n| 2 | x |", "a\t1\t2.5\nb\t3\t4.5\nc\t4\t1.5", "ha " * 200, "QUJDREVG" * 40, "x=1\ny=true\nz=old", '{"id": 1, "a": "b", "ok": true}\n{"id": 2, "a": "c", "ok": false}', PROSE[:60] + ".\n" + "a\t1\t2.5\n" * 40):
        assert share(t) < 0.5, t


def test_long_front_matter_and_rules():
    assert share("---\n" + "".join(f"key{i}: value of the row\n" for i in range(120)) + "---\n" + PROSE) >= 0.5
    assert share("---\n" + PROSE + "\n---\n" + "a\t1\t2.5\n" * 3) >= 0.5


def test_counts_of_a_text():
    got = dict(zip(quality._COUNTS, quality.count_text('The "cache" is_ 3 µ-ring.\n\n- of it\n')))
    assert got == {"n_words": 8, "n_word_chars": 26, "n_chars": 35, "n_symbols": 6, "n_lines": 2, "n_punct": 1, "n_common": 4}


def test_very_long_texts(spark):
    long = PROSE + " " + "word salad of the day " * 100_000
    docs = spark.createDataFrame([(1, long), (2, "x" * 1_000_000), (3, "\n" * 300_000)], "doc_id long, text string")
    assert quality.line_shares(docs).count() == 3 and quality.stats(docs).count() == 3
    assert packing.token_counts(docs).filter("doc_id = 2").first()["n_tokens"] > 0
    items = spark.createDataFrame(_items()[0], "item_id long, text string")
    assert leakage.leaks(docs, items).count() == 0
    assert leakage.ItemIndex(_items()[0]).search(long + _items()[0][3][1]) == [3]
