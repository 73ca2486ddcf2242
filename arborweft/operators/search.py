"""Ranked search over symbols: filters, weighted BM25, substring and fuzzy tiers (Q1-Q17)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborweft.functions.text import osa_udf, path_depth
from arborweft.sources.tables import Scratch

# Search bonus per kind; kinds and languages a filter may name; weights of the searched columns; BM25.
KIND_BONUS = {
    10: ("function", "method"), 9: ("interface", "trait", "protocol", "route"), 8: ("class", "component", "table", "view", "procedure", "policy"), 6: ("type_alias", "struct"), 5: ("enum",),
    4: ("module", "namespace"), 3: ("property", "field", "constant"), 2: ("column", "constraint", "index", "sequence", "trigger", "variable"), 1: ("import", "export"),
}
LANGUAGES = ("go", "java", "javascript", "typescript", "python", "sql", "unknown")
KINDS = tuple(k for ks in KIND_BONUS.values() for k in ks) + ("file", "package", "enum_member", "parameter")
WEIGHTS = {"id": 0.0, "name": 20.0, "qualified_name": 5.0, "docstring": 1.0, "signature": 2.0}
K1, B = 1.2, 0.75
OVERFETCH = 5


@dataclass(frozen=True)
class Query:
    """Q1: a search text taken apart. Later filters of a kind win; an unknown kind or language stays free text."""

    text: str = ""
    kind: str | None = None
    language: str | None = None
    path: str | None = None
    name: str | None = None

    @classmethod
    def parse(cls, raw: str) -> "Query":
        got: dict[str, str] = {}
        free = []
        for t in raw.split():
            key, sep, value = t.partition(":")
            key = {"lang": "language"}.get(key.lower(), key.lower())
            if sep and value and key in ("kind", "language", "path", "name") and (key not in ("kind", "language") or value.lower() in (KINDS if key == "kind" else LANGUAGES)):
                got[key] = value.lower() if key in ("kind", "language") else value
            else:
                free.append(t)
        return cls(" ".join(free), **got)

    @property
    def filtered(self) -> bool:
        return any((self.kind, self.language, self.path, self.name))

    def keep(self, n: DataFrame) -> DataFrame:
        """Q9: all filters together."""
        if self.kind:
            n = n.filter(F.col("kind") == self.kind)
        if self.language:
            n = n.filter(F.col("language") == self.language)
        if self.path:
            n = n.filter(F.col("file_path").contains(self.path))
        if self.name:
            n = n.filter(F.lower("name").contains(self.name.lower()))
        return n


def kind_bonus(kind: Column) -> Column:
    out = F.lit(0.0)
    for score, kinds in KIND_BONUS.items():
        out = F.when(kind.isin(*kinds), F.lit(float(score))).otherwise(out)
    return out


def path_relevance(path: Column) -> Column:
    return F.when(path.isNull() | (path == ""), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.lit(5.0) - path_depth(path) * 0.5))


def name_bonus(name: Column, text: str) -> Column:
    if not text:
        return F.lit(0.0)
    low, q = F.lower(name), text.lower()
    return F.when(low == q, F.lit(5.0)).when(low.startswith(q), F.lit(3.0)).when(low.contains(q), F.lit(1.0)).otherwise(F.lit(0.0))


def in_test_file(path: Column) -> Column:
    low = F.lower(path)
    return F.coalesce(low.rlike(r"(^|/)(test|spec|__tests__)(/|$)") | F.substring_index(low, "/", -1).rlike(r"_test\.|\.test\.|\.spec\."), F.lit(False))


def _tokens(c: str) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(F.col(c), F.lit(""))), "[^\\p{L}\\p{N}]+"), lambda t: t != "")


def bm25(nodes: DataFrame, text: str) -> DataFrame:
    """Q2, Q3: rows with any token prefix of the query, with column `bm25` (greater is better here): weighted BM25 over the
    words of id, name, qualified name, docstring and signature; each query token is a phrase of its parts, the last one a
    prefix. One scan: the corpus numbers are one aggregated row, joined back without a shuffle of the rows."""
    words = nodes
    for c in WEIGHTS:
        words = words.withColumn(f"t_{c}", _tokens(c))
    parts = [[w.lower() for w in _split(t)] for t in text.replace("::", " ").split()]
    parts = [p for p in parts if p]
    length = sum((F.size(f"t_{c}") for c in WEIGHTS), F.lit(0))
    words = words.withColumn("len_", length)
    for i, p in enumerate(parts):
        tf = sum((F.lit(w) * _hits(f"t_{c}", p) for c, w in WEIGHTS.items()), F.lit(0.0))
        seen = sum((_hits(f"t_{c}", p) for c in WEIGHTS), F.lit(0))
        words = words.withColumn(f"tf_{i}", tf).withColumn(f"has_{i}", seen > 0)
    stats = words.agg(F.count("*").alias("n_"), F.avg("len_").alias("avg_"), *[F.sum(F.col(f"has_{i}").cast("long")).alias(f"df_{i}") for i in range(len(parts))]).first()
    score, any_ = F.lit(0.0), F.lit(False)
    for i in range(len(parts)):
        df, n = stats[f"df_{i}"] or 0, stats["n_"]
        idf = F.greatest(F.lit(1e-6), F.log(F.lit((n - df + 0.5) / (df + 0.5))))
        tf = F.col(f"tf_{i}")
        score = score + F.when(F.col(f"has_{i}"), idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("len_") / (stats["avg_"] or 1.0)))).otherwise(0.0)
        any_ = any_ | F.col(f"has_{i}")
    return words.filter(any_).withColumn("bm25", score).select(*nodes.columns, "bm25")


def _split(token: str) -> list[str]:
    import re

    return re.findall(r"[^\W_]+", token)


def _hits(c: str, phrase: list[str]) -> Column:
    """How often the words of a column hold the phrase, its last word as a prefix."""
    if len(phrase) == 1:
        return F.size(F.filter(c, lambda t: t.startswith(phrase[0])))
    hit = lambda i: [*(F.get(c, i + k) == w for k, w in enumerate(phrase[:-1])), F.get(c, i + len(phrase) - 1).startswith(phrase[-1])]

    def both(i):
        out = F.lit(True)
        for x in hit(i):
            out = out & F.coalesce(x, F.lit(False))
        return out

    return F.size(F.filter(F.sequence(F.lit(0), F.greatest(F.size(c) - 1, F.lit(0))), lambda i: both(i)))


def _rank(n: DataFrame, score: Column, tier: str, limit: int | None) -> DataFrame:
    out = n.select("id", "kind", "name", "file_path", F.round(score, 6).alias("score"), F.lit(tier).alias("tier"))
    return out.orderBy(F.desc("score"), "id").limit(limit) if limit else out


def fts(nodes: DataFrame, q: Query, raw: str, limit: int = 20) -> DataFrame:
    """Q3, Q4: the best 5 * limit by BM25 (ties by id), rescored with kind, path and name bonus, less 15 for test files
    unless the query names tests; then filtered and cut. Both cuts belong to the feature."""
    top = bm25(nodes, q.text).orderBy(F.desc(F.round("bm25", 9)), "id").limit(limit * OVERFETCH)
    score = F.col("bm25") + kind_bonus(F.col("kind")) + path_relevance(F.col("file_path")) + name_bonus(F.col("name"), q.text)
    if "test" not in raw.lower():
        score = score - F.when(in_test_file(F.col("file_path")), 15.0).otherwise(0.0)
    return _rank(q.keep(top), score, "fts", limit)


def like(nodes: DataFrame, q: Query, limit: int = 20) -> DataFrame:
    """Q10: substring tier."""
    low, t = F.lower("name"), q.text.lower()
    base = F.when(low == t, 1.0).when(low.startswith(t), 0.9).when(low.contains(t), 0.8).when(F.lower("qualified_name").contains(t), 0.7)
    hit = q.keep(nodes.filter(base.isNotNull()))
    return _rank(hit, base + kind_bonus(F.col("kind")) + path_relevance(F.col("file_path")), "like", limit)


def fuzzy(nodes: DataFrame, q: Query, limit: int = 20) -> DataFrame:
    """Q11, Q12: names within 1 edit (queries up to 4 characters) or 2. The length is checked before any distance."""
    most = 1 if len(q.text) <= 4 else 2
    near = nodes.filter(F.abs(F.octet_length(F.lower("name")) - len(q.text.lower().encode())) <= most)
    hit = near.withColumn("dist", osa_udf(q.text, most)(F.col("name"))).filter("dist >= 0")
    return _rank(q.keep(hit), (F.lit(most + 1.0) - F.col("dist")) / (most + 1.0) + kind_bonus(F.col("kind")) + path_relevance(F.col("file_path")), "fuzzy", limit)


def filters_only(nodes: DataFrame, q: Query, limit: int | None = 20) -> DataFrame:
    """Q13: filters without free text."""
    score = kind_bonus(F.col("kind")) + path_relevance(F.col("file_path")) + F.when(F.coalesce("is_exported", F.lit(False)), 1.0).otherwise(0.0) + name_bonus(F.col("name"), q.name or "")
    return _rank(q.keep(nodes), score, "filter", limit)


def search(nodes: DataFrame, raw: str, limit: int = 20) -> DataFrame:
    """The first tier that finds anything (Q14, Q15); a blank query finds nothing. The nodes are written once for all tiers,
    and the tier that is asked is written before it is looked at, so no tier runs twice."""
    q = Query.parse(raw)
    if not q.text:
        return filters_only(nodes, q, limit) if q.filtered else filters_only(nodes.limit(0), q, limit)
    scratch = Scratch(nodes.sparkSession, "search")
    nodes = scratch.write(nodes)
    for tier in (lambda: fts(nodes, q, raw, limit), lambda: like(nodes, q, limit)):
        found = scratch.write(tier())
        if not found.isEmpty():
            return found
    return fuzzy(nodes, q, limit)


def members_search(nodes: DataFrame, text: str, only: tuple = (), exclude: tuple = (), limit: int = 5) -> DataFrame:
    """Q17, M2, M3: member, id, name, score, rn: the ranked search of each member on its own (`member` is a column of nodes), all
    in one job: corpus numbers are counted per member, `only` wins over `exclude`."""
    from pyspark.sql import Window

    n = nodes.filter(F.col("member").isin(*only)) if only else nodes.filter(~F.col("member").isin(*exclude)) if exclude else nodes
    words = n
    for c in WEIGHTS:
        words = words.withColumn(f"t_{c}", _tokens(c))
    parts = [p for p in ([w.lower() for w in _split(t)] for t in text.replace("::", " ").split()) if p]
    words = words.withColumn("len_", sum((F.size(f"t_{c}") for c in WEIGHTS), F.lit(0)))
    for i, p in enumerate(parts):
        words = words.withColumn(f"tf_{i}", sum((F.lit(w) * _hits(f"t_{c}", p) for c, w in WEIGHTS.items()), F.lit(0.0))).withColumn(f"has_{i}", sum((_hits(f"t_{c}", p) for c in WEIGHTS), F.lit(0)) > 0)
    stats = words.groupBy("member").agg(F.count("*").alias("n_"), F.avg("len_").alias("avg_"), *[F.sum(F.col(f"has_{i}").cast("long")).alias(f"df_{i}") for i in range(len(parts))])
    any_ = F.lit(False)
    for i in range(len(parts)):
        any_ = any_ | F.col(f"has_{i}")
    j = words.filter(any_).join(stats, "member")
    score = F.lit(0.0)
    for i in range(len(parts)):
        df, tf = F.col(f"df_{i}"), F.col(f"tf_{i}")
        idf = F.greatest(F.lit(1e-6), F.log((F.col("n_") - df + 0.5) / (df + 0.5)))
        score = score + F.when(F.col(f"has_{i}"), idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("len_") / F.col("avg_")))).otherwise(0.0)
    score = score + kind_bonus(F.col("kind")) + path_relevance(F.col("file_path")) + name_bonus(F.col("name"), text)
    if "test" not in text.lower():
        score = score - F.when(in_test_file(F.col("file_path")), 15.0).otherwise(0.0)
    z = j.select("member", "id", "name", F.round(score, 6).alias("score"))
    return z.withColumn("rn", F.row_number().over(Window.partitionBy("member").orderBy(F.desc("score"), "id")).cast("long")).filter(F.col("rn") <= limit)
