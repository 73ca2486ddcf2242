"""The link graph of pages: links in document order, what they lead to, and the reports on members, artefacts and plans."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborweft.functions.text import path_depth
from arborweft.operators.imports import joined

# Folders that a path from the root is tried under after the root itself.
DOC_FOLDERS = ("docs", "doc", "documentation")


def links(pages: DataFrame) -> DataFrame:
    """L1: (path, no, kind, target) of the links of pages (path, text), numbered in document order."""
    from arborweft.plans.links import markdown_links

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(p, i, kind, target) for p, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for i, (_, kind, target) in enumerate(markdown_links(t or ""))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int32(), pa.string(), pa.string()))], names=["path", "no", "kind", "target"])

    some = pages.filter("path is not null").filter(F.col("text").contains("](") | F.col("text").contains("[["))
    return some.select("path", "text").mapInArrow(run, "path string, no int, kind string, target string")


def _folder(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))


def resolve(found: DataFrame, pages: DataFrame) -> DataFrame:
    """L2-L4: path, no, target, outcome (page, external, none, broken), resolved, ambiguous.

    Addresses and mail are external; a bare fragment leads nowhere and is not broken; a path from the root is tried there and
    under the usual folders; any other path from the page's folder, and once more with one step up less. A wiki link meets the
    pages of its name in any letter case: the nearest in depth, then the first by alphabet; more than one is ambiguous. All
    tries of a link are rows of one equi-join; the first that exists wins."""
    f = found.withColumn("bare", F.regexp_replace("target", "[#?].*$", ""))
    external = (F.col("kind") == "markdown") & F.lower("target").rlike("^(https?:|mailto:)")
    nothing = (F.col("kind") == "markdown") & ~external & (F.col("bare") == "")
    md = f.filter((F.col("kind") == "markdown") & ~external & ~nothing)
    root = F.col("bare").startswith("/")
    rest = F.regexp_replace("bare", "^/+", "")
    tries = F.when(root, F.array(joined(F.lit(""), rest), *[joined(F.lit(x), rest) for x in DOC_FOLDERS])).otherwise(F.array(joined(_folder(F.col("path")), F.col("bare")), joined(_folder(F.col("path")), F.regexp_replace("bare", r"^\.\./", ""))))
    known = pages.filter("path is not null").select(F.col("path").alias("at")).distinct()
    hit = md.select("path", "no", F.posexplode(tries).alias("ord", "at")).join(known, "at").groupBy("path", "no").agg(F.min(F.struct("ord", "at")).alias("m"), F.lit(1).cast("long").alias("n"))
    name = lambda c: F.lower(F.regexp_replace(F.substring_index(c, "/", -1), r"\.md$", ""))
    wiki = f.filter("kind = 'wiki'").select("path", "no", name(F.col("bare")).alias("name")).join(known.withColumn("name", name(F.col("at"))), "name")
    near = wiki.groupBy("path", "no").agg(F.min(F.struct(F.abs(path_depth(F.col("path")) - path_depth(F.col("at"))).alias("ord"), "at")).alias("m"), F.count("*").alias("n"))
    j = f.join(hit.select("path", "no", F.col("m.at").alias("resolved"), "n").union(near.select("path", "no", F.col("m.at"), "n")), ["path", "no"], "left")
    outcome = F.when(external, "external").when(nothing, "none").when(F.col("resolved").isNotNull(), "page").otherwise("broken")
    return j.select("path", "no", "target", outcome.alias("outcome"), "resolved", (F.coalesce("n", F.lit(0)) > 1).alias("ambiguous"))


def inbound(resolved: DataFrame, pages: DataFrame) -> DataFrame:
    """Path, n_inbound: pages that link to a page, each once; 0 marks an orphan."""
    n = resolved.filter("outcome = 'page' and resolved <> path").select("path", "resolved").distinct().groupBy(F.col("resolved").alias("path")).agg(F.count("*").alias("n"))
    return pages.select("path").filter("path is not null").distinct().join(n, "path", "left").select("path", F.coalesce("n", F.lit(0)).cast("long").alias("n_inbound"))


def stale(recorded: DataFrame, live: DataFrame, artefacts: DataFrame) -> DataFrame:
    """(rank, line) of a stale report. recorded and live (member, status): DRIFT lines for members that went, came or have
    another status; artefacts (artefact, member, made_at, changed_at): STALE where the member changed later, or where either
    time is unknown. Lines of membership come first."""
    j = recorded.withColumnRenamed("status", "was").withColumn("o", F.lit(True)).join(live.withColumnRenamed("status", "is").withColumn("w", F.lit(True)), "member", "full")
    drift = F.when(F.col("w").isNull(), F.concat(F.lit("DRIFT removed "), "member")).when(F.col("o").isNull(), F.concat(F.lit("DRIFT added "), "member")).when(~F.col("was").eqNullSafe(F.col("is")), F.concat(F.lit("DRIFT status "), "member", F.lit(" "), "was", F.lit("→"), "is"))
    a = artefacts.filter(F.coalesce(F.col("changed_at") > F.col("made_at"), F.lit(True)))
    return j.select(F.lit(0).alias("rank"), drift.alias("line")).filter("line is not null").union(a.select(F.lit(1), F.concat(F.lit("STALE "), "artefact")))


def exit_code(report: DataFrame) -> int:
    """0 for a clean report, 1 for any line."""
    return 0 if report.isEmpty() else 1


def scope(folder: str, members: dict[str, str], realm_root: str | None) -> tuple[str, str | None]:
    """M1: where a command stands: ('member', its key) in the member whose root is the longest prefix, ('realm', None) elsewhere
    under the realm's root, else ('repo', None)."""
    under = lambda root: folder == root or folder.startswith(root.rstrip("/") + "/")
    best = max((k for k, root in members.items() if under(root)), key=lambda k: len(members[k]), default=None)
    if best is not None:
        return "member", best
    return ("realm", None) if realm_root is not None and under(realm_root) else ("repo", None)
