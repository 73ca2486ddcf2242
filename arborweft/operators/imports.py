"""Import specifiers to files and packages: aliases, external classes, endings, re-exports."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborweft.operators.resolve import candidate_paths, is_external, npm_package, reexports

JS = ("javascript", "typescript", "jsx", "tsx")
Alias = tuple[str, bool, str]  # what the specifier equals or begins with, whether it is a beginning, the first target

_JSONC = re.compile(r'("(?:[^"\\]|\\.)*")|//[^\n]*|/\*.*?\*/|,(?=\s*[}\]])', re.S)


def path_aliases(config: str) -> list[Alias]:
    """The aliases of a JSON configuration with comments and trailing commas, in their order; the base folder stands
    before each target. A configuration that can't be read has none."""
    plain = _JSONC.sub(lambda m: m[1] or "", config)
    plain = _JSONC.sub(lambda m: m[1] or "", plain)  # a comment may have stood behind a trailing comma
    try:
        options = json.loads(plain).get("compilerOptions") or {}
        base, paths = options.get("baseUrl") or "", options.get("paths") or {}
        out = []
        for key, targets in paths.items():
            if targets:
                target = targets[0] if not base or targets[0].startswith("/") else f"{base}/{targets[0]}"
                out.append((key[:-1], True, target) if key.endswith("/*") else (key, False, target))
        return out
    except (ValueError, AttributeError, TypeError):
        return []


def joined(folder: Column, path: Column) -> Column:
    """A path relative to a folder, without '.' and '..'; steps above the root stay as '..'."""
    parts = F.filter(F.split(F.concat_ws("/", folder, path), "/"), lambda x: (x != "") & (x != "."))
    empty = F.array().cast("array<string>")
    up = F.aggregate(parts, empty, lambda a, x: F.when((x == "..") & (F.size(a) > 0) & (F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit("")) != ".."), F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.array_append(a, x)))
    return F.array_join(up, "/")


def resolve(refs: DataFrame, files: DataFrame, aliases: list[Alias] = (), exports: DataFrame | None = None) -> DataFrame:
    """ref_id, outcome (internal, external, unresolved), target_id, package.

    refs (id, reference_name, language, file_path), files (path). Query and fragment are cut from JavaScript specifiers. An
    alias comes before anything else: it leads to a file or to nothing, never to a package. All endings are tried in one
    equi-join with the files, the first that exists wins. exports (id, source, target, kind): the first re-export of the
    found file is followed, eight times at most. The aliases are one project's: a list of a few lines."""
    js = F.coalesce(F.col("language").isin(*JS), F.lit(False))
    spec = F.when(js, F.regexp_replace("reference_name", "^(.+?)[?#].*$", "$1")).otherwise(F.col("reference_name"))
    r = refs.select(F.col("id").alias("ref_id"), spec.alias("spec"), "language", "file_path").filter("spec is not null and spec <> ''")
    relative = F.col("spec").rlike(r"^\.\.?(/|$)")
    aliased = F.lit(None).cast("string")
    for key, begins, target in reversed(list(aliases)):
        hit = F.col("spec").startswith(key) if begins else F.col("spec") == key
        rest = F.expr(f"substring(spec, {len(key) + 1})")
        to = F.concat(F.lit(target[:-1] if target.endswith("*") else target), rest) if begins else F.lit(target)
        aliased = F.when(hit, joined(F.lit(""), F.regexp_replace(to, r"\.(d\.ts|tsx?|jsx?)$", ""))).otherwise(aliased)
    aliased = F.when(~relative, aliased)
    folder = F.when(F.col("file_path").contains("/"), F.regexp_replace("file_path", "/[^/]*$", "")).otherwise(F.lit(""))
    outside = aliased.isNull() & is_external(F.col("spec"), F.col("language"))
    r = r.withColumn("outside", outside).withColumn("package", F.when(outside & js, npm_package(F.col("spec")))).withColumn("base", F.when(~outside, F.coalesce(aliased, joined(folder, F.col("spec")))))
    tries = r.filter("base is not null").select("ref_id", F.posexplode(candidate_paths(F.col("base"), F.col("language"))).alias("ord", "path"))
    found = tries.join(files.select("path").distinct(), "path").groupBy("ref_id").agg(F.min(F.struct("ord", "path")).alias("m")).select("ref_id", F.concat(F.lit("file:"), "m.path").alias("target_id"))
    if exports is not None:
        followed = reexports(exports, found.select(F.col("target_id").alias("id")).distinct())
        found = found.join(followed.select(F.col("id").alias("target_id"), "final"), "target_id").select("ref_id", F.col("final").alias("target_id"))
    out = r.join(found, "ref_id", "left")
    how = F.when(F.col("outside"), "external").when(F.col("target_id").isNotNull(), "internal").otherwise("unresolved")
    target = F.when(F.col("package") != "", F.concat(F.lit("package:npm/"), "package")).otherwise(F.col("target_id"))
    return out.select("ref_id", how.alias("outcome"), target.alias("target_id"), F.when(F.col("package") != "", F.col("package")).alias("package"))
