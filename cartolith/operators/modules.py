"""Names across files: import paths that exist, what modules export through re-exports, and what includes make visible.

Closures are semi-naive: a frontier of what the last round found is joined with the edges, what is known is taken away, and
the rest is the next frontier, written to the shared folder. Rounds are as many as the longest chain. A frontier of few rows
is sent to what it is joined with, so late rounds move no large table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartolith.llm.common import Scratch

from .graph import cut_lineage

#: A frontier of at most so many rows is broadcast. Larger tables are joined by merging: written tables are smaller than their rows in memory.
FEW = 50_000

#: Endings that a script's import may leave out, in the order they are tried.
SCRIPT_ENDINGS = ("", ".ts", ".tsx", ".js", ".jsx", ".mjs", "/index.ts", "/index.tsx", "/index.js", "/index.jsx")


def normalised(path: Column) -> Column:
    """A path without `.` and `..`; null if it leaves the root."""
    none = F.lit(None).cast("array<string>")
    up = lambda done: F.when(F.size(done) > 0, F.slice(done, 1, F.size(done) - 1)).otherwise(none)
    step = lambda done, part: F.when(done.isNull() | part.isin("", "."), done).when(part == "..", up(done)).otherwise(F.array_append(done, part))
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def folder(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def script_candidates(path: Column, source: Column) -> Column:
    """Files that a relative import may mean; other imports are libraries'. `x.js` may be written for `x.ts`."""
    bare = lambda base: F.when(base.rlike(r"\.[jt]sx?$"), F.regexp_replace(base, r"\.[jt]sx?$", ""))
    endings = lambda base: F.array(*(F.concat(base, F.lit(e)) for e in SCRIPT_ENDINGS), *(F.concat(bare(base), F.lit(e)) for e in (".ts", ".tsx")))
    once = F.transform(F.array(normalised(F.concat_ws("/", folder(path), source))), endings)[0]  # the path is made once, not an ending
    return F.when(source.startswith("./") | source.startswith("../") | source.isin(".", ".."), once)


def native_candidates(path: Column, source: Column) -> Column:
    """Files that an include may mean: beside the file, then under the root."""
    return F.array(normalised(F.concat_ws("/", folder(path), source)), normalised(source))


def python_candidates(path: Column, module: Column, name: Column, level: Column) -> Column:
    """Files that an import may mean: x.py, then x/__init__.py, in the file's folder and then the root, or, for a relative
    import, in the folder that its dots name. `from . import x` means the module x."""
    own = folder(path)
    up = normalised(F.concat_ws("/", own, F.array_join(F.array_repeat(F.lit(".."), F.coalesce(level, F.lit(0)) - 1), "/")))
    what = F.replace(F.when(F.coalesce(module, F.lit("")) == "", name).otherwise(module), F.lit("."), F.lit("/"))
    at = lambda where: [F.concat(F.when(where == "", "").otherwise(F.concat(where, F.lit("/"))), what, F.lit(end)) for end in (".py", "/__init__.py")]
    return F.when(F.coalesce(level, F.lit(0)) > 0, F.array(*at(up))).otherwise(F.array(*at(own), *at(F.lit(""))))


def _found(references: DataFrame, files: DataFrame, candidates: Column) -> DataFrame:
    """Distinct references that mean a file, with `target`: the first of their candidates that is one, by one equi-join."""
    key = references.columns
    ranked = references.distinct().select(*key, F.posexplode(candidates).alias("rank", "file")).filter("file is not null")
    return ranked.join(files.select(F.col("path").alias("file")).distinct(), "file").groupBy(*key).agg(F.min(F.struct("rank", "file"))["file"].alias("target"))


def existing(references: DataFrame, files: DataFrame, candidates: Column) -> DataFrame:
    """references with `target`, the first of their candidates that is a file; null if none is."""
    key = references.columns
    hit = _found(references, files, candidates).withColumnsRenamed({c: f"__{c}" for c in key})
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in key]
    return references.join(hit, same, "left").select(*key, "target")


def _links(nodes: DataFrame, files: DataFrame, kinds: list[str], candidates: Callable[[Column, Column], Column]) -> DataFrame:
    """Nodes of some kinds with the file that their source is, where it is one."""
    some = nodes.filter(F.col("kind").isin(kinds) & F.col("source").isNotNull()).select("kind", "path", "name", "alias", "source")
    found = _found(some.select("path", "source"), files, candidates(F.col("path"), F.col("source")))
    return some.join(found, ["path", "source"]).select("kind", "path", "name", "alias", "target").distinct()


def exported(definitions: DataFrame, aliases: DataFrame, stars: DataFrame) -> DataFrame:
    """(path, name, def_path, def_name): what each module exports and where that is defined.

    definitions: the same columns, for names that a module defines itself. aliases: (path, name, target, target_name) for
    names passed on, perhaps under another name. stars: (path, target) for modules that pass on all but the default. A
    name stated in a module hides those that come with a star; of several stars the least defining path counts.
    """
    scratch = Scratch(definitions.sparkSession, "exports")
    best = lambda rows, *what: rows.groupBy("path", "name").agg(F.min(F.struct(*what)).alias("d")).select("path", "name", "d.*")
    frontier = scratch.write(best(definitions, "def_path", "def_name"))
    aliases, stars = scratch.write(aliases.distinct()), scratch.write(stars.distinct())
    stated = aliases.select("path", "name", F.lit(1).alias("by_star"))
    known, n = [frontier], frontier.count()
    while n:
        reached = frontier.withColumnsRenamed({"path": "target", "name": "target_name"})
        reached = F.broadcast(reached) if n <= FEW else reached.hint("merge")
        by_alias = aliases.join(reached, ["target", "target_name"]).select("path", "name", F.lit(0).alias("by_star"), "def_path", "def_name")
        by_star = stars.join(reached.filter("target_name <> 'default'"), "target").select("path", F.col("target_name").alias("name"), F.lit(1).alias("by_star"), "def_path", "def_name")
        new = scratch.write(best(by_alias.unionByName(by_star), "by_star", "def_path", "def_name"))
        m = new.count()
        if not m:
            break
        had = lambda t: t.join(F.broadcast(new.select("path", "name")), ["path", "name"], "left_semi") if m <= FEW else t.hint("merge")  # noqa: E731,B023
        fresh = new.join(had(scratch.all_of(known).select("path", "name")), ["path", "name"], "left_anti").join(had(stated), ["path", "name", "by_star"], "left_anti")
        frontier = scratch.write(fresh.drop("by_star"))
        scratch.drop(new)
        known.append(frontier)
        n = frontier.count()
    return scratch.all_of(known).hint("merge")


def script_links(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """(kind, path, name, alias, target): imports and exports of a table of syntax nodes that lead to a file, written once."""
    return Scratch(nodes.sparkSession, "links").write(_links(nodes.filter("parent is null"), files, ["import", "export"], script_candidates)).hint("merge")


def script_exports(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """`exported` of a table of syntax nodes. links: of `script_links`."""
    top = nodes.filter("parent is null")
    imports, passed = links.filter("kind = 'import'"), links.filter("kind = 'export'")
    own = top.filter("exported and kind in ('function', 'class', 'variable') and name is not null").select("path", "name", F.col("name").alias("local"))
    listed = top.filter("kind = 'export' and source is null and alias is not null").select("path", F.col("alias").alias("name"), F.col("name").alias("local"))
    # A listed name that is imported is passed on; the others are the module's own.
    brought = imports.filter("name <> '*'").select("path", F.col("alias").alias("local"), "target", F.col("name").alias("target_name"))
    definitions = own.unionByName(listed.join(brought.select("path", "local"), ["path", "local"], "left_anti")).select("path", "name", F.col("path").alias("def_path"), F.col("local").alias("def_name"))
    aliases = listed.join(brought, ["path", "local"]).select("path", "name", "target", "target_name")
    aliases = aliases.unionByName(passed.filter("name <> '*'").select("path", F.col("alias").alias("name"), "target", F.col("name").alias("target_name")))
    return exported(definitions, aliases, passed.filter("name = '*' and alias is null").select("path", "target"))


def imported_functions(nodes: DataFrame, files: DataFrame, defined: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """For `resolve_script`: keys (x, x.y) whose head a file imports, with the function they mean in another file."""
    links = script_links(nodes, files)
    brought = links.filter("kind = 'import'").select("path", F.col("alias").alias("head"), "target", F.col("name").alias("bound"))
    exports = script_exports(nodes, links).withColumnsRenamed({"path": "target", "name": "wanted"})

    def elsewhere(keys: DataFrame) -> DataFrame:
        after = lambda c: F.nullif(F.regexp_replace(c, r"^[^.]*\.?", ""), F.lit(""))
        k = keys.withColumns({"head": F.substring_index("key", ".", 1), "rest": after(F.col("key"))}).join(brought, ["path", "head"])
        whole = F.col("bound") == "*"  # a namespace: its member is the name
        k = k.withColumn("wanted", F.when(whole, F.substring_index("rest", ".", 1)).otherwise(F.col("bound")))
        k = k.withColumn("rest", F.when(whole, after(F.col("rest"))).otherwise(F.col("rest"))).join(exports, ["target", "wanted"])
        k = k.select("path", "key", F.col("def_path").alias("target_path"), F.concat_ws(".", "def_name", "rest").alias("target"))
        return k.join(defined.select(F.col("path").alias("target_path"), F.col("key").alias("target")), ["target_path", "target"]).select("path", "key", "target_path", "target")

    return elsewhere


def visible(wanted: DataFrame, includes: DataFrame, have: DataFrame) -> DataFrame:
    """(path, key, at): for each wanted (path, key) the nearest included files that have the key.

    Only keys that are asked for move along the includes, a step a round, and each file is visited once a key.
    """
    includes = cut_lineage(includes.select(F.col("path").alias("at"), F.col("target").alias("next")).distinct())
    have = cut_lineage(have.select(F.col("path").alias("at"), "key").distinct().withColumn("hit", F.lit(True)))  # once, not a round
    frontier = seen = cut_lineage(wanted.select("path", "key", F.col("path").alias("at")).distinct())
    found = None
    while not frontier.isEmpty():
        step = frontier.join(includes, "at").select("path", "key", F.col("next").alias("at")).distinct().join(seen, ["path", "key", "at"], "left_anti")
        told = step.join(have, ["at", "key"], "left").withColumn("done", F.max("hit").over(Window.partitionBy("path", "key")))
        told = cut_lineage(told.select("path", "key", "at", "hit", "done"))
        hit, step = told.filter("hit").select("path", "key", "at"), told.select("path", "key", "at")
        found = hit if found is None else found.unionByName(hit)
        frontier, seen = told.filter("done is null").select("path", "key", "at"), seen.unionByName(step)
    return found if found is not None else wanted.select("path", "key", F.col("path").alias("at")).limit(0)


def included_functions(nodes: DataFrame, files: DataFrame, defined: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """For `resolve_native`: keys that an included file defines, or declares and a file that includes it defines."""
    key = F.when(F.col("owner").isNull(), F.col("name")).otherwise(F.concat_ws("::", "owner", "name"))
    declared = nodes.filter("kind = 'prototype'").select("path", key.alias("key")).distinct()
    includes = cut_lineage(_links(nodes, files, ["import"], native_candidates).select("path", "target").distinct())

    def elsewhere(keys: DataFrame) -> DataFrame:
        seen = visible(keys, includes, defined.unionByName(declared))
        here = seen.join(defined.select(F.col("path").alias("at"), "key"), ["at", "key"]).select("path", "key", F.lit(0).alias("far"), "at")
        # Bodies of what is only declared: in files whose includes lead to the same header.
        open_ = declared.join(seen.select(F.col("at").alias("path"), "key").distinct(), ["path", "key"])
        reach = visible(defined.join(open_.select("key").distinct(), "key", "left_semi"), includes, open_)
        bodies = reach.select("at", "key", F.col("path").alias("body"))
        there = seen.join(bodies, ["at", "key"]).select("path", "key", F.lit(1).alias("far"), F.col("body").alias("at"))
        best = here.unionByName(there).groupBy("path", "key").agg(F.min(F.struct("far", "at")).alias("b"))
        return best.select("path", "key", F.col("b.at").alias("target_path"), F.col("key").alias("target"))

    return elsewhere


def call_graph(calls: DataFrame) -> DataFrame:
    """(source, target): edges between functions named path::function, from resolved calls."""
    caller = F.concat_ws("::", "path", F.concat_ws(".", "owner", "caller"))
    return calls.filter("status = 'resolved_project'").select(caller.alias("source"), F.concat_ws("::", "target_path", "target").alias("target")).distinct()


def graph_totals(calls: DataFrame, max_files: int | None = None) -> DataFrame:
    """One row: analysed files, functions that call or are called, edges, and entry points, which nothing calls.

    With `max_files`, more files than that are an error, as in an interactive request.
    """
    calls = Scratch(calls.sparkSession, "calls").write(calls.select("path", "owner", "caller", "target_path", "target", "status"))  # read more than once
    edges = call_graph(calls)
    ends = edges.select(F.col("source").alias("node"), F.lit(1).alias("calls"), F.lit(0).alias("called")).unionByName(edges.select(F.col("target").alias("node"), F.lit(0).alias("calls"), F.lit(1).alias("called")))
    nodes = ends.groupBy("node").agg(F.sum("calls").alias("calls"), F.sum("called").alias("called"))
    rows = nodes.select(F.lit(0).alias("file"), "calls", "called").unionByName(calls.select("path").distinct().select(F.lit(1).alias("file"), F.lit(0).alias("calls"), F.lit(1).alias("called")))
    out = rows.agg(F.count_if(F.col("file") == 1).alias("analysed_files"), F.count_if(F.col("file") == 0).alias("functions"), F.coalesce(F.sum("calls"), F.lit(0)).alias("edges"), F.count_if(F.col("called") == 0).alias("entry_points"))
    if max_files is not None and out.first()["analysed_files"] > max_files:
        raise ValueError(f"more than {max_files} files")
    return out
