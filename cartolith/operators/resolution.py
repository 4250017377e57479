"""Call and class resolution: references of a program joined to its definitions."""

from __future__ import annotations

import builtins
import sys

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartolith.functions.text import module_name, resolve_relative

from .graph import cut_lineage

BUILTINS, STDLIB = sorted(dir(builtins)), sorted(sys.stdlib_module_names)


def classify_external(name: Column, module: Column) -> Column:
    """What an unresolved call is: a builtin, of the standard library, or of a third party."""
    head = F.substring_index(module, ".", 1)
    return (
        F.when(name.isin(BUILTINS) & module.isNull(), "ignored_builtin").when(head.isin(STDLIB), "ignored_stdlib")
        .when(module.isNotNull(), "ignored_third_party").when(name.isin(STDLIB), "ignored_stdlib").otherwise("unresolved")
    )


def import_targets(imports: DataFrame) -> DataFrame:
    """(path, alias, module, name): what a name means in a file, relative modules resolved."""
    own = module_name(F.col("path"))
    module = F.when(F.col("level") > 0, resolve_relative(own, F.col("module"), F.col("level"))).otherwise(F.col("module"))
    return imports.select("path", "alias", module.alias("module"), "name")


def resolve_calls(calls: DataFrame, symbols: DataFrame, imports: DataFrame, types: DataFrame) -> DataFrame:
    """Calls with the symbol they reach and how it was found.

    Candidates, in order: a method of the own class, a function of the file, a class of the file, an imported name, a
    name of an imported module, a method of the receiver's inferred type. All candidates of all calls are joined to the
    definitions at once by (module, qualified name), and the lowest rank wins.
    """
    own = module_name(F.col("path"))
    definitions = symbols.filter("kind <> 'error'").select(own.alias("module"), F.concat_ws(".", "parent", "name").alias("qualified"), F.concat_ws(":", "path", F.concat_ws(".", "parent", "name")).alias("target"))
    meaning = import_targets(imports).select(F.col("path").alias("ip"), F.col("alias").alias("ia"), F.col("module").alias("im"), F.col("name").alias("iname"))
    best = types.groupBy("path", "function", "variable").agg(F.max_by("type", F.struct("confidence", "type")).alias("inferred")).select(F.col("path").alias("tp"), F.col("function").alias("tf"), F.col("variable").alias("tv"), "inferred")
    c = calls.withColumn("call_id", F.monotonically_increasing_id()).withColumn("module", own)
    c = c.join(meaning, (F.col("path") == F.col("ip")) & (F.coalesce("receiver", "callee") == F.col("ia")), "left")
    c = c.join(best, (F.col("path") == F.col("tp")) & (F.substring_index("caller", ".", -1) == F.col("tf")) & (F.col("receiver") == F.col("tv")), "left")
    none = F.lit(None).cast("string")
    bare, is_self = F.col("receiver").isNull(), F.col("call_type") == "self"
    candidate = lambda how, when, module, name: F.struct(F.lit(how).alias("how"), F.when(when, module).alias("module"), F.when(when, name).alias("qualified"))
    options = F.array(
        candidate("self", is_self, F.col("module"), F.concat_ws(".", "owner", "callee")),
        candidate("local", bare, F.col("module"), F.col("callee")),
        candidate("static", F.col("call_type") == "static", F.col("module"), F.concat_ws(".", "receiver", "callee")),
        candidate("import", bare & F.col("iname").isNotNull(), F.col("im"), F.col("iname")),
        candidate("module", ~bare & F.col("im").isNotNull(), F.when(F.col("iname").isNull(), F.col("im")).otherwise(F.concat_ws(".", "im", "iname")), F.col("callee")),
        candidate("import", ~bare & F.col("iname").isNotNull(), F.col("im"), F.concat_ws(".", "iname", "callee")),
        candidate("type", F.col("inferred").isNotNull(), F.col("module"), F.concat_ws(".", "inferred", "callee")),
    )
    ranked = c.select("call_id", F.posexplode(options).alias("rank", "o")).select("call_id", "rank", "o.*").filter("module is not null")
    hit = ranked.join(definitions, ["module", "qualified"]).groupBy("call_id").agg(F.min(F.struct("rank", "target", "how")).alias("hit"))
    out = c.join(hit, "call_id", "left")
    external = classify_external(F.col("callee"), F.coalesce("im", F.when(~bare & ~is_self & F.col("inferred").isNull(), none)))
    return out.select(*calls.columns, F.col("hit.target").alias("target"), F.col("hit.how").alias("how"), F.when(F.col("hit").isNotNull(), "resolved_project").otherwise(external).alias("status"))


def class_graph(references: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """Edges (source, target, type, internal) between classes; names that nothing defines stay as they are."""
    own = module_name(F.col("path"))
    classes = symbols.filter("kind = 'class'").select(F.concat_ws(".", own, F.col("name")).alias("full"))
    meaning = import_targets(imports).select(F.col("path").alias("ip"), F.col("alias").alias("ia"), F.concat_ws(".", "module", "name").alias("meant"))
    references = cut_lineage(references)  # read twice, and each file is parsed once
    head, tail = F.substring_index("raw", ".", 1), F.regexp_replace("raw", r"^[^.]*\.?", "")
    # What a name means hangs on its file alone. A running number would not do as a key: rows that came by a shuffle may lie
    # in another order when they are made again.
    r = references.select("path", "raw").distinct().withColumns({"head": head, "tail": tail, "module": own})
    r = r.join(meaning, (F.col("path") == F.col("ip")) & (F.col("head") == F.col("ia")), "left")
    names = F.array(F.concat_ws(".", "module", "raw"), F.when(F.col("meant").isNotNull(), F.concat_ws(".", "meant", F.nullif("tail", F.lit("")))), F.col("raw"))
    hit = r.select("path", "raw", F.posexplode(names).alias("rank", "full")).join(classes, "full").groupBy("path", "raw").agg(F.min(F.struct("rank", "full"))["full"].alias("target"))
    out = references.join(hit, ["path", "raw"], "left")
    return out.select(F.concat_ws(".", own, "owner").alias("source"), F.coalesce("target", "raw").alias("target"), "type", F.col("target").isNotNull().alias("internal")).distinct()


def edges_of(edges: DataFrame, types: list[str] | None = None, internal_only: bool = False) -> DataFrame:
    """Edges of some types, and only those between classes of the program."""
    out = edges if types is None else edges.filter(F.col("type").isin(types))
    return out.filter("internal") if internal_only else out


def uml_model(members: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """(class, attributes, methods, edges, n_edges of each kind): one row a class, its edges as kind>target, resolved.

    A name is looked for in its own module, then as what the file's imports make of its head; one that nothing defines
    stands as the imports have it.
    """
    own = module_name(F.col("path"))
    classes = symbols.filter("kind = 'class'").select(F.concat_ws(".", own, F.col("name")).alias("full")).distinct()
    meaning = import_targets(imports).select(F.col("path").alias("ip"), F.col("alias").alias("ia"), F.concat_ws(".", "module", "name").alias("meant"))
    edges = members.filter("kind not in ('attribute', 'method')").select("path", "owner", "kind", F.col("name").alias("raw")).distinct()
    edges = edges.withColumns({"module": own, "head": F.substring_index("raw", ".", 1), "tail": F.regexp_replace("raw", r"^[^.]*\.?", "")})
    edges = edges.join(meaning, (F.col("path") == F.col("ip")) & (F.col("head") == F.col("ia")), "left")
    meant = F.concat_ws(".", F.coalesce("meant", "head"), F.nullif("tail", F.lit("")))
    names = F.array(F.concat_ws(".", "module", "raw"), meant)
    key = ["path", "owner", "kind", "raw"]  # one row each, after distinct
    hit = edges.select(*key, F.posexplode(names).alias("rank", "full")).join(classes, "full").groupBy(*key).agg(F.min(F.struct("rank", "full"))["full"].alias("target"))
    edges = edges.withColumn("fallback", meant).join(hit, key, "left").select("path", "owner", "kind", F.coalesce("target", "fallback").alias("target"))
    of = lambda kind: F.array_join(F.array_sort(F.collect_set(F.when(F.col("kind") == kind, F.concat_ws(": ", "name", "type")))), "; ")
    have = members.groupBy("path", "owner").agg(of("attribute").alias("attributes"), of("method").alias("methods"))
    every = symbols.filter("kind = 'class'").select("path", F.col("name").alias("owner")).distinct()
    kinds = ("inheritance", "association", "instantiation")
    tied = edges.groupBy("path", "owner").agg(F.array_join(F.array_sort(F.collect_set(F.concat_ws(">", "kind", "target"))), "; ").alias("edges"), *(F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in kinds))
    out = every.join(have, ["path", "owner"], "left").join(tied, ["path", "owner"], "left")
    return out.select(F.concat_ws(".", own, "owner").alias("class"), *(F.coalesce(c, F.lit("")).alias(c) for c in ("attributes", "methods", "edges")), *(F.coalesce(f"n_{k}", F.lit(0)).alias(f"n_{k}") for k in kinds))


def uml_stats(model: DataFrame) -> DataFrame:
    """Classes and edges of each kind in one row."""
    return model.agg(F.count("*").alias("classes"), *(F.sum(c).alias(c) for c in ("n_inheritance", "n_association", "n_instantiation")))
