"""Call sites of JavaScript, TypeScript, C and C++ and their definitions, in the same file or, through `modules`, in others."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartolith.sources import syntax

#: Functions of the script languages and of C and C++ that no project defines, and names that hold such.
SCRIPT_BUILTINS = frozenset(
    """
    log warn error info debug trace dir table time timeEnd group groupEnd clear count assert push pop shift unshift splice slice concat map filter reduce
    reduceRight forEach find findIndex some every includes indexOf lastIndexOf join reverse sort flat flatMap fill copyWithin entries keys values assign
    freeze seal create defineProperty defineProperties getOwnPropertyDescriptor getOwnPropertyNames getOwnPropertySymbols getPrototypeOf setPrototypeOf
    hasOwnProperty isPrototypeOf propertyIsEnumerable charAt charCodeAt codePointAt endsWith startsWith localeCompare match matchAll normalize padEnd
    padStart repeat replace replaceAll search split substring toLowerCase toUpperCase trim trimStart trimEnd valueOf toString abs ceil floor round max min
    pow sqrt random sin cos tan exp parse stringify then catch finally all allSettled any race resolve reject setTimeout setInterval clearTimeout
    clearInterval requestAnimationFrame cancelAnimationFrame fetch alert confirm prompt isArray isNaN isFinite parseInt parseFloat getElementById
    getElementsByClassName getElementsByTagName querySelector querySelectorAll createElement appendChild removeChild addEventListener removeEventListener
    getAttribute setAttribute removeAttribute useState useEffect useContext useReducer useCallback useMemo useRef useImperativeHandle useLayoutEffect
    useDebugValue useTransition useDeferredValue useId
    """.split()
)
SCRIPT_NAMESPACES = frozenset(
    """
    console Math JSON Object Array String Number Boolean Date RegExp Error Promise Map Set WeakMap WeakSet Symbol Reflect Proxy Intl document window
    navigator localStorage sessionStorage React ReactDOM Vue Angular jQuery $ axios lodash _ moment dayjs fs path os http https crypto util events
    """.split()
)
NATIVE_LIBRARY = frozenset(
    """
    cout cin cerr clog endl printf scanf puts gets fprintf fscanf sprintf sscanf fopen fclose fread fwrite malloc calloc realloc free new delete strlen
    strcpy strncpy strcat strcmp strncmp memcpy memset abs sqrt pow sin cos tan log exp floor ceil push_back pop_back push_front pop_front begin end size
    empty clear insert erase find front back at reserve resize capacity data sort count copy transform accumulate swap move forward make_pair make_tuple
    get make_unique make_shared static_cast dynamic_cast const_cast reinterpret_cast
    """.split()
)
NATIVE_NAMESPACES = frozenset(
    """
    std boost fmt spdlog nlohmann google absl
    """.split()
)

CALL_SCHEMA = "path string, caller string, owner string, callee string, receiver string, call_type string, line int"
#: What tells call sites apart as far as their resolution goes.
SITE = ["path", "owner", "callee", "receiver", "call_type"]


def _calls(nodes: Iterator[dict]) -> Iterator[dict]:
    rows = list(nodes)
    for row in rows:
        if row["kind"] == "call" and row["function"] is not None:
            caller = rows[row["function"]]["name"]
            yield {"path": row["path"], "caller": caller, "owner": row["owner"], "callee": row["name"], "receiver": row["receiver"], "call_type": row["how"], "line": row["line"]}


def script_calls(path: str, text: str) -> Iterator[dict]:
    """Call sites in functions and methods of JavaScript or TypeScript."""
    yield from _calls(syntax.script_nodes(path, text))


def native_calls(path: str, text: str) -> Iterator[dict]:
    """Call sites in functions and methods of C or C++."""
    yield from _calls(syntax.native_nodes(path, text))


def symbols_of(nodes: DataFrame) -> DataFrame:
    """Symbols from a table of syntax nodes."""
    parent = F.when(F.col("kind") == "method", F.col("owner"))
    return nodes.filter("kind in ('class', 'function', 'method')").select("path", "name", "kind", F.col("line").alias("lineno"), parent.alias("parent"), "complexity")


def calls_of(nodes: DataFrame) -> DataFrame:
    """Call sites from a table of syntax nodes, each with the function it stands in."""
    if "caller" in nodes.columns:
        return nodes.filter("kind = 'call' and function is not null").select("path", "caller", "owner", F.col("name").alias("callee"), "receiver", F.col("how").alias("call_type"), "line")
    callers = nodes.filter("kind in ('function', 'method')").select("path", F.col("id").alias("function"), F.col("name").alias("caller"))
    sites = nodes.filter("kind = 'call'").select("path", "function", "owner", F.col("name").alias("callee"), "receiver", F.col("how").alias("call_type"), "line")
    return sites.join(callers, ["path", "function"]).select("path", "caller", "owner", "callee", "receiver", "call_type", "line")


#: Of syntax nodes what names across files need.
LINKED_SCHEMA = "path string, parent int, function int, kind string, name string, owner string, receiver string, how string, source string, alias string, exported boolean, line int, complexity int, caller string"


def linked_nodes(nodes: Callable[[str, str], Iterator[dict]]) -> Callable[[str, str], Iterator[dict]]:
    """Syntax nodes without decisions, calls with the name of the function they stand in (`caller`)."""

    def run(path: str, text: str) -> Iterator[dict]:
        rows = list(nodes(path, text))
        for row in rows:
            if row["kind"] != "decision":
                yield row | {"caller": rows[row["function"]]["name"] if row["kind"] == "call" and row["function"] is not None else None}

    return run


def definitions(symbols: DataFrame, joint: str) -> DataFrame:
    """(path, key) of functions and methods, a method under its class."""
    key = F.when(F.col("parent").isNull(), F.col("name")).otherwise(F.concat_ws(joint, "parent", "name"))
    return symbols.filter("kind in ('function', 'method')").select("path", key.alias("key")).distinct()


def _resolved(calls: DataFrame, defined: DataFrame, ignored: list[tuple], keys: Column, elsewhere: Callable[[DataFrame], DataFrame] | None) -> DataFrame:
    """Calls with the first of their keys that the file defines, or that `elsewhere` finds in another file.

    ignored: (condition, status), tried in order. elsewhere: (path, key) to (path, key, target_path, target). Equal sites
    share one lookup, and the result is joined back by what tells sites apart.
    """
    status = F.lit(None).cast("string")
    for condition, name in reversed(ignored):
        status = F.when(condition, name).otherwise(status)
    c = calls.withColumn("ignored", status)
    ranked = c.filter("ignored is null").select(*SITE).distinct().select(*SITE, F.posexplode(keys).alias("rank", "key")).filter("key is not null")
    hits = ranked.join(defined, ["path", "key"]).select(*SITE, F.struct("rank", F.lit(0).alias("far"), F.col("path").alias("target_path"), F.col("key").alias("target")).alias("hit"))
    if elsewhere is not None:
        wanted = ranked.select("path", "key").distinct().join(defined, ["path", "key"], "left_anti")
        far = ranked.join(elsewhere(wanted), ["path", "key"])
        hits = hits.unionByName(far.select(*SITE, F.struct("rank", F.lit(1).alias("far"), "target_path", "target").alias("hit")))
    best = hits.groupBy(*SITE).agg(F.min("hit").alias("hit")).withColumnsRenamed({name: f"__{name}" for name in SITE})
    same = functools.reduce(lambda a, b: a & b, (F.col(name).eqNullSafe(F.col(f"__{name}")) for name in SITE))
    out = c.join(best, same, "left")
    found = F.when(F.col("hit").isNotNull(), "resolved_project")
    return out.select(*calls.columns, F.col("hit.target").alias("target"), F.col("hit.target_path").alias("target_path"), F.coalesce("ignored", found, F.lit("unresolved")).alias("status"))


def resolve_script(calls: DataFrame, symbols: DataFrame, elsewhere: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Builtin names and library objects go; this.x is the own class's, new X its constructor, r.x a method of r or a function x."""
    r, name, kind = F.col("receiver"), F.col("callee"), F.col("call_type")
    own = (r == "this") & F.col("owner").isNotNull()
    ignored = [(name.isin(sorted(SCRIPT_BUILTINS)), "ignored_builtin"), (r.isin(sorted(SCRIPT_NAMESPACES)), "ignored_stdlib")]
    keys = F.array(
        F.when(own, F.concat_ws(".", "owner", "callee")), F.when(~F.coalesce(own, F.lit(False)) & (kind == "method"), F.concat_ws(".", "receiver", "callee")),
        F.when((kind == "direct") | ~F.coalesce(own, F.lit(False)) & (kind == "method"), name), F.when(kind == "constructor", F.concat(name, F.lit(".constructor"))),
    )
    return _resolved(calls, definitions(symbols, "."), ignored, keys, elsewhere)


def resolve_native(calls: DataFrame, symbols: DataFrame, elsewhere: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Library functions and namespaces go; this->x is the own class's, R::x that of R or a third party's; other methods stay open."""
    r, name, kind = F.col("receiver"), F.col("callee"), F.col("call_type")
    ignored = [(name.isin(sorted(NATIVE_LIBRARY)), "ignored_stdlib"), (r.isin(sorted(NATIVE_NAMESPACES)), "ignored_stdlib")]
    own = (r == "this") & F.col("owner").isNotNull()
    keys = F.array(F.when(own, F.concat_ws("::", "owner", "callee")), F.when((kind == "static") & r.isNotNull(), F.concat_ws("::", "receiver", "callee")), F.when(kind == "direct", name))
    out = _resolved(calls, definitions(symbols, "::"), ignored, keys, elsewhere)
    return out.withColumn("status", F.when((F.col("status") == "unresolved") & (kind == "static"), "ignored_third_party").otherwise(F.col("status")))
