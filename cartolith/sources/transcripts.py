"""Terminal and agent transcripts: lines to events, JSON lines to events, noise and repeats removed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartolith.functions.text import strip_ansi

#: Families of terminal lines in the order they are tried, each with its events and patterns.
FAMILIES = (
    ("command", "install_start", r"^(npm|yarn|pnpm)\s+(install|i|add|remove|uninstall)"),
    ("command", "install_start", r"^(pip|pip3|pipenv|poetry)\s+(install|uninstall)"),
    ("command", "test_start", r"^(pytest|python -m pytest|py\.test)"),
    ("command", "test_start", r"^(npm|yarn|pnpm)\s+(test|run test)"),
    ("command", "git_status", r"^git\s+status"),
    ("command", "git_diff", r"^git\s+diff"),
    ("command", "command_start", r"^git\s+(add|commit|push|pull)"),
    ("command", "file_read", r"^(cat|head|tail|less|more)\s+"),
    ("command", "file_write", r"^(echo|printf).+>\s*\S+"),
    ("command", "file_delete", r"^rm\s+(-[rf]+\s+)?"),
    ("command", "build_start", r"^(make|cmake|cargo build|go build)"),
    ("test", "test_summary", r"^=+\s*(\d+)\s+passed.*in\s+([\d.]+)s"),
    ("test", "test_result", r"^FAILED\s+(\S+)::(\S+)"),
    ("test", "test_result", r"✓\s+(.+)\s+\((\d+)ms\)"),
    ("test", "test_result", r"✕\s+(.+)\s+\((\d+)ms\)"),
    ("test", "test_summary", r"Tests:\s+(\d+)\s+passed,\s+(\d+)\s+total"),
    ("agent", "agent_thinking", r"(?i)^(Thinking|Planning|Analyzing|Considering)[:.]"),
    ("agent", "agent_planning", r"(?i)^(I will|I'll|Let me|Going to|Need to)"),
    ("agent", "agent_decision", r"(?i)^(Decided to|Choosing|Selected|Using)"),
    ("agent", "agent_error", r"(?i)^(Error|Failed|Cannot|Unable to)"),
    ("error", "error", r"^(ERROR|ERRO|ERR)[:|\s]"),
    ("error", "warning", r"^(WARNING|WARN)[:|\s]"),
    ("error", "info", r"^(INFO|DEBU|DEBUG)[:|\s]"),
    ("error", "error", r"Traceback \(most recent call last\)"),
    ("error", "error", r"SyntaxError:|TypeError:|ValueError:|AttributeError:"),
    ("prompt", "prompt", r"\[Y/n\]"),
    ("prompt", "prompt", r"\(y/N\)"),
    ("prompt", "prompt", r"Continue\?"),
    ("prompt", "prompt", r"Enter (.+):"),
    ("prompt", "prompt", r"Choose \[(\d+-\d+)\]"),
)
#: Lines of nothing but these characters are noise.
NOISE = r"^[\s\-=_*─│╭╮╰╯┌┐└┘├┤┬┴┼═║░▒▓█•·…⠀-⣿✻✽✶✢✳]*$"
#: Phases that events begin.
PHASES = {"agent_thinking": "thinking", "agent_planning": "planning", "agent_decision": "deciding", "command_start": "executing", "test_start": "testing", "build_start": "building", "install_start": "installing"}


def classify(line: Column) -> Column:
    """Struct of family, type and text of a terminal line, the first pattern that matches counting; noise gives null."""
    clean = F.trim(strip_ansi(line))
    out = F.struct(F.lit("output").alias("family"), F.lit("output").alias("type"), clean.alias("text"))
    for family, kind, pattern in reversed(FAMILIES):
        out = F.when(clean.rlike(pattern), F.struct(F.lit(family).alias("family"), F.lit(kind).alias("type"), clean.alias("text"))).otherwise(out)
    return F.when(~clean.rlike(NOISE), out)


def events(chunks: DataFrame, key: list[str], text: str) -> DataFrame:
    """One row per line that is not noise: line number, family, type and text."""
    lines = chunks.select(*key, F.posexplode(F.split(text, "\r?\n")).alias("line_number", "line"))
    return lines.select(*key, (F.col("line_number") + 1).alias("line_number"), classify(F.col("line")).alias("e")).filter("e is not null").select(*key, "line_number", "e.*")


def phase_of(kind: Column) -> Column:
    out = F.lit(None).cast("string")
    for k, phase in PHASES.items():
        out = F.when(kind == k, phase).otherwise(out)
    return out


def test_counts(text: Column) -> Column:
    """Struct of passed, failed, skipped and total of a summary; a total that is not given is their sum."""
    n = lambda word: F.coalesce(F.regexp_extract(text, rf"(\d+) {word}", 1).try_cast("int"), F.lit(0))
    passed, failed, skipped = n("passed"), n("failed"), n("skipped")
    return F.struct(passed.alias("passed"), failed.alias("failed"), skipped.alias("skipped"), (passed + failed + skipped).alias("total"))


_AGENT = "struct<type:string,subtype:string,session_id:string,result:string,is_error:boolean,message:struct<content:array<struct<type:string,text:string,name:string,tool_use_id:string>>>>"


def agent_events(lines: DataFrame, key: list[str], text: str) -> DataFrame:
    """Events of JSON lines: system, assistant, user and result messages; the first content block counts, bad lines are errors."""
    row = lines.select(*key, F.trim(text).alias("raw")).filter("raw <> ''").withColumn("j", F.from_json("raw", _AGENT))
    block = F.try_element_at(F.col("j.message.content"), F.lit(1))
    kind = (
        F.when(F.try_parse_json("raw").isNull(), "parse_error").when(F.col("j.type") == "system", F.concat_ws("_", F.lit("system"), F.col("j.subtype")))
        .when((F.col("j.type") == "assistant") & (block["type"] == "tool_use"), "tool_use").when(F.col("j.type") == "assistant", "assistant_text")
        .when((F.col("j.type") == "user") & (block["type"] == "tool_result"), "tool_result").when(F.col("j.type") == "user", "user_text")
        .when((F.col("j.type") == "result") & F.col("j.is_error"), "error").when(F.col("j.type") == "result", "completion").otherwise("unknown")
    )
    content = F.coalesce(block["text"], block["name"], block["tool_use_id"], F.col("j.result"), F.lit(""))
    return row.select(*key, kind.alias("type"), F.col("j.session_id").alias("session_id"), content.alias("content"))
