"""A corpus pipeline over `documents`: toxicity, exact dedup, near dedup, source mixing, packing.

Each stage works on all rows that its predecessor kept, and its result is written and read again, so a lost executor
costs one stage. A table is deleted once the next one is written.

Defined cases: a null text counts as empty and is never rejected as toxic on its own; all empty texts are one group, of
which one row stays; wordless texts are near nothing, and the mix keeps them once; rows with a null id are kept by near
dedup; negative, repeated and extreme ids are ids like others; extra columns pass through all stages but packing; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cartolith.llm import exact_dedup, mixing, near_dedup, packing, toxicity
from cartolith.llm.common import Scratch, table
from cartolith.llm.queries import tokenizer_file


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity models reject go; they are trained on `labels`."""
    return toxicity.clean(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of identical texts stays, that with the largest id."""
    return exact_dedup.survivors(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component stays."""
    return near_dedup.survivors(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents appear as often as the mix takes their words, up to three times, or not at all."""
    return mixing.remix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece of each document row, with its place in a sequence."""
    return packing.pack(docs, tokenizer_file())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", clean),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("source_mix", mixed),
    ("packing", packed),
]

#: SQL can't express a trained classifier, so the tests hold run() against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written as Parquet and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, scratch.write(stage(spark, docs, sf_dir), name)
        scratch.drop(before)  # tables of the input stay
    return docs
