"""Results, counts, summaries and reports over detected entities."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from umbra.functions import spans

SCHEMA_VERSION = "1.0"


@dataclass(frozen=True)
class Options:
    """How a run rewrites; resolved when the plan is built."""

    backend: str = "auto"
    mode: str = "replace"
    entities: tuple[str, ...] | None = None
    language: str = "en"
    threshold: float = 0.35
    mask_char: str = "*"
    hash_key: str | None = None
    output_dir: str | None = None
    dry_run: bool = False
    images: str = "keep"
    attachments: str = "keep"
    extra: dict = field(default_factory=dict)


def rewrite_text(docs: DataFrame, text_col: str = "text", options: Options | None = None, detector: Column | None = None) -> DataFrame:
    """``docs`` with ``entities`` and ``redacted_text``; one narrow projection. A
    ``detector`` column (spans of a model) is added to the recognizers' spans."""
    o = options or Options()
    text = F.coalesce(F.col(text_col), F.lit(""))
    wanted = list(o.entities) if o.entities else None
    found = spans.detect(text, wanted, o.threshold) if detector is None else spans.union_detect(text, detector, wanted, o.threshold)
    out = docs.withColumn("entities", found)
    return out.withColumn("redacted_text", spans.rewrite(text, F.col("entities"), o.mode, o.mask_char, o.hash_key))


def rewrite_columns(table: DataFrame, columns: list[str], options: Options | None = None) -> DataFrame:
    """Any typed table with the named string columns rewritten."""
    o = options or Options()
    wanted = list(o.entities) if o.entities else None
    return table.withColumns({c: spans.rewrite_text(F.col(c), o.mode, wanted, o.threshold, mask_char=o.mask_char, key=o.hash_key)["text"] for c in columns})


def entities(found: DataFrame, *keys: str) -> DataFrame:
    """One row per entity, with its number in the document."""
    return found.select(*keys, F.posexplode("entities").alias("nth", "e")).select(*keys, "nth", "e.*")


def counts_map(entities_col: str = "entities") -> Column:
    """Number per label, sorted by label."""
    labels = F.transform(entities_col, lambda e: e["entity_type"])
    return F.transform(F.array_sort(F.array_distinct(labels)), lambda x: F.struct(x.alias("entity_type"), F.size(F.filter(labels, lambda y: y == x)).cast("long").alias("n")))


def fully_redacted() -> Column:
    return F.col("success") & (F.size("unredacted") == 0)


def as_results(found: DataFrame, source: str, backend: str = "builtin", media_type: str = "text") -> DataFrame:
    """Result rows of a text run."""
    return found.select(
        F.col(source).cast("string").alias("source"), F.lit(None).cast("string").alias("output"), F.lit(backend).alias("backend"), F.lit(media_type).alias("media_type"),
        F.lit(True).alias("success"), "entities", "redacted_text", F.lit("").alias("message"), F.array().cast("array<string>").alias("unredacted"),
    )


def run_summary(results: DataFrame) -> DataFrame:
    """documents, failed, incomplete, entities, all_safe and exit_code of a run: one
    row, by partial aggregation."""
    failed, incomplete = F.count_if(~F.col("success")), F.count_if(F.col("success") & ~fully_redacted())
    safe = (failed == 0) & (incomplete == 0)
    return results.agg(
        F.count("*").alias("documents"), failed.alias("failed"), incomplete.alias("incomplete"),
        F.coalesce(F.sum(F.size("entities").cast("long")), F.lit(0)).alias("entities"), safe.alias("all_safe"), F.when(safe, 0).otherwise(1).alias("exit_code"),
    )


def report_rows(results: DataFrame, include_values: bool = False) -> DataFrame:
    """One JSON document per result; values are withheld unless asked for. Rows go to a
    JSON sink in parallel; nothing is gathered."""
    def one(e):
        fields = [e["entity_type"].alias("type"), F.round(e["score"], 4).alias("score"), e["start"].alias("start"), e["end"].alias("end"), F.lit(None).cast("array<int>").alias("bbox")]
        return F.struct(*fields, *([e["text"].alias("text")] if include_values else []))

    payload = F.struct(
        "source", "output", "backend", "media_type", "success", fully_redacted().alias("fully_redacted"), F.size("entities").alias("entity_count"),
        F.map_from_entries(F.transform(counts_map(), lambda c: F.struct(c["entity_type"], c["n"]))).alias("entity_counts"), F.transform("entities", one).alias("entities"), "unredacted", "message",
    )
    return results.select("source", F.to_json(payload, {"ignoreNullFields": "false"}).alias("document"))


def run_report(results: DataFrame, include_values: bool = False, version: str = "0.1") -> DataFrame:
    """The head of a report: one row with the summary as JSON. ``documents`` are the
    rows of ``report_rows``."""
    head = [F.lit("umbra.run").alias("schema"), F.lit(SCHEMA_VERSION).alias("schema_version"), F.lit(version).alias("tool_version"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("generated_at"), F.lit(include_values).alias("contains_pii_values")]
    return run_summary(results).select(F.to_json(F.struct(*head, F.struct("documents", "failed", "incomplete", "entities", "all_safe", "exit_code").alias("summary"))).alias("report"))


def summary_line() -> Column:
    """One line of a result for a reader: state, source, what was found, output, notes."""
    counts = F.array_join(F.transform(counts_map(), lambda c: F.concat(c["entity_type"], F.lit(" x"), c["n"].cast("string"))), ", ")
    state = F.when(~F.col("success"), "FAIL").when(F.size("unredacted") > 0, "PART").otherwise("ok  ")
    more = lambda c, before: F.when(F.coalesce(F.length(c), F.lit(0)) > 0, F.concat(F.lit(before), c)).otherwise("")
    return F.concat(state, F.lit(" "), "source", F.lit(": "), F.size("entities").cast("string"), F.lit(" entities"), F.when(F.size("entities") > 0, F.concat(F.lit(" ("), counts, F.lit(")"))).otherwise(""), more(F.col("output"), " -> "), more(F.col("message"), " | "))


def describe(entity: Column) -> Column:
    """One line for a reader, without the value."""
    place = F.when(entity["start"].isNotNull(), F.format_string("[%d:%d]", entity["start"], entity["end"])).otherwise("")
    return F.concat(entity["entity_type"], place, F.format_string(" (%.2f)", entity["score"]))
