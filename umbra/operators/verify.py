"""Independent verification of finished output: layers, findings, controls, status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from umbra.functions import spans
from umbra.functions.arrays import let


LAYER = "array<struct<layer:string,text:string>>"


def layer_array(text: Column) -> Column:
    """Layers of a text: decoded base64 first, the raw text last, so that a finding is
    put down to the most telling layer."""
    decoded = F.transform(spans.base64_layers(text), lambda r: F.struct(F.format_string("base64[%d]", r["nth"]).alias("layer"), r["text"].alias("text")))
    raw = F.array(F.struct(F.lit("raw").alias("layer"), text.alias("text")))
    return F.concat(F.coalesce(decoded, F.array().cast(LAYER)), raw)


def text_layers(artifacts: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """The layers of text artifacts, one row each."""
    return artifacts.select(F.col(path).alias("path"), F.posexplode(layer_array(F.col(text))).alias("layer_ord", "l")).select("path", "layer_ord", "l.layer", "l.text")


def scanned(layers: Column, entities: list[str] | None = None, threshold: float = 0.35) -> Column:
    """All entities of an array of layers but file plumbing, each with its layer, in
    order of the layers."""
    def one(layer):
        found = F.filter(spans.detect(layer["text"], entities, threshold), lambda e: ~spans.is_structural(e))
        return F.transform(found, lambda e: F.struct(layer["layer"].alias("layer"), e["entity_type"].alias("entity_type"), e["start"].alias("start"), e["end"].alias("end"), e["score"].alias("score"), e["text"].alias("text")))

    return F.flatten(F.transform(F.filter(layers, lambda x: F.length(x["text"]) > 0), one))


def distinct_findings(found: Column) -> Column:
    """Each (type, value) once, in the first layer that has it."""
    def once(xs):
        keyed = F.transform(xs, lambda e, i: F.struct(e["entity_type"].alias("entity_type"), e["text"].alias("text"), i.alias("nth")))
        # sorted by value each group of equals is a run, which starts with its first
        runs = lambda ordered: F.filter(ordered, lambda k, i: (i == 0) | (F.get(ordered, i - 1)["entity_type"] != k["entity_type"]) | (F.get(ordered, i - 1)["text"] != k["text"]))
        firsts = let(F.array_sort(keyed), runs)
        return F.transform(F.array_sort(F.transform(firsts, lambda k: k["nth"])), lambda n: F.get(xs, n))

    return let(found, once)


def hits(layers: DataFrame, entities: list[str] | None = None, threshold: float = 0.35) -> DataFrame:
    """Entities of all layers but file plumbing, repeats included."""
    found = layers.where(F.length("text") > 0).select("path", "layer_ord", "layer", F.explode(spans.detect(F.col("text"), entities, threshold)).alias("e"))
    return found.where(~spans.is_structural(F.col("e"))).select("path", "layer_ord", "layer", "e.*")


def findings(found: DataFrame) -> DataFrame:
    """Each (type, value) of an artifact once, in the first layer that has it."""
    first = F.min(F.struct("layer_ord", "start", "layer", "end", "score"))
    return found.groupBy("path", "entity_type", "text").agg(first.alias("f")).select("path", "f.layer_ord", "f.layer", "entity_type", "f.start", "f.end", "f.score", "text")


def pair_name(name: Column) -> Column:
    """The original's name: the first ``.redacted`` goes."""
    at = F.instr(name, ".redacted")
    return F.when(at > 0, F.concat(F.substring(name, F.lit(1), at - 1), F.substring(name, at + 9, F.length(name)))).otherwise(name)


def status(control: Column, n: Column) -> Column:
    """A control in which nothing is found proves nothing, whatever was found."""
    return F.when(control == 0, "INCONCLUSIVE").when(n == 0, "clean").otherwise("LEAKING")


def examined(artifacts: DataFrame, entities: list[str] | None, threshold: float, layers=None) -> DataFrame:
    """path, layers_scanned, blind and found (all entities of all layers), a row per
    artifact. Texts are worked on where they are; ``layers`` makes rows of other kinds,
    which are put together again by path."""
    if layers is None:
        rows = artifacts.select("path", layer_array(F.col("text")).alias("layers"))
        return rows.select("path", F.size("layers").cast("long").alias("layers_scanned"), F.lit(False).alias("blind"), scanned(F.col("layers"), entities, threshold).alias("found"))
    each = layers(artifacts).withColumn("found", scanned(F.array(F.struct("layer", "text")), entities, threshold))
    parts = F.array_sort(F.collect_list(F.struct("layer_ord", "found")))
    out = each.groupBy("path").agg(F.count("*").alias("layers_scanned"), F.max(F.col("layer").rlike("<no (?:engine|ocr)>")).alias("blind"), parts.alias("parts"))
    return out.select("path", "layers_scanned", "blind", F.flatten(F.transform("parts", lambda p: p["found"])).alias("found"))


def verify(artifacts: DataFrame, originals: DataFrame | None = None, entities: list[str] | None = None, threshold: float = 0.35, layers=None) -> DataFrame:
    """One row per artifact ``(path, text)``: layers_scanned, finding_count, findings,
    control_entities (null without an original), clean, inconclusive, status, note.

    Layers that say that text could not be examined (``<no ...>``) count as a control
    that found nothing. Texts need no shuffle but that of the join with their originals,
    by name, in which only counts and findings move.
    """
    out = examined(artifacts, entities, threshold, layers)
    out = out.select("path", "layers_scanned", "blind", distinct_findings(F.col("found")).alias("findings"))
    out = out.withColumn("finding_count", F.size("findings").cast("long"))
    if originals is None:
        out = out.withColumn("control_entities", F.lit(None).cast("long"))
    else:
        name = F.element_at(F.split("path", "/"), -1)
        control = examined(originals, entities, threshold, layers).select(name.alias("origin"), F.size("found").cast("long").alias("control_entities"))
        control = control.groupBy("origin").agg(F.max("control_entities").alias("control_entities"))
        out = out.withColumn("origin", pair_name(name)).join(control, "origin", "left").drop("origin")
    control = F.when(F.col("blind"), F.lit(0)).otherwise(F.col("control_entities"))
    out = out.withColumn("control_entities", control.cast("long"))
    clean, blind = F.col("finding_count") == 0, F.coalesce(F.col("control_entities") == 0, F.lit(False))
    note = F.when(F.col("blind"), "part of this file could not be examined here").when(blind, "the same scan finds nothing in the original, so it proves nothing").otherwise("")
    return out.select("path", "layers_scanned", "finding_count", "findings", "control_entities", clean.alias("clean"), blind.alias("inconclusive"), status(F.col("control_entities"), F.col("finding_count")).alias("status"), note.alias("note"))


def report_rows(reports: DataFrame, include_values: bool = False) -> DataFrame:
    """One JSON document per artifact; the values themselves only where asked for."""
    one = lambda e: F.struct(e["entity_type"].alias("type"), e["layer"].alias("layer"), *([e["text"].alias("text")] if include_values else []))
    kind = F.col("media_type") if "media_type" in reports.columns else F.lit(None).cast("string").alias("media_type")
    payload = F.struct("path", kind, "status", "clean", "inconclusive", "layers_scanned", "finding_count", F.transform("findings", one).alias("findings"), "control_entities", "note")
    return reports.select(F.col("path").alias("source"), F.to_json(payload, {"ignoreNullFields": "false"}).alias("document"))


def verify_summary(reports: DataFrame) -> DataFrame:
    """artifacts, leaking, inconclusive, all_verified_clean and exit_code: one row."""
    leaking, inconclusive = F.count_if(~F.col("clean")), F.count_if(F.col("clean") & F.col("inconclusive"))
    good = (leaking == 0) & (inconclusive == 0)
    return reports.agg(F.count("*").alias("artifacts"), leaking.alias("leaking"), inconclusive.alias("inconclusive"), good.alias("all_verified_clean"), F.when(good, 0).otherwise(1).alias("exit_code"))


def video_status(records: DataFrame) -> DataFrame:
    """Verification of rendered videos from ``(output, exists, size_bytes,
    expected_frames, frames_decoded, decode_error, unresolved_gaps)``: errors fail,
    gaps only warn. Counts that are missing or no sense, and gaps without their frames,
    are warnings too: a record that can't be read is no proof of a fault."""
    errors = F.array_compact(
        F.array(
            F.when(~F.col("exists"), "output file does not exist").when(F.col("size_bytes") <= 0, "output file is empty"),
            F.when(F.col("decode_error").isNotNull(), F.concat(F.lit("decode failed: "), "decode_error")).when(F.col("frames_decoded") <= 0, "decoded zero frames"),
            F.when((F.col("expected_frames") >= 0) & (F.col("frames_decoded") != F.col("expected_frames")), F.format_string("frame count mismatch: decoded %d, expected %d", "frames_decoded", "expected_frames")),
        )
    )
    whole = lambda g: g["label"].isNotNull() & g["first_frame"].isNotNull() & g["last_frame"].isNotNull()
    odd = F.array_compact(
        F.array(
            F.when(F.col("expected_frames").isNull() | (F.col("expected_frames") < 0), "expected frame count is not known"),
            F.when(F.col("frames_decoded").isNull() & F.col("decode_error").isNull() & F.col("exists"), "decoded frame count is missing"),
            F.when(F.exists("unresolved_gaps", lambda g: ~whole(g)), "malformed gap record"),
        )
    )
    warn = F.transform(F.filter("unresolved_gaps", whole), lambda g: F.format_string("possible masked->exposed->masked sequence: %s unmasked frames %d-%d", g["label"], g["first_frame"], g["last_frame"]))
    out = records.withColumns({"errors": errors, "warnings": F.concat(odd, F.coalesce(warn, F.array().cast("array<string>")))})
    kind = F.when(F.size("errors") > 0, "failed").when(F.size("warnings") > 0, "passed_with_warnings").otherwise("passed")
    return out.withColumns({"verification_status": kind, "passed": F.size("errors") == 0, "gap_reporting": F.col("unresolved_gaps").isNotNull()})
