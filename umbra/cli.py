"""``python -m umbra.cli list|detect|run|verify|search``; exit codes 0, 1 and 2."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from umbra.functions import spans
from umbra.operators import backends, results, routing, semantic, verify
from umbra.sources import containers, ingest

CONTAINERS = ("docx", "xlsx", "pptx", "email")
CARRIED = ("output", "backend")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="umbra")
    sub = top.add_subparsers(dest="command", required=True)
    sub.add_parser("list", help="backends, and what those that can't be used lack")
    d = sub.add_parser("detect", help="the media type of each file")
    r = sub.add_parser("run", help="rewrite files")
    v = sub.add_parser("verify", help="search finished output for what is still there")
    s = sub.add_parser("search", help="rank pictures and videos by a phrase")
    s.add_argument("query")
    for p in (d, r, v, s):
        p.add_argument("inputs", nargs="+", help="files, folders or globs")
        p.add_argument("--no-recursive", action="store_true")
    for p in (d, r):
        p.add_argument("--include-unknown", action="store_true")
    for p in (r, v):
        p.add_argument("-e", "--entities", action="append", metavar="LABEL[,LABEL]")
        p.add_argument("--threshold", type=float, default=0.35)
        p.add_argument("--json", metavar="PATH", help="a report as JSON; - for standard output")
        p.add_argument("--json-include-values", action="store_true", help="with the values themselves")
    r.add_argument("-b", "--backend", default="auto")
    r.add_argument("-m", "--mode", default="replace", choices=spans.MODES)
    r.add_argument("-o", "--out", metavar="DIR", help="a folder that all executors mount")
    r.add_argument("--lang", default="en")
    r.add_argument("--hash-key")
    r.add_argument("--mask-char", default="*")
    r.add_argument("--yolo-model", metavar="CKPT")
    r.add_argument("--yolo-classes", metavar="A,B")
    r.add_argument("--docx-images", default="keep", choices=("keep", "strip", "blur"))
    r.add_argument("--eml-attachments", default="keep", choices=("keep", "strip"))
    r.add_argument("--dry-run", action="store_true")
    r.add_argument("--match", metavar="PHRASE", help="of pictures and videos only those that fit; all others are rewritten")
    r.add_argument("--match-threshold", type=float, default=0.05)
    v.add_argument("--original", metavar="DIR", help="the sources; a search that finds nothing in them proves nothing")
    s.add_argument("--top", type=int, default=10)
    s.add_argument("--threshold", type=float, default=0.0)
    s.add_argument("--raw-scores", action="store_true")
    s.add_argument("--index", metavar="FOLDER", help="read an index here, or write one")
    s.add_argument("--frames", type=int, default=8, help="frames sampled from a video")
    s.add_argument("--all-frames", action="store_true")
    return top


def labels(raw: list[str] | None) -> list[str] | None:
    """Names from repeated and comma-separated flags, upper-cased."""
    found = [x.strip().upper() for part in raw or [] for x in part.replace(";", ",").split(",") if x.strip()]
    return found or None


def run_files(spark: SparkSession, docs: DataFrame, options: results.Options, registry: backends.Registry | None = None) -> DataFrame:
    """Result rows, with ``content`` (the rewritten bytes) and ``sidecar``, of documents
    of any kind. Texts take the native projection; packages, mail and what other
    backends take run in Python workers, which carry a row's output and backend along."""
    registry = registry or backends.Registry.with_defaults()
    routed = routing.route(docs, registry.dimension(spark), options.backend)
    routed = routed.withColumn("output", ingest.output_path(F.col("path"), F.col("root"), options.output_dir))
    native = (F.col("backend") == "builtin") & F.col("media_type").isin("text", "structured")
    text = routed.where(native).withColumn("body", ingest.decode(F.col("content")))
    text = results.rewrite_text(text.drop("content"), "body", options)
    none = F.array().cast(f"array<{spans.ENTITY}>")
    nothing = {"redacted_text": "string", "content": "binary", "sidecar": "string"}
    plain = text.select(*CARRIED, "path", "media_type", F.lit(True).alias("success"), "entities", "redacted_text", F.array().cast("array<string>").alias("unredacted"), F.lit("dry run: " if options.dry_run else "").alias("message"), F.col("redacted_text").cast("binary").alias("content"), F.lit(None).cast("string").alias("sidecar"))
    settings = containers.Settings(options.mode, options.entities, options.threshold, options.mask_char, options.hash_key, options.images, options.attachments, language=options.language, extra=options.extra)
    if options.images == "blur":
        settings.image_rewriter = registry.image_rewriter(settings)
    boxed = routed.where((F.col("backend") == "builtin") & F.col("media_type").isin(*CONTAINERS))
    out = plain.unionByName(containers.rewrite_containers(boxed, settings, options.dry_run, CARRIED))
    failed = routed.where("error is not null").select(*CARRIED, "path", "media_type", F.lit(False).alias("success"), none.alias("entities"), F.array().cast("array<string>").alias("unredacted"), F.col("error").alias("message"), *[F.lit(None).cast(t).alias(c) for c, t in nothing.items()])
    out = out.unionByName(failed)
    for b in registry.available():
        if b.name != "builtin":
            out = out.unionByName(backends.run_backend(routed.where(F.col("backend") == b.name), b, settings, options.dry_run, CARRIED))
    return out.withColumnRenamed("path", "source")


def store(rows: DataFrame) -> DataFrame:
    """``rows`` without their bytes, which the tasks write: outputs and sidecars, each in
    one step. A file that can't be written makes its row a failure."""
    schema = rows.drop("content", "sidecar").schema
    at = schema.names

    def run(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                content, sidecar = row.pop("content"), row.pop("sidecar")
                try:
                    if row["success"] and content is not None:
                        put(row["output"], bytes(content))
                        if sidecar is not None:
                            put(f"{row['output']}.verification.json", sidecar.encode())
                except OSError as e:
                    row |= {"success": False, "message": f"{type(e).__name__}: {e}"}
                out.append([row[c] for c in at])
            yield pd.DataFrame(out, columns=at)

    return rows.mapInPandas(run, schema)


def put(path: str, data: bytes) -> None:
    folder = os.path.dirname(path) or "."
    os.makedirs(folder, exist_ok=True)
    part = f"{path}.{os.getpid()}.part"
    with open(part, "wb") as f:
        f.write(data)
    os.replace(part, path)


def emit(head: dict, key: str, rows: DataFrame, dest: str | None, values: bool) -> None:
    """A report as one JSON object, written row by row: the driver holds one document at
    a time. A failure to write it never changes an exit code."""
    if not dest:
        return
    try:
        if dest == "-":
            _emit(head, key, rows, sys.stdout)
            return
        os.makedirs(os.path.dirname(dest) or ".", exist_ok=True)
        with open(dest, "w", encoding="utf-8") as f:
            _emit(head, key, rows, f)
        if values:
            print(f"WARNING: {dest} holds the detected values themselves; it is as sensitive as the sources", file=sys.stderr)
    except OSError as e:
        print(f"the report was not written: {e}", file=sys.stderr)


def _emit(head: dict, key: str, rows: DataFrame, f) -> None:
    f.write(json.dumps(head, indent=2)[:-2] + f',\n  "{key}": [')
    for n, r in enumerate(rows.orderBy("source").toLocalIterator()):
        f.write(("," if n else "") + "\n    " + json.dumps(json.loads(r["document"])))
    f.write("\n  ]\n}\n")


def _search(spark, args, embedder, say) -> int:
    try:
        index = None
        if args.index:
            try:
                index = semantic.load_index(spark, args.index)
                index.isEmpty()
            except semantic.SemanticError:
                index = None
        if index is None:
            for x in ingest.unmatched(args.inputs):
                say(f"nothing matches {x}")
            _ready(embedder)
            index = semantic.build_index(ingest.documents(spark, args.inputs, not args.no_recursive), embedder, frames=args.frames)
            if args.index:
                semantic.save_index(index, args.index)
                index = semantic.load_index(spark, args.index)
        index = index.persist()
        held = semantic.index_summary(index).first()
        if not held["frames"]:
            say("no pictures or videos to search")
            return 1
        _ready(embedder)
        hits = semantic.search_phrase(index, args.query, embedder, args.top, args.threshold, not args.all_frames, not args.raw_scores)
        lines = [r["line"] for r in hits.select(semantic.describe().alias("line")).collect()]  # --top rows
    except semantic.SemanticError as e:
        say(f"search can't run: {e}")
        return 2
    if not lines:
        say("nothing scores over the threshold")
        return 1
    say(f"{len(lines)} match(es) for {args.query!r} in {held['frames']} frame(s) of {held['files']} file(s)")
    for x in lines:
        say(f"  {x}")
    return 0


def _ready(embedder) -> None:
    lacks = embedder.missing() if hasattr(embedder, "missing") else []
    if lacks:
        raise semantic.SemanticError(f"missing {', '.join(lacks)}")


def _run(spark, args, docs, registry, embedder, say) -> int:
    wanted = labels(args.entities)
    if args.match:
        try:
            _ready(embedder)
            hits = semantic.search_phrase(semantic.build_index(docs, embedder), args.match, embedder, None, args.match_threshold).select("path").distinct()
            docs = semantic.filter_documents(docs, hits).persist()
        except semantic.SemanticError as e:
            say(f"--match can't be used: {e}")
            return 2
    extra = {"yolo_model": args.yolo_model, "yolo_classes": [x.strip() for x in (args.yolo_classes or "").split(",") if x.strip()]}
    images = "keep" if wanted and containers.IMAGE not in wanted else args.docx_images
    o = results.Options(args.backend, args.mode, tuple(wanted) if wanted else None, args.lang, args.threshold, args.mask_char, args.hash_key, args.out, args.dry_run, images, args.eml_attachments, {k: v for k, v in extra.items() if v})
    rows = run_files(spark, docs, o, registry)
    rows = (rows.drop("content", "sidecar") if args.dry_run else store(rows)).persist()
    for r in rows.orderBy("source").select(results.summary_line().alias("line")).toLocalIterator():
        say(r["line"])
    summary = results.run_summary(rows).first()
    head = json.loads(results.run_report(rows, args.json_include_values).first()["report"])
    emit(head, "documents", results.report_rows(rows, args.json_include_values), args.json, args.json_include_values)
    rows.unpersist()
    return summary["exit_code"]


def _verify(spark, args, docs, say) -> int:
    originals = None
    if args.original:
        if not os.path.isdir(args.original):
            say(f"not a folder: {args.original}")
            return 2
        originals = ingest.documents(spark, [args.original], recursive=False, include_unknown=True)
    reports = verify.verify(docs, originals, labels(args.entities), args.threshold, layers=containers.binary_layers)
    reports = reports.join(docs.select("path", "media_type").distinct(), "path").persist()
    for r in reports.orderBy("path").select("status", "path", "layers_scanned", "finding_count", "note").toLocalIterator():
        say(f"[{r['status']}] {r['path']}: {r['layers_scanned']} layers, {r['finding_count']} findings" + (f" | {r['note']}" if r["note"] else ""))
    summary = verify.verify_summary(reports).first().asDict()
    head = json.loads(results.run_report(spark.createDataFrame([], _EMPTY)).first()["report"]) | {"schema": "umbra.verify", "contains_pii_values": args.json_include_values, "summary": summary}
    emit(head, "artifacts", verify.report_rows(reports, args.json_include_values), args.json, args.json_include_values)
    reports.unpersist()
    return summary["exit_code"]


_EMPTY = f"success boolean, unredacted array<string>, entities array<{spans.ENTITY}>"


def main(argv: list[str] | None = None, spark: SparkSession | None = None, registry: backends.Registry | None = None, embedder=None) -> int:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("umbra").getOrCreate()
    registry, embedder = registry or backends.Registry.with_defaults(), embedder or semantic.ClipEmbedder()
    say = lambda *x: print(*x, file=sys.stderr if getattr(args, "json", None) == "-" else sys.stdout)
    if args.command == "list":
        for b in routing.listing(registry.dimension(spark)).collect():  # a row for each backend
            say(f"{b['name']:18} {'yes' if b['available'] else 'no ':3} {b['priority']:3} {','.join(b['media_types'])}" + (f"  needs {', '.join(b['missing'])}" if b["missing"] else ""))
        return 0
    if args.command == "search":
        return _search(spark, args, embedder, say)
    for x in ingest.unmatched(args.inputs):
        say(f"nothing matches {x}")
    wide = args.command == "verify"
    docs = ingest.documents(spark, args.inputs, not args.no_recursive, wide or args.include_unknown, wide)
    if not (wide or args.include_unknown):
        for r in ingest.skipped(spark, args.inputs, not args.no_recursive).where("reason = 'unknown type'").toLocalIterator():
            say(f"skipped {r['path']}: {r['reason']}")
    if args.command == "detect":
        n = 0
        for r in docs.select("input_ord", "path", "media_type").orderBy("input_ord", "path").toLocalIterator():
            say(f"{r['media_type']:10} {r['path']}")
            n += 1
        return 0 if n else 1
    if docs.isEmpty():
        say("no documents")
        return 1
    return _run(spark, args, docs, registry, embedder, say) if args.command == "run" else _verify(spark, args, docs, say)


if __name__ == "__main__":
    sys.exit(main())
