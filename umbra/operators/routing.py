"""Which backend takes a document: a join with the backend dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FLATTEN = "pdf-redact-tools"  # the fixed name of an external program
_TEXT, _OFFICE = ("text", "structured"), ("docx", "xlsx", "pptx", "email")
#: name, media types, priority, modules or tools it needs, description
BACKENDS = [
    ("presidio", (*_TEXT, *_OFFICE), 80, ("presidio_analyzer",), "named entities by a model, joined with the recognizers"),
    ("pymupdf", ("pdf",), 75, ("pymupdf",), "removes text from PDF content"),
    ("deface", ("image", "video"), 70, ("deface", "imageio"), "faces"),
    ("philter", _TEXT, 70, ("philter service",), "clinical text by a remote service"),
    ("yolo", ("image", "video"), 65, ("ultralytics", "cv2"), "objects by prompts, tracked in video"),
    ("redactai", ("pdf", "text"), 60, ("pypdf", "ollama service"), "spans by a language model, joined with the recognizers"),
    ("anonymizer", ("image", "video"), 60, ("anonymizer",), "faces and plates"),
    (FLATTEN, ("pdf",), 40, (FLATTEN,), "flattens pages to images"),
    ("ocr", ("image",), 30, ("rapidocr_onnxruntime", "PIL"), "text in pixels"),
    ("builtin", (*_TEXT, *_OFFICE), 10, (), "recognizers, needs nothing"),
]


def _present(need: str) -> bool:
    import importlib.util

    try:
        return importlib.util.find_spec(need) is not None
    except (ImportError, ValueError):
        return False


def backends(spark: SparkSession, registered: list[tuple] | None = None, available: dict[str, bool] | None = None) -> DataFrame:
    """The backend dimension. Availability is probed once, on the driver; ``available``
    overrides it. The last registration of a name wins."""
    rows = {b[0]: b for b in [*BACKENDS, *(registered or [])]}
    out = []
    for name, media, priority, needs, text in rows.values():
        missing = [x for x in needs if not _present(x)]
        ok = (available or {}).get(name, not missing)
        out.append((name, ok, [] if ok else missing, list(media), priority, text))
    return spark.createDataFrame(out, "name string, available boolean, missing array<string>, media_types array<string>, priority int, description string")


def listing(dimension: DataFrame) -> DataFrame:
    """Available ones first, then by priority and name."""
    return dimension.orderBy(~F.col("available"), F.desc("priority"), "name")


def candidates(docs: DataFrame, dimension: DataFrame) -> DataFrame:
    """All backends that support a document's media type, with their place."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("media_type").orderBy(~F.col("available"), F.desc("priority"), "name"))
    table = dimension.select(F.explode("media_types").alias("media_type"), "name", "available", "priority").withColumn("place", place)
    return docs.join(F.broadcast(table), "media_type")  # media types x backends rows at most


def route(docs: DataFrame, dimension: DataFrame, backend: str = "auto", name_col: str = "name") -> DataFrame:
    """``docs`` with ``backend`` or, where none fits, ``error``: a bad file is a row and
    never ends the batch. The dimension is folded to one row per media type before the
    join, which keeps documents where they are."""
    file, media = F.col(name_col), F.col("media_type")
    rows = dimension.select("name", "available", "missing", "media_types", "priority")
    if backend and backend != "auto":
        known = F.array_sort(F.collect_list("name"))
        one = rows.agg(known.alias("known"), F.max(F.when(F.col("name") == backend, F.struct("available", "missing", "media_types"))).alias("b"))
        joined = docs.withColumn("one", F.lit(1)).join(F.broadcast(one.withColumn("one", F.lit(1))), "one", "left")
        error = (
            F.when(F.col("b").isNull(), F.concat(F.lit(f"unknown backend '{backend}'. Known: "), F.array_join("known", ", ")))
            .when(~F.array_contains("b.media_types", media), F.concat(F.lit(f"backend '{backend}' does not support "), media, F.lit(" files (needed for "), file, F.lit(")")))
            .when(~F.col("b.available"), F.concat(F.lit(f"backend '{backend}' is not available: missing "), F.array_join("b.missing", ", ")))
        )
        return joined.select(*[docs[c] for c in docs.columns], F.when(error.isNull(), F.lit(backend)).alias("backend"), error.alias("error"))
    best = F.min(F.when(F.col("available"), F.struct((-F.col("priority")).alias("p"), F.col("name").alias("name"))))["name"]
    table = rows.select(F.explode("media_types").alias("m"), "*").groupBy("m").agg(best.alias("backend"), F.array_join(F.array_sort(F.collect_list("name")), ", ").alias("names"))
    joined = docs.join(F.broadcast(table), media == F.col("m"), "left")
    error = F.when(F.col("m").isNull(), F.concat(F.lit("no backend supports "), media, F.lit(" files ("), file, F.lit(")"))).when(
        F.col("backend").isNull(), F.concat(F.lit("no *available* backend for "), media, F.lit(" ("), file, F.lit("); backends that could handle it: "), F.col("names"), F.lit(" — install one and retry"))
    )
    return joined.select(*[docs[c] for c in docs.columns], "backend", error.alias("error"))
