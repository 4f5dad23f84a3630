"""The library surface: documents, backends and runs over a Spark session."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from enum import Enum

from pyspark.sql import DataFrame, SparkSession

from umbra.functions import spans
from umbra.operators import backends, results, routing
from umbra.sources import ingest

RoutingError = backends.RoutingError
BackendRegistry = backends.Registry
RedactionOptions = results.Options
MediaType = Enum("MediaType", {x.upper(): x for x in ingest.MEDIA_TYPES}, type=str)
RedactionMode = Enum("RedactionMode", {x.upper(): x for x in spans.MODES}, type=str)


@dataclass(frozen=True)
class Document:
    path: str
    media_type: str
    root: str | None = None
    content: bytes = field(default=b"", repr=False)

    @property
    def name(self) -> str:
        return self.path.rsplit("/", 1)[-1]

    def read_bytes(self) -> bytes:
        return self.content

    def read_text(self) -> str:
        return self.content.decode("utf-8", "replace").replace("\r\n", "\n").replace("\r", "\n")


@dataclass(frozen=True)
class Entity:
    entity_type: str
    start: int | None
    end: int | None
    score: float
    text: str | None = None

    def __str__(self) -> str:
        place = "" if self.start is None else f"[{self.start}:{self.end}]"
        return f"{self.entity_type}{place} ({self.score:.2f})"


@dataclass(frozen=True)
class RedactionResult:
    source: str
    output: str | None
    backend: str | None
    media_type: str
    success: bool
    entities: tuple[Entity, ...]
    redacted_text: str | None
    message: str
    unredacted: tuple[str, ...] = ()

    @property
    def fully_redacted(self) -> bool:
        return self.success and not self.unredacted

    @property
    def entity_counts(self) -> dict[str, int]:
        kinds = sorted(e.entity_type for e in self.entities)
        return {k: kinds.count(k) for k in dict.fromkeys(kinds)}

    def summary(self) -> str:
        counts = ", ".join(f"{k} x{n}" for k, n in self.entity_counts.items())
        state = "ok" if self.fully_redacted else "incomplete" if self.success else "failed"
        return f"[{state}] {self.source}: {len(self.entities)} entities" + (f" ({counts})" if counts else "") + (f" -> {self.output}" if self.output else "") + (f" | {self.message}" if self.message else "")


def _document(row) -> Document:
    return Document(row["path"], row["media_type"], row["root"], bytes(row["content"]))


def load_document(spark: SparkSession, path) -> Document:
    return _document(ingest.document(spark, str(path)).first())


def iter_documents(spark: SparkSession, inputs, recursive: bool = True, include_unknown: bool = False, skipped: list | None = None, include_outputs: bool = False) -> Iterator[Document]:
    """Documents in the order of the inputs, then of their paths, one at a time.
    ``skipped`` is given the paths of files of unknown type."""
    inputs = list(map(str, inputs))
    if skipped is not None and not include_unknown:
        skipped += [r["path"] for r in ingest.skipped(spark, inputs, recursive, include_outputs).where("reason = 'unknown type'").toLocalIterator()]
    for row in ingest.documents(spark, inputs, recursive, include_unknown, include_outputs).orderBy("input_ord", "path").toLocalIterator():
        yield _document(row)


def detect_media_type(spark: SparkSession, path) -> str:
    return load_document(spark, path).media_type


def candidates(document: Document, registry: backends.Registry) -> list[backends.Backend]:
    return registry.candidates(document.media_type)


def select_backend(document: Document, options: results.Options, registry: backends.Registry) -> backends.Backend:
    return registry.select(document.name, document.media_type, options.backend)


class RedactionSuite:
    """Runs over files. ``frame`` gives result rows for any size; ``redact_paths`` hands
    them out one at a time."""

    def __init__(self, spark: SparkSession, registry: backends.Registry | None = None, options: results.Options | None = None):
        self.spark, self.registry, self.options = spark, registry or backends.Registry.with_defaults(), options or results.Options()

    def frame(self, docs: DataFrame, write: bool = False) -> DataFrame:
        from umbra import cli

        rows = cli.run_files(self.spark, docs, self.options, self.registry)
        return cli.store(rows) if write and not self.options.dry_run else rows.drop("content", "sidecar")

    def redact_paths(self, inputs, recursive: bool = True, include_unknown: bool = False, write: bool = True) -> Iterator[RedactionResult]:
        docs = ingest.documents(self.spark, list(map(str, inputs)), recursive, include_unknown)
        for r in self.frame(docs, write).orderBy("source").toLocalIterator():
            found = tuple(Entity(*e) for e in r["entities"])
            yield RedactionResult(r["source"], r["output"], r["backend"], r["media_type"], r["success"], found, r["redacted_text"], r["message"], tuple(r["unredacted"]))

    def describe_backends(self) -> DataFrame:
        return routing.listing(self.registry.dimension(self.spark))
