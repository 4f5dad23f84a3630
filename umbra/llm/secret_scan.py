"""Secret scans with an incremental blob ledger, by DataFrame functions only.

Every version of every path is named by the SHA-256 of its text. The ledger is a table in
the shared folder with one row for each blob and rule version that has been scanned, with
its spans. A run scans the distinct blobs whose pair with the rule version the ledger
lacks, each once however many paths hold it, appends them, and joins the spans back to
all paths.

A text that no rule can match (it lacks ``HINT``, which is part of the rule version) goes
into the ledger as its digest alone, and only hinted texts move between machines.

Rules, leftmost and without overlap per kind: ``assign`` (a name like password or token,
a sign, and a value of 6 characters or more), ``access`` (AKIA and 16 or more of A-Z0-9)
and ``hex`` (24 or more of 0-9a-f). Spans are in code points, end exclusive. The method
adds no spans of its own, so ``spans`` are the base spans. They are found in time that is
almost linear in the text and its matches.

Null text counts as empty. Every row gives one row; repeated rows and null ids are
allowed, an empty table gives an empty result, and other columns are not read.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from umbra.functions.arrays import starts
from umbra.llm.common import delete_on_exit, join_facts, materialize, shared_dir

RULES = "base-1"
KINDS = ("assign", "access", "hex")
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
LEAST = 6
HINT = f"(?i:password|passwd|secret|token|api_?key)|{ACCESS}|{HEX}"
_SPANS = "array<struct<start:int,kind:int,stop:int>>"


def _spans(kind: int, ok: Column | None = None) -> Column:
    """Spans of the columns m{kind} (matches) and g{kind} (what lies between)."""
    n = F.size(f"m{kind}")
    pairs = F.zip_with(F.col(f"m{kind}"), F.slice(F.col(f"g{kind}"), F.lit(1), n), lambda m, g: F.struct(F.length(g).alias("gap"), F.length(m).alias("len")))
    spans = F.zip_with(starts(pairs), F.col(f"m{kind}"), lambda at, m: F.struct(at.alias("start"), F.lit(kind).alias("kind"), (at + F.length(m)).alias("stop")))
    if ok is None:
        return spans
    return F.transform(F.filter(F.zip_with(spans, ok, lambda s, k: F.struct(s.alias("s"), k.alias("k"))), lambda x: x["k"]), lambda x: x["s"])


def scan_blobs(blobs: DataFrame) -> DataFrame:
    """``blobs(blob, text)`` to blob, rules and spans."""
    found = blobs.select(
        "blob",
        *[F.regexp_extract_all("text", F.lit(p), F.lit(0)).alias(f"m{i}") for i, p in enumerate((ASSIGN, ACCESS, HEX))],
        *[F.split("text", p, -1).alias(f"g{i}") for i, p in enumerate((ASSIGN, ACCESS, HEX))],
        F.transform(F.regexp_extract_all("text", F.lit(ASSIGN), F.lit(2)), lambda v: F.length(v) >= LEAST).alias("ok"),
    )
    spans = F.array_sort(F.concat(_spans(0, F.col("ok")), _spans(1), _spans(2)))
    return found.select("blob", F.lit(RULES).alias("rules"), F.coalesce(spans, F.array().cast(_SPANS)).alias("spans"))


class Ledger:
    """A table blob, rules, spans in a folder (by default a new one in the shared
    folder), to which runs append. A run that fails leaves it as it was; pairs that two
    runs add at the same time are the same rows, and are read as one."""

    SCHEMA = f"blob string, rules string, spans {_SPANS}"

    def __init__(self, spark, folder: str | None = None):
        self.spark, self.folder = spark, folder or f"{shared_dir(spark)}/umbra-ledger-{uuid.uuid4().hex}"
        if folder is None:
            delete_on_exit(spark, self.folder)

    def rows(self) -> DataFrame | None:
        """None where nothing has been added yet."""
        try:
            return self.spark.read.schema(self.SCHEMA).parquet(self.folder)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" in (e.getCondition() or ""):
                return None
            raise

    def add(self, found: DataFrame) -> None:
        found.write.mode("append").parquet(self.folder)


def scan(docs: DataFrame, ledger: Ledger | None = None, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, Ledger]:
    """The spans of every row (doc_id, blob, spans), and the ledger with what this run
    added."""
    ledger = ledger or Ledger(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    paths = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.sha2(text, 256).alias("blob"), F.when(text.rlike(HINT), text).alias("text"))
    paths = materialize(paths, "paths")  # the one pass over the texts; few of them stay
    known = ledger.rows()
    known = None if known is None else known.where(F.col("rules") == RULES)
    unseen = paths if known is None else paths.join(known.select("blob"), "blob", "left_anti")
    hinted = unseen.where("text is not null").groupBy("blob").agg(F.first("text").alias("text"))
    clean = unseen.where("text is null").select("blob").distinct()
    empty = F.array().cast(_SPANS)
    ledger.add(scan_blobs(hinted).unionByName(clean.select("blob", F.lit(RULES).alias("rules"), empty.alias("spans"))))
    # what isn't hinted has no spans and needs no join
    sizes = paths.where("text is not null").groupBy("blob").agg(F.count("*").alias("paths"))
    spans = ledger.rows().where((F.col("rules") == RULES) & (F.size("spans") > 0)).select("blob", "spans").dropDuplicates(["blob"])
    hits = materialize(sizes.join(spans, "blob"), "hits")
    joined = join_facts(paths.where("text is not null").select("doc_id", "blob"), hits, "blob", "paths")
    rows = joined.select("doc_id", "blob", F.coalesce("spans", empty).alias("spans"))
    return rows.unionByName(paths.where("text is null").select("doc_id", "blob", empty.alias("spans"))), ledger


def report(rows: DataFrame) -> DataFrame:
    """The digest columns of the query."""
    kinds = F.array(*map(F.lit, KINDS))
    text = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["stop"])), ",")
    of = lambda i: F.filter("spans", lambda s: s["kind"] == i)
    counts = [F.size(of(i)).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return rows.withColumn("all", text).select("doc_id", *counts, F.sha2("all", 256).alias("base_sha256"), F.col("all").alias("spans"))
