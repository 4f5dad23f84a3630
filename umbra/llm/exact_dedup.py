"""Exact dedup by a Golomb-coded fingerprint exchange.

1. Each scan partition hashes its normalised texts (A-Z lower-cased), sorts the
   distinct 48-bit fingerprints of each hash range and sends them, Golomb-Rice
   coded, to the owner of the range. No text moves.
2. An owner merges the lists of all senders and returns to each a bitmap of the
   fingerprints that somebody else sent too.
3. Rows whose bit is set, or whose fingerprint repeats in its own partition, are
   suspects. Only their texts are shuffled, aggregated by the whole text on the map
   side first, which compares them byte by byte and leaves one row per text and map
   task: a group of copies of any size stays small.

Null text counts as empty; null doc_id is an id of its own that is smaller than any
other. Of equal texts the row with the largest doc_id stays; of repeated rows with
that doc_id one stays. A text of a third of all rows is no one task's: its facts are
broadcast to its rows (``join_facts``). An empty table gives an empty result. Other columns of the
input are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbra.llm.common import ascii_lower, drop_rows, join_facts, materialize, partitions, slices

FP_BITS = 48
BLOCK_ROWS = 200_000
OWNER_ROWS = 1_000_000  # about how many fingerprints an owner decodes at a time
_SCHEMA = "doc_id long, row_key long, sha string, block long, owner int, rank int, again boolean, payload binary"
_ARROW = pa.schema([("doc_id", pa.int64()), ("row_key", pa.int64()), ("sha", pa.string()), ("block", pa.int64()), ("owner", pa.int32()), ("rank", pa.int32()), ("again", pa.bool_()), ("payload", pa.binary())])


def golomb_encode(values: np.ndarray) -> bytes:
    """Sorted distinct uint64 values; Rice codes of their differences, quotients and
    remainders in two runs so that both sides work on whole arrays."""
    n = len(values)
    if not n:
        return b"\0" * 5
    deltas = np.diff(values, prepend=np.uint64(0))
    k = max(0, int(float(values[-1]) / n).bit_length() - 1)
    quotients = (deltas >> np.uint64(k)).astype(np.int64)
    unary = np.ones(int(quotients.sum()) + n, np.uint8)
    unary[np.cumsum(quotients + 1) - 1] = 0
    out = n.to_bytes(4, "little") + bytes([k]) + len(unary).to_bytes(4, "little") + np.packbits(unary).tobytes()
    if k:
        shifts = np.arange(k, dtype=np.uint64)
        out += np.packbits(((deltas[:, None] >> shifts) & np.uint64(1)).astype(np.uint8)).tobytes()
    return out


def golomb_decode(data: bytes) -> np.ndarray:
    n, k = int.from_bytes(data[:4], "little"), data[4]
    if not n:
        return np.zeros(0, np.uint64)
    bits = int.from_bytes(data[5:9], "little")
    cut = 9 + (bits + 7) // 8
    stops = np.flatnonzero(np.unpackbits(np.frombuffer(data[9:cut], np.uint8))[:bits] == 0)
    deltas = (np.diff(stops, prepend=-1) - 1).astype(np.uint64) << np.uint64(k)
    if k:
        low = np.unpackbits(np.frombuffer(data[cut:], np.uint8))[: n * k].reshape(n, k).astype(np.uint64)
        deltas |= (low << np.arange(k, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    return np.cumsum(deltas, dtype=np.uint64)


def _sender(owners: int):
    def flush(block, ids, shas, hashes):
        h = np.array(hashes, np.uint64)
        fp = h >> np.uint64(64 - FP_BITS)
        owner = ((h >> np.uint64(32)) * np.uint64(owners) >> np.uint64(32)).astype(np.int32)
        distinct, inverse, counts = np.unique(fp, return_inverse=True, return_counts=True)
        own = np.zeros(len(distinct), np.int32)
        own[inverse] = owner  # the owner is a function of the upper 32 bits
        firsts = np.searchsorted(own, np.arange(owners + 1))  # distinct is sorted, and so are its owners
        n = len(ids)
        rank = (np.arange(len(distinct)) - firsts[own])[inverse].astype(np.int32)
        yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(np.arange(n) + (block << 20)), pa.array(shas), pa.array(np.full(n, block)), pa.array(owner), pa.array(rank), pa.array(counts[inverse] > 1), pa.nulls(n, pa.binary())], schema=_ARROW)
        sent = [o for o in range(owners) if firsts[o] < firsts[o + 1]]
        m = len(sent)
        yield pa.record_batch([pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.string()), pa.array(np.full(m, block)), pa.array(sent, pa.int32()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.bool_()), pa.array([golomb_encode(distinct[firsts[o] : firsts[o + 1]]) for o in sent], pa.binary())], schema=_ARROW)

    def run(batches):
        base, nth = TaskContext.get().partitionId() << 20, 0
        ids, shas, hashes = [], [], []
        for batch in slices(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                raw = (text or "").encode().lower()  # of bytes: A-Z only
                ids.append(doc_id)
                shas.append(hashlib.sha256(raw).hexdigest())
                hashes.append(xxhash.xxh3_64_intdigest(raw))
                if len(ids) >= BLOCK_ROWS:
                    yield from flush(base + nth, ids, shas, hashes)
                    nth, ids, shas, hashes = nth + 1, [], [], []
        if ids:
            yield from flush(base + nth, ids, shas, hashes)

    return run


def _owner(pdf):
    """Bitmaps for the senders of one hash range; none where nothing repeats."""
    lists = [golomb_decode(x) for x in pdf["payload"]]
    sender = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    values = np.concatenate(lists)
    _, inverse, counts = np.unique(values, return_inverse=True, return_counts=True)
    hit = counts[inverse] > 1
    pdf["bitmap"] = [np.packbits(hit[a:b]).tobytes() if hit[a:b].any() else None for a, b in zip(*(lambda e: (np.r_[0, e[:-1]], e))(np.searchsorted(sender, np.arange(len(lists)), side="right")))]
    return pdf.loc[pdf["bitmap"].notnull(), ["block", "owner", "bitmap"]]


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, row_key, text_sha256, keep_id, group_size, kept."""
    spark = docs.sparkSession
    owners = max(partitions(spark), -(-docs.count() // OWNER_ROWS))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sent = materialize(texts.mapInArrow(_sender(owners), _SCHEMA), "fingerprints")
    bitmaps = sent.where("payload is not null").select("block", "owner", "payload").groupBy("owner").applyInPandas(_owner, "block long, owner int, bitmap binary")
    bit = F.expr("shiftright(cast(conv(hex(substring(bitmap, cast(rank / 8 as int) + 1, 1)), 16, 10) as int), 7 - rank % 8) % 2 = 1")
    rows = sent.where("payload is null").drop("payload").join(materialize(bitmaps, "bitmaps"), ["block", "owner"], "left")
    rows = materialize(rows.select("doc_id", "row_key", "sha", (F.col("again") | F.coalesce(bit, F.lit(False))).alias("suspect")), "suspects")
    ids = materialize(rows.where("suspect").select(F.col("doc_id").alias("id")).distinct(), "suspect_ids")
    text = texts.join(ids, texts["doc_id"].eqNullSafe(ids["id"]), "left_semi")
    distinct = text.select(ascii_lower(F.col("text")).alias("norm")).groupBy("norm").agg(F.lit(1).alias("one"))
    proven = distinct.select(F.sha2("norm", 256).alias("sha")).groupBy("sha").agg(F.count("*").alias("texts"))
    proven = proven.select("sha", F.when(F.col("texts") > 1, F.raise_error(F.lit("two texts share a SHA-256"))).otherwise(F.lit(True)).alias("proven"))
    groups = rows.where("suspect").groupBy("sha").agg(F.max(F.struct("doc_id", "row_key")).alias("top"), F.count("*").alias("size")).where("size > 1")
    groups = materialize(groups.join(proven, "sha").where("proven").select("sha", F.col("top.doc_id").alias("top_id"), F.col("top.row_key").alias("top_key"), "size"), "groups")
    return join_facts(rows, groups, "sha", "size").select(
        "doc_id", "row_key",
        F.when(F.col("size").isNull(), F.col("doc_id")).otherwise(F.col("top_id")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("row_key") == F.col("top_key"), F.lit(True)).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the rows that stay, with their columns."""
    rows = exact_groups(docs).select(F.col("doc_id").alias("id"), F.col("text_sha256").alias("th"), "kept")
    return drop_rows(docs, rows, F.sha2(ascii_lower(F.col("text")), 256), merge=True)
