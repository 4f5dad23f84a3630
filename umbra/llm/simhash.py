"""SimHash near-dedup with a bit-sliced comparison.

Fingerprints: words are runs of anything but white space (A-Z lower-cased), shingles
are 3 words with repeats (fewer words: all of them), each hashed with XXH64, seed 42;
a bit is set if over half of the hashes have it. No words, or null text: zero.

Links (2 differing bits at most): distinct fingerprints are put in blocks by two of
their four 16-bit parts, since two bits can touch two parts only. Within a block the
fingerprints stand in lanes of 64-bit words, one bit plane for each of the 64 bits.
A fingerprint is compared with 64 lanes at once: each plane's difference is added to
two carry-save counter bits, and a row of lanes is abandoned once all its lanes have
more than 2. A block gives a spanning star for each of its components, never pairs.
Blocks of over ``BLOCK`` fingerprints (large groups of near copies) go another exact
way: each fingerprint meets others at the 65 values one flipped bit away at most,
where at most 65 fingerprints can meet.

``component_id`` is the smallest doc_id reachable over links (null only if all ids of
a component are null). Repeated rows and equal texts share a fingerprint. An empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbra.llm.common import drop_rows, give_back, join_facts, materialize, partitions, slices
from umbra.llm.components import components

RADIUS = 2
BLOCK = 1024
SHINGLE = 3
_STEP = 1 << 20
_PAIRS = [(a, b) for a in range(4) for b in range(a + 1, 4)]


def fingerprint(text: str | None) -> int:
    """Unsigned 64-bit SimHash."""
    words = (text or "").encode().lower().split()  # bytes split at \x20 and \x09-\x0D
    n = len(words)
    if not n:
        return 0
    h = xxhash.xxh64_intdigest
    if n <= SHINGLE:
        hashes = [h(b" ".join(words), 42)]
    else:
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
        starts = np.concatenate(([0], ends[:-1]))
        hashes = [h(joined[a:b], 42) for a, b in zip(starts[: n - SHINGLE + 1].tolist(), (ends[SHINGLE - 1 :] - 1).tolist())]
    counts = np.zeros(64, np.int64)
    for a in range(0, len(hashes), _STEP):
        raw = np.array(hashes[a : a + _STEP], "<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(raw, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes), bitorder="little").tobytes(), "little")


def _fingerprints(batches):
    for b in slices(batches):
        texts = b.column(1).to_pylist()
        fps = np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)
        keys = np.array([xxhash.xxh64_intdigest((t or "").encode(), 42) for t in texts], np.uint64).view(np.int64)  # as F.xxhash64
        yield pa.record_batch([b.column(0), pa.array(fps), pa.array(keys)], names=["doc_id", "fp", "th"])


def within(planes: np.ndarray, fps: np.ndarray, query: np.ndarray, word: np.ndarray, mask: np.ndarray, radius: int = RADIUS):
    """Lanes of ``word`` (under ``mask``) within 2 bits of ``fps[query]``: indexes of
    the (query, word) pairs that have any, and their lanes as bits."""
    active = np.arange(len(query))
    q, w, m = fps[query], word, mask
    ones, twos, over = (np.zeros(len(active), np.uint64) for _ in range(3))
    for bit in range(64):
        same = (q >> np.uint64(bit)) & np.uint64(1)
        d = planes[bit][w] ^ (np.uint64(0) - same)
        carry = ones & d
        ones ^= d
        over |= twos & carry
        twos ^= carry
        if bit % 8 == 7:
            alive = (~(over | (ones & twos)) & m) != 0
            if not alive.all():
                active, q, w, m, ones, twos, over = (x[alive] for x in (active, q, w, m, ones, twos, over))
                if not len(active):
                    break
    return active, ~(over | (ones & twos)) & m


def block_links(bucket: np.ndarray, fps: np.ndarray) -> list[tuple[int, int]]:
    """Star edges among rows sorted by bucket; a bucket's rows have distinct fps."""
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    first, last = np.r_[0, cuts], np.r_[cuts, len(bucket)]
    many = last - first > 1
    first, last = first[many], last[many]
    if not len(first):
        return []
    lanes, query, word, mask = [], [], [], []
    used = 0  # lanes
    for a, b in zip(first.tolist(), last.tolist()):
        n = b - a
        if used % 64 + n > 64:  # a block starts a word unless it fits what is left of one
            lanes.append(np.zeros(-used % 64, np.int64))
            used += -used % 64
        lanes.append(np.arange(a, b))
        for w in range(used // 64, (used + n - 1) // 64 + 1):
            low, high = max(used, w * 64) - w * 64, min(used + n, w * 64 + 64) - w * 64
            query.append(np.arange(a, b))
            word.append(np.full(n, w))
            mask.append(np.full(n, ((1 << high) - 1) ^ ((1 << low) - 1), np.uint64))
        used += n
    lanes.append(np.zeros(-used % 64, np.int64))
    at = np.concatenate(lanes)
    held = fps[at]
    planes = np.stack([np.packbits(((held >> np.uint64(b)) & np.uint64(1)).astype(np.uint8), bitorder="little").view("<u8") for b in range(64)])
    query, word, mask = map(np.concatenate, (query, word, mask))
    labels = np.arange(len(bucket))
    for a in range(0, len(query), _STEP):
        part = slice(a, a + _STEP)
        found, bits = within(planes, fps, query[part], word[part], mask[part])
        bitrows = np.unpackbits(bits.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        rows, lane = np.nonzero(bitrows)
        left, right = query[part][found[rows]], at[word[part][found[rows]] * 64 + lane]
        near = left < right  # each pair once, and no fingerprint with itself
        left, right = left[near], right[near]
        held = np.flatnonzero(labels != np.arange(len(labels)))  # links of earlier slices, else lost as a label sinks
        left, right = np.r_[left, held], np.r_[right, labels[held]]
        while len(left):  # labels sink to the smallest row of a component
            least = np.minimum(labels[left], labels[right])
            before = labels.copy()
            np.minimum.at(labels, left, least)
            np.minimum.at(labels, right, least)
            labels = labels[labels]
            if (labels == before).all():
                break
    members = np.flatnonzero(labels != np.arange(len(labels)))
    signed = fps.view(np.int64)
    return list(zip(signed[members].tolist(), signed[labels[members]].tolist()))


def _compare(batches):
    """Blocks come sorted; one that goes on in the next batch is carried over."""
    held_b, held_f = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def out(bucket, fps):
        found = block_links(bucket, fps.view(np.uint64))
        return pa.record_batch([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["u", "v"])

    for b in batches:
        held_b, held_f = np.r_[held_b, b.column(0).to_numpy()], np.r_[held_f, b.column(1).to_numpy()]
        cut = int(np.searchsorted(held_b, held_b[-1])) if len(held_b) else 0
        if cut:
            yield out(held_b[:cut], held_f[:cut])
            held_b, held_f = held_b[cut:], held_f[cut:]
    if len(held_b):
        yield out(held_b, held_f)
    give_back()


def links(fps: DataFrame, block: int = BLOCK) -> DataFrame:
    """Distinct ``fps(fp)`` to edges ``(u, v)`` that connect all within 2 bits."""
    part = lambda i: F.shiftrightunsigned("fp", 16 * i).bitwiseAND(F.lit(0xFFFF))
    keys = [F.shiftleft(F.lit(n).cast("long"), 32).bitwiseOR(F.shiftleft(part(a), 16)).bitwiseOR(part(b)) for n, (a, b) in enumerate(_PAIRS)]
    blocks = fps.select(F.explode(F.array(*keys)).alias("bucket"), "fp")
    hot = materialize(blocks.groupBy("bucket").count().where(F.col("count") > block).select("bucket"), "hot")
    cold = blocks.join(hot, "bucket", "left_anti").repartition(partitions(fps.sparkSession), "bucket").sortWithinPartitions("bucket", "fp")
    found = cold.mapInArrow(_compare, "u long, v long")
    if hot.isEmpty():
        return found
    large = blocks.join(hot, "bucket", "left_semi").select("fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *[F.lit((1 << i) - (1 << 64) * (i == 63)).cast("long") for i in range(64)])
    meet = large.select("fp", F.explode(flips).alias("flip")).select(F.col("fp").bitwiseXOR(F.col("flip")).alias("at"), "fp")
    meet = meet.groupBy("at").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)
    return found.unionByName(meet.select(F.explode("fps").alias("u"), F.array_min("fps").alias("v")).where("u != v"))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """doc_id, fingerprint, component_id, th (a hash of the text) and root (the
    fingerprint that names the component, whatever its ids) per row."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = materialize(rows.mapInArrow(_fingerprints, "doc_id long, fp long, th long"), "simhash")
    distinct = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "distinct")
    tree = components(links(distinct.select("fp"), block))
    tree = tree.withColumnRenamed("u", "fp")
    rooted = materialize(distinct.join(tree, "fp", "left").select("fp", "n", "least", F.coalesce("root", "fp").alias("root")), "rooted")
    least = materialize(rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("fps")), "least")
    named = materialize(join_facts(rooted, least, "root", "fps").select("fp", "component_id", "root", "n"), "named")
    return join_facts(rows, named, "fp", "n").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "th", "root")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each component the row with the smallest doc_id stays (null
    last; of several with that id the one whose text hash is smallest, and of repeated
    rows one). Components go by their root: ids may be null or stand for several texts."""
    rows = materialize(near_groups(docs).withColumn("nth", F.monotonically_increasing_id()), "near")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "th", "nth")
    first = materialize(rows.groupBy("root").agg(F.min(order)["nth"].alias("first"), F.count("*").alias("n")), "first")
    keys = join_facts(rows, first, "root", "n").select(F.col("doc_id").alias("id"), "th", (F.col("nth") == F.col("first")).alias("kept"))
    return drop_rows(docs, keys, F.xxhash64(F.coalesce("text", F.lit(""))))
