"""Document fingerprints: invertible Bloom lookup sketches of hashed paragraphs.

A text's paragraphs are its lines. A line is cut further, into runs of eight words on
average, where a word's hash says so (and text without spaces where that of a character
does), so that an edit changes only the pieces it touches however few lines a text has.
A piece's 48-bit digest (with its number among equal ones) is added to three cells, one
in each third of the sketch; a cell holds a count and the XOR of its digests, each with a
16-bit check. Subtracting the sketches of two versions leaves what differs, and peeling
cells with a single digest recovers the digests of either side. Where peeling gets stuck,
both versions are sketched again four times larger.

The likeness of two texts is shared pieces over all pieces (1 for two empty texts).

A fingerprint is the number of pieces and the base sketch, in base64: equal texts
have equal fingerprints. Null text is empty. The next document is that of the next
larger doc_id (null smallest, ties by a hash of the text), after the last the first;
a table of one row is its own next. An empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbra.functions.arrays import let
from umbra.llm.common import give_back, materialize, partitions

CELLS = 24
GROW = 4
MASK, _48, _ODD = np.uint64((1 << 48) - 1), np.uint64(48), np.uint64(0x9E3779B97F4A7C15)
_SHIFTS = np.array([[0], [16], [32]], np.uint64)
_CUT = 32  # of 256: the share of words after which a piece ends
_UNSPACED = 64  # bytes from which a word is taken for text without spaces
_CHAR_CUT = 8  # of 256: the share of its characters after which a piece ends


def pieces(text: str) -> np.ndarray:
    """Digests with checks, as uint64: 48 bits of digest, 16 of check above them."""
    seen: dict[bytes, int] = {}
    found: list[bytes] = []
    crc = zlib.crc32
    for line in text.encode("utf-8", "surrogatepass").split(b"\n"):
        words = line.split()
        begun = 0
        for i, word in enumerate(words, 1):
            if len(word) >= _UNSPACED:
                if begun < i - 1:
                    found.append(b" ".join(words[begun : i - 1]))
                found += unspaced(word)
                begun = i
            elif crc(word) & 0xFF < _CUT:
                found.append(b" ".join(words[begun:i]))
                begun = i
        if begun < len(words):
            found.append(b" ".join(words[begun:]))
    h, digests = xxhash.xxh3_64_intdigest, []
    for p in found:
        n = seen.get(p, 0)
        seen[p] = n + 1
        digests.append(h(p, n))
    keys = np.array(digests, np.uint64) & MASK
    return keys | check(keys) << _48


def unspaced(word: bytes) -> list[bytes]:
    """A long word cut after characters whose hash says so."""
    out, begun, at = [], 0, 0
    for c in word.decode("utf-8", "surrogatepass"):
        raw = c.encode("utf-8", "surrogatepass")
        at += len(raw)
        if zlib.crc32(raw) * 0x9E3779B1 >> 24 & 0xFF < _CHAR_CUT:
            out.append(word[begun:at])
            begun = at
    return out + [word[begun:]] if begun < at else out


def check(keys: np.ndarray) -> np.ndarray:
    return (keys & MASK) * _ODD >> _48


class Sketch:
    """``count`` and ``xor`` per cell; work goes over whole arrays."""

    __slots__ = ("count", "xor")

    def __init__(self, cells: int = CELLS, items: np.ndarray | None = None):
        self.count, self.xor = np.zeros(cells // 3 * 3, np.int64), np.zeros(cells // 3 * 3, np.uint64)
        if items is not None:
            self.add(items, 1)

    def places(self, items: np.ndarray) -> np.ndarray:
        third = len(self.count) // 3
        parts = (items[None, :] >> _SHIFTS & np.uint64(0xFFFF)) * np.uint64(third) >> np.uint64(16)
        return (parts.astype(np.int64) + np.array([[0], [third], [2 * third]])).ravel()

    def add(self, items: np.ndarray, signs):
        at = self.places(items)
        np.add.at(self.count, at, np.tile(signs, 3) if np.ndim(signs) else signs)
        np.bitwise_xor.at(self.xor, at, np.tile(items, 3))

    def minus(self, other: Sketch) -> Sketch:
        out = Sketch(len(self.count))
        out.count, out.xor = self.count - other.count, self.xor ^ other.xor
        return out

    def size(self, total: int) -> float:
        """About how many items it holds, of which ``total`` more are of the first
        kind: the squared counts spread by one for each item and cell."""
        return float(((self.count - total * 3 / len(self.count)) ** 2).sum()) / 3

    def peel(self) -> tuple[np.ndarray, np.ndarray] | None:
        """Digests only in the first and only in the second; None where it is stuck."""
        mine, theirs, most = [], [], len(self.count)
        while True:
            pure = np.flatnonzero((self.count == 1) | (self.count == -1))
            pure = pure[self.xor[pure] >> _48 == check(self.xor[pure])]
            if len(pure):  # a mix of digests that looks like one seldom belongs where it is
                pure = pure[(self.places(self.xor[pure]).reshape(3, -1) == pure).any(axis=0)]
            if not len(pure):
                break
            most -= len(pure)
            if most < -2 * len(self.count):  # such a mix can put itself back; no sketch holds so many
                return None
            items, first = np.unique(self.xor[pure], return_index=True)
            signs = self.count[pure[first]]
            self.add(items, -signs)
            mine.append(items[signs == 1])
            theirs.append(items[signs == -1])
        if self.count.any() or self.xor.any():
            return None
        none = [np.zeros(0, np.uint64)]
        return np.concatenate(none + mine) & MASK, np.concatenate(none + theirs) & MASK

    def pack(self, n: int) -> str:
        raw = np.empty(len(self.count), [("c", "i1"), ("x", "<u8")])
        raw["c"] = self.count.astype(np.int8)
        raw["x"] = self.xor
        return base64.b64encode(n.to_bytes(4, "little") + raw.tobytes()).decode()


def difference(a: np.ndarray, b: np.ndarray, base_a: Sketch | None = None, base_b: Sketch | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Digests only in ``a`` and only in ``b``. Where the base sketches (made here if
    not given) can't be peeled, larger ones are made until peeling ends; the counts of
    the stuck one tell how much larger the next has to be at least."""
    left = (base_a or Sketch(CELLS, a)).minus(base_b or Sketch(CELLS, b))
    cells, total = CELLS, len(a) - len(b)
    while True:
        need = 1.5 * max(left.size(total), abs(total))
        found = left.peel() if need < 4 * cells else None
        if found is not None:
            return found
        cells *= GROW
        while cells < need:
            cells *= GROW
        if cells > 8 * GROW * (len(a) + len(b)) + CELLS * GROW:  # two digests alike in all three places
            return np.setdiff1d(a, b) & MASK, np.setdiff1d(b, a) & MASK
        left = Sketch(cells, a)
        left.add(b, -1)


def likeness(a: np.ndarray, b: np.ndarray, base_a: Sketch | None = None, base_b: Sketch | None = None) -> float:
    if not len(a) and not len(b):
        return 1.0
    mine, theirs = difference(a, b, base_a, base_b)
    return (len(a) - len(mine)) / (len(a) + len(theirs))


def edit(text: str, following: str) -> str:
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_NAMES = [x.split()[0] for x in _SCHEMA.split(", ")]
SAMPLED = 64  # rows looked at for each range
SLICE = 256  # rows that are Python objects at a time


def _pairs(batches):
    """Rows sorted by (range, guest, ...): each with the row after it in its range."""
    before = None  # range, guest, doc_id, text, pieces, sketch
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    for whole in batches:
        for first in range(0, whole.num_rows, SLICE):
            batch, rows = whole.slice(first, SLICE), []
            for rng, guest, doc_id, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if before and before[1] and before[0] == rng:
                    continue  # only the first guest is a next document
                text = text or ""
                mine = pieces(text)
                base = Sketch(CELLS, mine)
                if before and before[0] == rng:
                    _, _, old_id, old, theirs, old_base = before
                    changed = edit(old, text)
                    edited = pieces(changed)
                    edited_base = Sketch(CELLS, edited)
                    digest = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
                    rows.append((old_id, len(old), digest, old_base.pack(len(theirs)), edited_base.pack(len(edited)), likeness(theirs, edited, old_base, edited_base), likeness(theirs, mine, old_base, base)))
                before = (rng, guest, doc_id, text, mine, base)
            yield pa.record_batch([pa.array(list(x), t) for x, t in zip(zip(*rows) if rows else [[]] * 7, types)], names=_NAMES)
    give_back()


def _range_of(place, bounds: list[tuple]):
    """The number of sorted ``bounds`` (key, th, nr) at or under ``place``, found in
    three steps down a tree of arrays: a row is held against a few bounds only."""
    fan = max(2, math.ceil(len(bounds) ** (1 / 3)))
    many = lambda xs: "array({})".format(", ".join("named_struct('key', {}L, 'th', {}L, 'nr', {}L)".format(*x) for x in xs).replace("-9223372036854775808L", "(-9223372036854775807L - 1L)"))
    of = "array<struct<key:bigint,th:bigint,nr:bigint>>"
    leaves = [bounds[i : i + fan - 1] for i in range(0, len(bounds) + 1, fan)]
    middle = [bounds[i + fan - 1 : i + fan * (fan - 1) : fan] for i in range(0, len(bounds) + 1, fan * fan)]
    top = bounds[fan * fan - 1 :: fan * fan]
    tree = [F.expr(f"array({', '.join(many(x) if x else f'cast(array() as {of})' for x in level)})") for level in ([top], middle, leaves)]

    def under(held):
        return F.coalesce(F.size(F.filter(held, lambda b: b <= place)), F.lit(0))

    def down(above, level, then):
        return let(above * fan + under(F.get(tree[level], above)), then) if then else above * fan + under(F.get(tree[level], above))

    return let(under(F.get(tree[0], F.lit(0))), lambda g: down(g, 1, lambda h: down(h, 2, None)))


def version_sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranges: int | None = None) -> DataFrame:
    """The columns of ``_SCHEMA`` for every row of ``docs``.

    Rows in the order of id, hash of the text and place in the input are cut into ranges
    by a sample, so that rows of one id, or none, spread over ranges too. Each range is
    one sorted run, and gets a guest: a copy of the row that follows its last one. Texts
    are read twice and move once.
    """
    spark = docs.sparkSession
    ranges = ranges or 4 * partitions(spark)
    least = -(1 << 63)
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(least)).alias("key"), F.coalesce(F.xxhash64(text_col), F.lit(0)).alias("th"), F.monotonically_increasing_id().alias("nr"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    places = materialize(rows.select("key", "th", "nr"), "places")
    share = min(1.0, SAMPLED * ranges / max(1, places.count()))
    drawn = places.where(F.pmod(F.xxhash64("nr", "th"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1)
    drawn = sorted(tuple(r) for r in drawn.collect())  # SAMPLED * ranges rows or so
    bounds = sorted({drawn[len(drawn) * i // ranges] for i in range(1, ranges)}) if drawn else []
    place = F.struct("key", "th", "nr")
    rng = _range_of(place, bounds) if bounds else F.lit(0)
    firsts = places.groupBy(rng.alias("rng")).agg(F.min(place).alias("first")).orderBy("rng").collect()  # ranges rows
    if not firsts:
        return spark.createDataFrame([], _SCHEMA)
    following = {}
    for i, row in enumerate(firsts):
        following.setdefault(tuple(firsts[(i + 1) % len(firsts)]["first"]), []).append(row["rng"])
    table = spark.createDataFrame([(*k, v) for k, v in following.items()], "k long, t long, n long, into array<int>")  # at most `ranges` rows
    first = rows.join(F.broadcast(table), (F.col("key") == F.col("k")) & (F.col("th") == F.col("t")) & (F.col("nr") == F.col("n")), "left")
    goes = F.concat(F.array(F.struct(rng.cast("int").alias("rng"), F.lit(False).alias("guest"))), F.coalesce(F.transform("into", lambda r: F.struct(r.alias("rng"), F.lit(True).alias("guest"))), F.array().cast("array<struct<rng:int,guest:boolean>>")))
    every = first.select(F.explode(goes).alias("to"), "key", "th", "nr", "doc_id", "text").select("to.rng", "to.guest", "key", "th", "nr", "doc_id", "text")
    dealt = every.repartition(partitions(spark), "rng").sortWithinPartitions("rng", "guest", "key", "th", "nr")
    return dealt.select("rng", "guest", "doc_id", "text").mapInArrow(_pairs, _SCHEMA)
