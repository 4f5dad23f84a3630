"""Packing by order-preserving dynamic programming.

Documents are packed in the order of their file, split by split. Their token ids form
one stream that is cut into windows of at most 1024 tokens. Cuts are allowed at the
end of a document (free), at the end of a sentence or line (a small penalty) and, in
sentences of over 48 tokens, at every 16th token (a larger one).
The cuts minimise padding plus penalties: with ``f(j)`` the least cost up to cut
``j``, ``f(j) = penalty(j) + 1024 - j + min(f(i) + i)`` over the cuts ``i`` within 1024
before, and a monotone queue keeps the minimum. A split is worked off in stretches;
the last window of one goes over to the next. What is left at a split's end is cut
into sequences of powers of two, which need no padding.

Ids are those of the tokenizer file (its special strings included) and an end id per
document; null text is empty. Where the file is a byte-level BPE of the usual pattern,
tiktoken gives the same ids from the file's own vocabulary at a quarter of the time; each
task holds it against ``tokenizers`` on its first texts, and what it refuses, and every
other kind of file, goes to ``tokenizers``. An empty table gives no
pieces. Each row is a document of its own, repeated rows and null ids included. Reruns
agree as long as the files are split alike; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbra.llm.common import slices

WINDOW = 1024
END = 0
SENTENCE_COST = 4
HARD_COST = 16
GRID, LONG_SENTENCE = 16, 48
STRETCH = 1 << 18
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_NAMES = [x.split()[0] for x in SCHEMA.split(", ")]
_made: dict[str, object] = {}


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable
    Latin-1 for itself, the others from U+0100 on in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def _load(path: str) -> dict:
    """What is kept of a tokenizer file: ``slow``, and for byte-level BPE ``fast`` and
    the ids after which a sentence or line can end."""
    if path not in _made:
        import json

        from tokenizers import Tokenizer

        from umbra.llm.common import give_back

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kept = {"fast": None, "checked": False}
        top = max([0, *spec["model"]["vocab"].values(), *(x["id"] for x in spec.get("added_tokens", ()))]) if isinstance(spec["model"]["vocab"], dict) else Tokenizer.from_file(path).get_vocab_size()
        ends = np.zeros(max(1 << 16, top + 1), bool)
        level = spec.get("pre_tokenizer") or {}
        bytewise = spec["model"]["type"] == "BPE" and level.get("type") == "ByteLevel"
        byte_of = _byte_of()
        for token, i in spec["model"]["vocab"].items() if isinstance(spec["model"]["vocab"], dict) else ():
            raw = bytes(byte_of[c] for c in token) if bytewise and all(c in byte_of for c in token) else token.replace("</w>", "").encode()
            ends[i] = re.search(rb"[.!?]['\")\]]*$|\n", raw) is not None
        usual = bytewise and level.get("use_regex", True) and not level.get("add_prefix_space") and not spec.get("normalizer") and not any(spec["model"].get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        if usual:
            import public_tokenizers
            import tiktoken

            ranks = {bytes(byte_of[c] for c in t): i for t, i in spec["model"]["vocab"].items()}
            added = {x["content"]: x["id"] for x in spec.get("added_tokens", ())}
            for content in added:
                ranks.pop(content.encode(), None)
            kept["fast"] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)
        kept["enders"] = ends
        kept["slow"] = None if kept["fast"] else Tokenizer.from_file(path)
        _made[path] = kept
        del spec
        give_back()
    return _made[path]


def encode(texts: list[str], path: str | None = None) -> list[list[int]]:
    """Ids of ``tokenizers`` for the file at ``path``, with add_special_tokens=False."""
    path = path or tokenizer_path()
    kept = _load(path)
    fast = kept["fast"]

    def exact(t):
        if kept["slow"] is None:
            from tokenizers import Tokenizer

            kept["slow"] = Tokenizer.from_file(path)
        return kept["slow"].encode(t, add_special_tokens=False).ids

    if fast is None:
        return [exact(t) for t in texts]
    out = []
    for t in texts:
        try:
            out.append(fast.encode(t, allowed_special="all"))
        except BaseException as e:  # a text that its regular expressions give up on
            if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
                raise
            out.append(exact(t))
    if not kept["checked"] and texts:
        kept["checked"] = True
        for t, ids in list(zip(texts, out))[:8]:
            if len(t) < 10_000 and exact(t) != ids:
                kept["fast"] = None
                return encode(texts, path)
        kept["slow"] = None  # it is large, and seldom asked again
    return out


def _enders(path: str | None = None) -> np.ndarray:
    """By id: whether a sentence or line can end after that token."""
    return _load(path or tokenizer_path())["enders"]


def cuts(length: int, candidates: np.ndarray, cost: np.ndarray, window: int = WINDOW, hard: int = HARD_COST) -> list[int]:
    """Ends of the windows that pack 0..length; ``candidates`` are sorted places
    inside, ``length`` itself is free. Gaps of over a window get hard cuts."""
    places, costs = [], []
    last = 0
    for place, c in zip(candidates.tolist() + [length], cost.tolist() + [0]):
        while place - last > window:
            last += window
            places.append(last)
            costs.append(hard)
        if place > last:
            places.append(place)
            costs.append(c)
            last = place
    best, came = [0] * len(places), [-1] * len(places)
    queue: deque = deque([(0, 0, -1)])  # f(i) + i, place, index
    for j, (place, c) in enumerate(zip(places, costs)):
        while queue[0][1] < place - window:
            queue.popleft()
        least, _, i = queue[0]
        best[j] = f = c + window - place + least
        came[j] = i
        value = f + place
        while queue and queue[-1][0] >= value:
            queue.pop()
        queue.append((value, place, j))
    ends, j = [], len(places) - 1
    while j >= 0:
        ends.append(places[j])
        j = came[j]
    return ends[::-1]


class Packer:
    """Takes documents in order and gives pieces; keeps one stretch at most and what
    a longer document adds to it."""

    def __init__(self, window: int = WINDOW, first_sequence: int = 0, path: str | None = None):
        self.window, self.sequence, self.path = window, first_sequence, path
        self.docs: list[list] = []  # doc_id, ids, ids cut off before, tokens in all
        self.size = 0

    def add(self, doc_id, ids: np.ndarray):
        self.docs.append([doc_id, ids, 0, len(ids)])
        self.size += len(ids)
        if self.size >= STRETCH:
            yield from self._work(final=False)

    def finish(self):
        if self.size:
            yield from self._work(final=True)

    def _work(self, final: bool):
        ids = np.concatenate([d[1] for d in self.docs])
        doc_ends = np.cumsum([len(d[1]) for d in self.docs])
        cost = np.full(self.size, -1, np.int32)
        cost[_enders(self.path)[ids]] = SENTENCE_COST
        cost[doc_ends - 1] = 0
        natural = np.flatnonzero(cost >= 0)
        grid = np.arange(GRID - 1, self.size, GRID)
        after = np.searchsorted(natural, grid)
        grid = grid[(natural[after] - np.r_[-1, natural][after] > LONG_SENTENCE) & (cost[grid] < 0)]
        cost[grid] = HARD_COST
        at = np.flatnonzero(cost[:-1] >= 0)
        ends = cuts(self.size, at + 1, cost[at], self.window)
        tail = ends[-2] if len(ends) > 1 else 0
        if final:
            ends = ends[:-1]
            rest = self.size - tail
            while rest:
                step = min(self.window, 1 << (rest.bit_length() - 1))
                tail += step
                rest -= step
                ends.append(tail)
        else:
            ends = ends[:-1]
        first, doc, begun, opened = 0, 0, 0, 0  # where the document and the sequence start in ids
        for end in ends:
            while first < end:
                doc_id, own, before, tokens = self.docs[doc]
                stop = min(end, int(doc_ends[doc]))
                piece = ids[first:stop].astype("<u4").tobytes()
                yield doc_id, before + first - begun, stop - first, zlib.crc32(piece), tokens, self.sequence, first - opened
                first = stop
                if stop == int(doc_ends[doc]):
                    begun, doc = stop, doc + 1
            opened = end
            self.sequence += 1
        left = self.docs[doc:]
        if left:
            left[0] = [left[0][0], left[0][1][first - begun :], left[0][2] + first - begun, left[0][3]]
        self.docs, self.size = left, self.size - first


def _packer(path: str | None):
    def run(batches):
        packer = Packer(first_sequence=TaskContext.get().partitionId() << 32, path=path)
        rows: list[tuple] = []

        def out():
            return pa.record_batch([pa.array(x, pa.int64()) for x in zip(*rows)], names=_NAMES)

        for b in slices(batches, 256):
            for doc_id, own in zip(b.column(0).to_pylist(), encode([t or "" for t in b.column(1).to_pylist()], path)):
                rows += packer.add(doc_id, np.array(own + [END], np.uint32))
            if len(rows) > 50_000:
                yield out()
                rows = []
        rows += packer.finish()
        if rows:
            yield out()

    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """One row per piece of a document in a sequence. ``path`` names the tokenizer file
    on the workers (by default the public one of the contract)."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_packer(path), SCHEMA)


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the pieces."""
    return pack(docs)
