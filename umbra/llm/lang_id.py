"""Language ID: multinomial naive Bayes over hashed character 1- to 3-grams.

Counts are learned from a bounded sample of labelled rows: ``SAMPLE`` expected rows,
picked by a hash of id and text, an equal share for each language, and all rows of a
language that has fewer. They are added up by language and hashed n-gram and turned into
a matrix of log-probabilities that is broadcast. It has 2**16 rows of n-grams, and half
as many each time the number of languages doubles beyond 128, so that it never has more
than ``CELLS`` numbers. Texts
are scored in batches: the n-grams of many texts are hashed as one array, looked up
and summed per text.

Null text, and text without a letter, gives ``und`` with score 0. The score is the
posterior probability of the predicted language. Without any labelled row every text
is ``und``. Ties go to the language that sorts first. Whole texts are read; lang,
source and id never enter a prediction. A null id is not held out and not learned
from. Repeated rows get equal predictions, and count as often as they are there when
they are learned from, each with its own label.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from umbra.llm.common import slices

BITS = 16
DIM = 1 << BITS
SAMPLE = 20_000
CELLS = 1 << 23
FEW = 100_000  # languages whose table is broadcast
SMOOTHING = 0.5
CHUNK = 200_000


def held_out(id_col) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def height(langs: int) -> int:
    """Rows of n-grams in the matrix."""
    bits = BITS
    while bits > 1 and langs << bits > CELLS:
        bits -= 1
    return 1 << bits


def grams(texts: list[str], dim: int = DIM) -> tuple[list[np.ndarray], np.ndarray]:
    """Hashed n-grams, one array for each n, and where each text starts in them.
    N-grams that reach over the end of a text hash to ``dim``."""
    bits = dim.bit_length() - 1
    low = [t.lower() for t in texts]
    starts = np.cumsum([0] + [len(t) + 1 for t in low])[:-1]
    codes = np.frombuffer(("\0".join(low) + "\0\0\0").encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(codes) - 2
    end = codes == 0
    out, mixed, crossing = [], np.zeros(n, np.uint32), np.zeros(n, bool)
    for k, salt in enumerate((0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35)):
        mixed = (mixed ^ codes[k : n + k]) * np.uint32(salt)
        mixed ^= mixed >> np.uint32(15)
        crossing = crossing | end[k : n + k]
        index = (mixed * np.uint32(0x27D4EB2F) >> np.uint32(32 - bits)).astype(np.int32)
        index[crossing] = dim
        out.append(index)
    return out, starts


def _chunks(texts: list[str]):
    """Ranges of texts of some CHUNK characters together."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= CHUNK:
            yield first, i + 1
            first, size = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


def _counter(dim: int):
    def count(batches):
        seen: dict[str, list] = {}
        for batch in slices(batches):
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lang in set(langs):
                mine = [t for g, t in zip(langs, texts) if g == lang and has_letter(t)]
                total = seen.setdefault(lang, [np.zeros(dim + 1, np.int64), 0])
                total[1] += len(mine)
                for a, b in _chunks(mine):
                    for index in grams(mine[a:b], dim)[0]:
                        total[0] += np.bincount(index, minlength=dim + 1)
        for lang, (counts, n) in sorted(seen.items()):
            counts[dim] = n  # the last slot carries the number of texts
            at = np.flatnonzero(counts)
            yield pa.record_batch([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(counts[at], pa.int64())], names=["lang", "slot", "n"])

    return count


def fit(docs: DataFrame, sample: int = SAMPLE, id_col="doc_id", text_col="text", lang_col="lang") -> tuple[list[str], np.ndarray]:
    """Languages in order, and the (rows + 2) x languages matrix of log-probabilities;
    its last two rows are for n-grams over the end of a text, and priors."""
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    labelled = labelled.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(1 << 30)).alias("lot"))
    sizes = labelled.groupBy("lang").agg(F.count("*").alias("rows"))
    langs_n = sizes.count()
    dim = height(langs_n)
    share = F.least(F.lit(1.0), F.lit(sample / max(1, langs_n)) / F.col("rows"))
    table = sizes.select("lang", share.alias("share"))  # a row for each language, counted above
    drawn = labelled.join(F.broadcast(table) if langs_n <= FEW else table, "lang").where(F.col("lot") < F.ceil(F.col("share") * (1 << 30)))
    parts = drawn.select("lang", "text").mapInArrow(_counter(dim), "lang string, slot int, n long")
    table = parts.groupBy("lang", "slot").agg(F.sum("n").alias("n")).toArrow()  # CELLS rows at most
    names = table.column("lang").to_pylist()
    langs = sorted(set(names))
    counts = np.zeros((dim + 1, len(langs)))
    if langs:
        place = {x: i for i, x in enumerate(langs)}
        counts[table.column("slot").to_numpy(), [place[x] for x in names]] = table.column("n").to_numpy()
    texts = counts[dim].copy()
    counts[dim] = 0
    smooth = counts + SMOOTHING
    logs = np.log(smooth) - np.log(smooth[:dim].sum(axis=0))
    logs[dim] = 0
    priors = np.log((texts + 1) / (texts.sum() + max(1, len(langs))))
    return langs, np.vstack([logs, priors]).astype(np.float32)


def predict(texts: list[str | None], langs: list[str], matrix: np.ndarray) -> tuple[list[str], np.ndarray]:
    pred, score = ["und"] * len(texts), np.zeros(len(texts))
    at = [i for i, t in enumerate(texts) if has_letter(t)] if langs else []
    some = [texts[i] for i in at]
    for a, b in _chunks(some):
        indexes, starts = grams(some[a:b], len(matrix) - 2)
        sums = np.zeros((b - a, len(langs)))
        for index in indexes:
            for j in range(len(langs)):
                sums[:, j] += np.add.reduceat(matrix[:, j][index], starts, dtype=np.float64)
        sums += matrix[-1]
        best = sums.argmax(axis=1)
        odds = np.exp(sums - sums.max(axis=1, keepdims=True))
        for i, where, p in zip(at[a:b], best, odds.max(axis=1) / odds.sum(axis=1)):
            pred[i], score[i] = langs[where], p
    return pred, score


def identify(docs: DataFrame, train: DataFrame | None = None, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred and score for every row of ``docs``."""
    langs, matrix = fit(train if train is not None else docs, sample)
    shared = docs.sparkSession.sparkContext.broadcast((langs, np.asfortranarray(matrix)))

    def run(batches):
        names, logs = shared.value
        for b in slices(batches):
            pred, score = predict(b.column(2).to_pylist(), names, logs)
            yield pa.record_batch([b.column(0), b.column(1), pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out("doc_id").alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def stage(spark, docs: DataFrame, sf_dir: str, least: float = 0.5) -> DataFrame:
    """Pipeline stage: drops texts that are ``und`` or score under ``least``."""
    langs, matrix = fit(docs)
    shared = spark.sparkContext.broadcast((langs, np.asfortranarray(matrix)))
    at = docs.columns.index("text")

    def run(batches):
        names, logs = shared.value
        for b in slices(batches):
            pred, score = predict(b.column(at).to_pylist(), names, logs)
            yield b.filter(pa.array([p != "und" and s >= least for p, s in zip(pred, score)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
