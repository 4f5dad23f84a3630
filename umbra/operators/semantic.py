"""Search of pictures and videos by phrase: embedding, indexes, calibrated scores.

An embedder is any object with ``images(list of arrays)`` and ``texts(list of phrases)``
that give vectors. An index is a table of ``INDEX`` rows, one for each picture or sampled
video frame; it is built by ``mapInPandas`` and kept as Parquet.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LOGIT_SCALE = 100.0
# The prompts against which a phrase has to stand.
BACKGROUND_PROMPTS = ("a photo", "a screenshot", "random noise", "a blank image", "a document", "an abstract pattern")
INDEX = "ord long, path string, media_type string, frame int, time double, embedding array<float>"


class SemanticError(RuntimeError):
    """Search can't run: no model, or media that can't be read."""


class ClipEmbedder:
    """The public CLIP weights by ``open_clip``; loaded once in each worker."""

    def __init__(self, model: str = "ViT-B-32", weights: str = "openai"):
        self.model, self.weights, self._loaded = model, weights, None

    def __getstate__(self):
        return self.__dict__ | {"_loaded": None}

    @staticmethod
    def missing() -> list[str]:
        import importlib.util

        return [x for x in ("torch", "open_clip") if importlib.util.find_spec(x) is None]

    def _clip(self):
        if self.missing():
            raise SemanticError(f"missing {', '.join(self.missing())}")
        if self._loaded is None:
            import open_clip

            model, _, prepare = open_clip.create_model_and_transforms(self.model, pretrained=self.weights)
            self._loaded = model.eval(), prepare, open_clip.get_tokenizer(self.model)
        return self._loaded

    def images(self, pictures) -> list[list[float]]:
        import torch
        from PIL import Image

        model, prepare, _ = self._clip()
        with torch.no_grad():
            return model.encode_image(torch.stack([prepare(Image.fromarray(p)) for p in pictures])).tolist()

    def texts(self, phrases) -> list[list[float]]:
        import torch

        model, _, tokens = self._clip()
        with torch.no_grad():
            return model.encode_text(tokens(list(phrases))).tolist()


def build_index(docs: DataFrame, embedder, codec=None, frames: int = 8) -> DataFrame:
    """``INDEX`` rows of the visual ones among ``docs(path, media_type, content)``. What
    can't be read has no row and ends nothing; ``frames`` are sampled evenly from a video."""
    from umbra.operators import vision

    codec = codec or vision.Codec()

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for nth, path, kind, raw in pdf[["ord", "path", "media_type", "content"]].itertuples(index=False):
                try:
                    if kind == "image":
                        found = [(None, None, codec.picture(bytes(raw)))]
                    else:
                        pictures, fps = codec.frames(bytes(raw), path)
                        found = sampled(pictures, frames, fps)
                    if found:
                        vectors = embedder.images([p for *_, p in found])
                        rows += [(nth * 100_000 + i, path, kind, f, t, [float(x) for x in v]) for i, ((f, t, _), v) in enumerate(zip(found, vectors))]
                except SemanticError:
                    raise
                except Exception:
                    continue
            yield pd.DataFrame(rows, columns=["ord", "path", "media_type", "frame", "time", "embedding"]).astype({"frame": "Int32"})

    visual = docs.where(F.col("media_type").isin("image", "video")).select(F.monotonically_increasing_id().alias("ord"), "path", "media_type", "content")
    return visual.mapInPandas(run, INDEX)


def sampled(pictures, count: int, fps: float) -> list[tuple]:
    """(frame, seconds, picture) of every n-th frame such that ``count`` at most remain;
    one pass, and never more than twice ``count`` pictures are held."""
    held, step = [], 1
    for n, picture in enumerate(pictures):
        if n % step == 0:
            held.append((n, n / fps if fps > 0 else None, picture))
            if len(held) >= 2 * count:
                step *= 2
                held = [x for x in held if x[0] % step == 0]
    return held[:: -(-len(held) // count)] if len(held) > count else held


def save_index(index: DataFrame, folder: str) -> None:
    index.write.mode("overwrite").parquet(folder)


def load_index(spark, folder: str) -> DataFrame:
    """Raises ``SemanticError`` where there is no index."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(INDEX).parquet(folder)
    except AnalysisException as e:
        raise SemanticError(f"no index at {folder}") from e


def index_summary(index: DataFrame) -> DataFrame:
    """Embedded frames and distinct files of an index: one row."""
    return index.agg(F.count("*").alias("frames"), F.count_distinct("path").alias("files"))


def search_phrase(index: DataFrame, phrase: str, embedder, top_k: int | None = 10, threshold: float = 0.0, per_file: bool = True, calibrate: bool = True) -> DataFrame:
    vectors = embedder.texts([phrase, *BACKGROUND_PROMPTS] if calibrate else [phrase])
    return search(index, vectors[0], vectors[1:] or None, top_k, threshold, "path" if per_file else None, "ord")


def describe(hit: Column | None = None) -> Column:
    """One line of a hit: score, file, and the place in a video."""
    at = F.when(F.col("time").isNotNull(), F.format_string(" @ %.1fs (frame %d)", F.col("time"), F.col("frame"))).otherwise("")
    return F.concat(F.format_string("%+.4f  ", F.col("score")), F.col("path"), at)


def unit(vector: list[float]) -> list[float]:
    norm = max(math.sqrt(sum(x * x for x in vector)), 1e-12)
    return [x / norm for x in vector]


def normalised(vector: Column) -> Column:
    v = vector.cast("array<double>")
    norm = F.greatest(F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)), F.lit(1e-12))
    return F.transform(v, lambda x: x / norm)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def score(index: DataFrame, query: list[float], background: list[list[float]] | None = None, vector: str = "embedding") -> DataFrame:
    """``index`` with ``score``: the cosine, or with background vectors the query's
    softmax share among them. The vectors are literals of fixed size; scores are a
    narrow projection."""
    literal = lambda v: F.array(*map(F.lit, unit(v)))
    rows = index.withColumn("__v", normalised(F.col(vector)))
    own = dot(F.col("__v"), literal(query))
    if not background:
        return rows.withColumn("score", own).drop("__v")
    rows = rows.withColumn("__s", F.array(own, *[dot(F.col("__v"), literal(b)) for b in background]))
    top = F.array_max("__s")
    share = F.exp(LOGIT_SCALE * (F.get("__s", F.lit(0)) - top)) / F.aggregate("__s", F.lit(0.0), lambda a, x: a + F.exp(LOGIT_SCALE * (x - top)))
    return rows.withColumn("score", share).drop("__v", "__s")


def search(index: DataFrame, query: list[float], background=None, top_k: int | None = 10, threshold: float = 0.0, file_col: str | None = None, order_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Rows of at least ``threshold``, the best one of each file if ``file_col`` is
    given (the first on ties), by score and order; a top k never sorts everything."""
    rows = score(index, query, background, vector).where(F.col("score") >= threshold)
    if file_col:
        # max_by has a map-side combine; ties go to the smallest order
        best = F.max_by(F.struct(*rows.columns), F.struct(F.col("score"), -F.col(order_col)))
        rows = rows.groupBy(F.col(file_col).alias("__f")).agg(best.alias("b")).select("b.*")
    rows = rows.orderBy(F.desc("score"), order_col)
    return rows.limit(top_k) if top_k is not None else rows


def filter_documents(docs: DataFrame, hits: DataFrame, key: str = "path") -> DataFrame:
    """Visual documents only if they were found; all others pass."""
    visual = F.col("media_type").isin("image", "video")
    return docs.where(~visual).unionByName(docs.where(visual).join(hits.select(key), key, "left_semi"))


def frame_sample(total: Column, count: int) -> Column:
    """Indexes of the frames that stand for a video."""
    step = F.greatest(F.lit(1), F.floor(total / count))
    return F.when(total > 0, F.slice(F.sequence(F.lit(0).cast("long"), total.cast("long") - 1, step.cast("long")), 1, count)).otherwise(F.array().cast("array<long>"))
