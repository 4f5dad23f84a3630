import io
import json
import sys

import numpy as np
import pytest
from pyspark import cloudpickle

from umbra.functions import spans
from umbra.operators import backends, semantic, verify, vision
from umbra.sources.containers import Settings

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import tests


class Npy(vision.Codec):
    """Videos and pictures as .npy bytes."""

    def picture(self, raw):
        return np.load(io.BytesIO(raw))

    def frames(self, raw, path):
        return iter(np.load(io.BytesIO(raw))), 10.0

    def video(self, frames, fps, path, original):
        return npy(np.stack(list(frames)))


def npy(array):
    out = io.BytesIO()
    np.save(out, array)
    return out.getvalue()


def spot(x, size=8, side=40):
    frame = np.full((side, side, 3), 10, np.uint8)
    if x is not None:
        frame[5 : 5 + size, x : x + size] = 200
    return frame


def bright(extra):
    def find(pixels):
        ys, xs = np.nonzero(pixels[..., 0] > 150)
        return [(xs.min(), ys.min(), xs.max() + 1, ys.max() + 1, 0.9, "human face")] if len(xs) else []

    return find


def test_a_missed_frame_of_a_video_stays_masked():
    # in frame 2 the detector is blind to the spot, which is dimmed
    frames = [spot(x) for x in (4, 6, 8, 10)]
    frames[2] = np.where(frames[2] > 150, 120, frames[2]).astype(np.uint8)
    both = [vision.yolo(Npy(), bright), vision.deface(Npy(), bright)]
    out = [b.rewrite("v.mp4", "video", npy(np.stack(frames)), Settings(mode=spans.REMOVE)) for b in both]
    tracked, loose = (np.load(io.BytesIO(o.content)) for o in out)
    assert tracked.shape == (4, 40, 40, 3) and (tracked[:, 5:13, 4:18] != 200).all()
    assert not (tracked[2] == 120).any() and (loose[2] == 120).any()
    report = json.loads(out[0].sidecar)
    assert report["frames_decoded"] == 4 and report["verification_status"] == "passed" and report["tracking"]["interpolated_masks"] == 1
    assert out[0].entities == [("HUMAN_FACE", None, None, 0.9, None)] and out[1].entities == [("FACE", None, None, 0.9, None)] and out[1].sidecar is None


def test_a_render_that_loses_frames_fails():
    class Lossy(Npy):
        def video(self, frames, fps, path, original):
            return npy(np.stack(list(frames)[:-1]))

    with pytest.raises(RuntimeError, match="frame count mismatch"):
        vision.yolo(Lossy(), bright).rewrite("v.mp4", "video", npy(np.stack([spot(3)] * 5)), Settings())


def test_a_long_absence_is_reported():
    frames = [spot(4), *[spot(None)] * 6, spot(6)]
    out = vision.yolo(Npy(), bright).rewrite("v.mp4", "video", npy(np.stack(frames)), Settings())
    assert json.loads(out.sidecar)["verification_status"] == "passed_with_warnings" and "unmasked frames 3-6" in out.notes[0]


def test_pictures_filters_and_dry_runs():
    b = vision.deface(Npy(), bright)
    b.store = lambda pixels, suffix: npy(pixels)
    out = b.rewrite("a.png", "image", npy(spot(4)), Settings(mode="mask"))
    assert not (np.load(io.BytesIO(out.content)) == 200).all() and "not examined" in out.notes[0]
    assert b.rewrite("a.png", "image", npy(spot(4)), Settings(entities=("US_SSN",))).entities == []
    assert b.rewrite("a.png", "image", b"", Settings(), write=False).content is None


def test_text_in_a_picture_is_covered():
    ocr = vision.Ocr(lambda pixels: [((0, 0, 20, 10), "SSN123-45-6789", 0.9), ((0, 20, 20, 30), "calm", 0.9), ((20, 20, 40, 30), "a@b.com", 0.2)], Npy(), lambda pixels, suffix: npy(pixels))
    out = ocr.rewrite("a.png", "image", npy(np.full((40, 40, 3), 99, np.uint8)), Settings())
    pixels = np.load(io.BytesIO(out.content))
    assert [e[0] for e in out.entities] == ["US_SSN"] and (pixels[:10, :20] == 0).all() and (pixels[20:] == 99).all() and ocr.available()


def test_programs_and_libraries_that_are_not_there(tmp_path):
    assert not vision.runs("no-such-program") and vision.with_audio(b"a", b"b", ".mp4", program="false") is None
    r = backends.Registry.with_defaults()
    assert len(r.names()) == 10 and [b.name for b in r.available()] == ["builtin"]
    with pytest.raises(backends.RoutingError, match="not available: missing ultralytics"):
        r.select("a.png", "image", "yolo")
    with pytest.raises(backends.RoutingError, match="install one and retry"):
        r.select("a.png", "image")
    with pytest.raises(backends.RoutingError, match="Known: anonymizer, builtin"):
        r.select("a.png", "image", "x")
    flat = vision.Flatten(["sh", "-c", "cp {in} $(dirname {in})/in-final.pdf"])
    assert flat.rewrite("a.pdf", "pdf", b"%PDF", Settings()).content == b"%PDF"


class Colours:
    """Vectors by mean colour; phrases by name."""

    def images(self, pictures):
        return [[float(p[..., i].mean()) for i in range(3)] for p in pictures]

    def texts(self, phrases):
        return [{"red": [1.0, 0.0, 0.0], "green": [0.0, 1.0, 0.0]}.get(p, [0.0, 0.0, 1.0]) for p in phrases]


def test_an_index_is_built_kept_and_searched(spark, tmp_path):
    red, green = (np.zeros((4, 4, 3), np.uint8) for _ in range(2))
    red[..., 0], green[..., 1] = 200, 200
    rows = [("r.png", "image", bytearray(npy(red))), ("v.mp4", "video", bytearray(npy(np.stack([red] * 3 + [green] * 30)))), ("x.png", "image", bytearray(b"broken")), ("t.txt", "text", bytearray(b"red"))]
    docs = spark.createDataFrame(rows, "path string, media_type string, content binary")
    embedder = Colours()
    index = semantic.build_index(docs, embedder, Npy(), frames=8)
    semantic.save_index(index, str(tmp_path / "index"))
    index = semantic.load_index(spark, str(tmp_path / "index"))
    assert tuple(semantic.index_summary(index).first()) == (6, 2)
    hits = semantic.search_phrase(index, "red", embedder).collect()
    assert [r.path for r in hits][:1] == ["r.png"] and hits[0].score > 0.99 and len(hits) == 2
    assert semantic.search_phrase(index, "green", embedder, threshold=0.5).select(semantic.describe().alias("d")).first().d.startswith("+1.0000  v.mp4 @ ")
    assert semantic.search_phrase(index, "green", embedder, top_k=None, threshold=0.9, per_file=False, calibrate=False).count() == 4
    with pytest.raises(semantic.SemanticError):
        semantic.load_index(spark, str(tmp_path / "none"))


@pytest.mark.parametrize("n,count", [(0, 8), (1, 8), (8, 8), (9, 8), (100, 8), (1000, 3)])
def test_sampled_frames_are_even_and_few(n, count):
    got = semantic.sampled(iter(range(n)), count, 10.0)
    assert len(got) <= count and (n == 0 or got[0][0] == 0) and len(got) >= min(n, count) / 2
    steps = {b[0] - a[0] for a, b in zip(got, got[1:])}
    assert len(steps) <= 1 and all(t == f / 10 and p == f for f, t, p in got)


def test_odd_records_of_videos_only_warn(spark):
    gap = "array<struct<label:string,first_frame:int,last_frame:int>>"
    rows = [("a", True, 9, None, 3, None, [("FACE", 1, None)]), ("b", True, 9, 3, None, None, []), ("c", False, 0, 3, 3, None, [])]
    got = verify.video_status(spark.createDataFrame(rows, f"output string, exists boolean, size_bytes int, expected_frames int, frames_decoded int, decode_error string, unresolved_gaps {gap}")).collect()
    assert {r.output: r.verification_status for r in got} == {"a": "passed_with_warnings", "b": "passed_with_warnings", "c": "failed"}
