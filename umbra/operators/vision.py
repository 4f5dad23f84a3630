"""Pictures and videos: codecs, masks over frames, and backends that use them.

A codec turns bytes to frames and back and is injected, as are detectors; the public
libraries are only loaded by the defaults. Videos are worked off frame by frame, so that
never more than the tracker's open frames are held.
"""

from __future__ import annotations

import json
import os
import shutil
import subprocess
import tempfile
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np

from umbra.operators.backends import STRATEGIES, Backend, Command, Detector, Pixels, class_filter, entity_label, mask_regions, tracking_options
from umbra.operators.tracker import Tracker
from umbra.sources.containers import Outcome

FPS = 30.0


# -- ffmpeg ------------------------------------------------------------------------------
def runs(program: str) -> bool:
    """Whether a program starts; one that is found may still lack its libraries."""
    try:
        return subprocess.run([program, "-version"], stdout=subprocess.DEVNULL, stderr=subprocess.DEVNULL, timeout=15).returncode == 0
    except (OSError, subprocess.SubprocessError):
        return False


@lru_cache(maxsize=1)
def ffmpeg() -> str | None:
    """The system's ffmpeg if it works, else the one that imageio brings, else None."""
    for place in (lambda: shutil.which("ffmpeg"), _bundled):
        try:
            program = place()
        except Exception:
            program = None
        if program and runs(program):
            return program
    return None


def _bundled() -> str:
    import imageio_ffmpeg

    return imageio_ffmpeg.get_ffmpeg_exe()


def with_audio(silent: bytes, original: bytes, suffix: str, program: str | None = None) -> bytes | None:
    """``silent`` with the sound of ``original``; None without ffmpeg or without sound,
    so that a caller keeps the silent one."""
    program = program or ffmpeg()
    if program is None:
        return None
    with tempfile.TemporaryDirectory() as d:  # of one executor, for one file
        for name, data in (("video", silent), ("source", original)):
            with open(f"{d}/{name}{suffix}", "wb") as f:
                f.write(data)
        command = [program, "-y", "-v", "error", "-i", f"{d}/video{suffix}", "-i", f"{d}/source{suffix}", "-map", "0:v:0", "-map", "1:a:0", "-c:v", "copy", "-c:a", "copy", "-shortest", f"{d}/out{suffix}"]
        done = subprocess.run(command, capture_output=True)
        if done.returncode or not os.path.exists(f"{d}/out{suffix}"):
            return None
        with open(f"{d}/out{suffix}", "rb") as f:
            return f.read() or None


class Codec:
    """Bytes to pixels and back by PIL and imageio."""

    def picture(self, raw: bytes) -> np.ndarray:
        return Pixels._load(raw)

    def frames(self, raw: bytes, path: str) -> tuple[Iterator[np.ndarray], float]:
        """The frames of a video, one at a time, and its rate."""
        import imageio.v2 as iio

        reader = iio.get_reader(raw, format=os.path.splitext(path)[1])
        try:
            fps = float(reader.get_meta_data().get("fps") or FPS)
        except Exception:
            fps = FPS
        return iter(reader), fps

    def video(self, frames: Iterable[np.ndarray], fps: float, path: str, original: bytes) -> bytes:
        import imageio.v2 as iio

        suffix = os.path.splitext(path)[1]
        with tempfile.TemporaryDirectory() as d:
            with iio.get_writer(f"{d}/out{suffix}", fps=fps) as writer:
                for frame in frames:
                    writer.append_data(frame)
            with open(f"{d}/out{suffix}", "rb") as f:
                silent = f.read()
        return with_audio(silent, original, suffix) or silent


# -- masks over time ---------------------------------------------------------------------
def masked_frames(frames: Iterable[np.ndarray], find: Callable, strategy: str, tracker: Tracker | None = None, found: list | None = None) -> Iterator[np.ndarray]:
    """Frames with what ``find`` sees in them masked; with a tracker, masks stay over
    frames in which an object is missed, and frames come ``max_gap`` late."""
    waiting: dict[int, np.ndarray] = {}

    def done(settled):
        for at, masks in settled:
            yield mask_regions(waiting.pop(at), [m[:4] for m in masks], strategy)

    for n, frame in enumerate(frames):
        boxes = find(frame)
        if found is not None:
            found += boxes
        if tracker is None:
            yield mask_regions(frame, [b[:4] for b in boxes], strategy)
            continue
        waiting[n] = frame
        yield from done(tracker.push(n, boxes))
    if tracker is not None:
        yield from done(tracker.flush())


def decoded(codec: Codec, content: bytes | None, path: str, expected: int, gaps: list[dict]) -> dict:
    """The record of a rendered video, read again from its bytes: what ``video_status``
    judges."""
    record = {"output": path, "exists": content is not None, "size_bytes": len(content or b""), "expected_frames": expected, "frames_decoded": 0, "decode_error": None, "unresolved_gaps": gaps}
    try:
        frames, _ = codec.frames(content or b"", path)
        record["frames_decoded"] = sum(1 for _ in frames)
    except Exception as e:
        record["decode_error"] = f"{type(e).__name__}: {e}"
    errors = []
    if not record["size_bytes"]:
        errors.append("output file is empty")
    if record["decode_error"]:
        errors.append(f"decode failed: {record['decode_error']}")
    elif record["frames_decoded"] <= 0:
        errors.append("decoded zero frames")
    if expected >= 0 and record["frames_decoded"] != expected:
        errors.append(f"frame count mismatch: decoded {record['frames_decoded']}, expected {expected}")
    warnings = [f"possible masked->exposed->masked sequence: {g['label']} unmasked frames {g['first_frame']}-{g['last_frame']}" for g in gaps]
    status = "failed" if errors else "passed_with_warnings" if warnings else "passed"
    return record | {"errors": errors, "warnings": warnings, "verification_status": status}


# -- backends ----------------------------------------------------------------------------
class Visual(Backend):
    """Pictures and videos in which ``find`` (a detector of pixels, made once in each
    worker by ``factory``) sees (x1, y1, x2, y2, score, label) boxes. ``tracked`` keeps
    masks over missed frames of a video and verifies what was rendered."""

    media_types = ("image", "video")

    def __init__(self, name: str, factory: Callable[[dict], Callable], priority: int, needs=(), description: str = "", label: str | None = None, tracked: bool = False, codec: Codec | None = None, store=None):
        self.name, self.factory, self.priority, self.needs, self.description = name, factory, priority, tuple(needs), description
        self.label, self.tracked, self.codec, self.store = label, tracked, codec or Codec(), store or Pixels._store
        self._finders: dict[str, Callable] = {}

    def __getstate__(self):
        return self.__dict__ | {"_finders": {}}

    def _find(self, settings, extra: dict):
        key = json.dumps(extra, sort_keys=True, default=str)
        if key not in self._finders:
            self._finders[key] = self.factory(extra)
        model, wanted = self._finders[key], set(settings.entities or ())
        name = lambda b: entity_label(self.label or b[5])
        return lambda pixels: [(*b[:5], name(b)) for b in model(pixels) if b[4] >= settings.threshold and (not wanted or name(b) in wanted)]

    def rewrite(self, path, kind, raw, settings, write=True):
        extra = dict(getattr(settings, "extra", None) or {})
        if not write:  # a dry run doesn't detect
            return Outcome(notes=[f"would run {self.name}"])
        if self.label and settings.entities is not None and entity_label(self.label) not in settings.entities:
            return Outcome(notes=[f"{self.name}: {entity_label(self.label)} is not among the entities asked for"], content=raw)
        find, strategy = self._find(settings, extra), STRATEGIES[settings.mode]
        if kind == "image":
            pixels = self.codec.picture(raw)
            boxes = find(pixels)
            content = self.store(mask_regions(pixels, [b[:4] for b in boxes], strategy), os.path.splitext(path)[1])
            return Outcome(_entities(boxes), content=content, notes=["text in the picture was not examined (no OCR)"])
        frames, fps = self.codec.frames(raw, path)
        tracker, boxes, count = Tracker(**tracking_options(extra)) if self.tracked else None, [], 0

        def counted():
            nonlocal count
            for frame in masked_frames(frames, find, strategy, tracker, boxes):
                count += 1
                yield frame

        content = self.codec.video(counted(), fps, path, raw)
        out = Outcome(_entities(boxes), content=content)
        if tracker is not None:
            report = decoded(self.codec, content, path, count, tracker.stats()["unresolved_gaps"]) | {"tracking": tracker.stats()}
            out.sidecar = json.dumps(report, indent=2, sort_keys=True)
            out.notes += [*report["errors"], *report["warnings"]]
            if report["errors"]:
                raise RuntimeError("; ".join(report["errors"]))
        return out


def _entities(boxes) -> list[tuple]:
    """One entity for each label, with the best score: the same thing is seen in many
    frames."""
    best: dict[str, float] = {}
    for b in boxes:
        best[b[5]] = max(float(b[4]), best.get(b[5], 0.0))
    return [(label, None, None, score, None) for label, score in sorted(best.items())]


def deface(codec: Codec | None = None, factory=None) -> Visual:
    """Faces, by the public ``deface`` package."""

    def centerface(extra):
        from deface.centerface import CenterFace

        model = CenterFace()
        return lambda pixels: [(*d[:4], float(d[4]), "face") for d in model(pixels, threshold=0.2)[0]]

    return Visual("deface", factory or centerface, 70, ("deface", "imageio"), "faces", label="face", codec=codec)


def yolo(codec: Codec | None = None, factory=None) -> Visual:
    """Objects by prompts or by the classes of a closed model, by ``ultralytics``;
    ``extra`` may name ``yolo_model``, ``yolo_classes``, ``temporal_gap`` and
    ``gap_report_window``."""

    def ultralytics(extra):
        from ultralytics import YOLO

        model = YOLO(extra.get("yolo_model") or "yolov8s-worldv2.pt")
        prompts = extra.get("yolo_classes") or ["license plate", "human face"]
        if hasattr(model, "set_classes") and "world" in str(extra.get("yolo_model") or "world"):
            model.set_classes(prompts)
            wanted = None
        else:
            wanted = set(class_filter(prompts, None, list(model.names.values())))

        def find(pixels):
            result = model.predict(pixels[..., ::-1], verbose=False)[0]
            rows = zip(result.boxes.xyxy.tolist(), result.boxes.conf.tolist(), result.boxes.cls.tolist())
            return [(*box, score, model.names[int(c)]) for box, score, c in rows if wanted is None or model.names[int(c)] in wanted]

        return find

    return Visual("yolo", factory or ultralytics, 65, ("ultralytics", "cv2"), "objects by prompts, tracked in video", tracked=True, codec=codec)


def anonymizer(command: list[str] | None = None) -> Command:
    """Faces and plates, by an external program."""
    return Command("anonymizer", ("image", "video"), 60, command or ["anonymizer", "--input", "{in}", "--output", "{out}"])


def presidio(language: str = "en", factory=None) -> Detector:
    """Named entities by ``presidio_analyzer``, joined with the recognizers."""

    def analyzer():
        from presidio_analyzer import AnalyzerEngine

        engine = AnalyzerEngine()
        return lambda text: [(r.entity_type, r.start, r.end, float(r.score), text[r.start : r.end]) for r in engine.analyze(text=text, language=language)]

    return Detector("presidio", factory or analyzer, ("presidio_analyzer",), 80)


class Ocr(Backend):
    """Text in pictures, covered where it holds an entity. ``read`` gives (box, text,
    score) lines of pixels (by ``rapidocr_onnxruntime`` where nothing is given)."""

    name, media_types, priority, description = "ocr", ("image",), 30, "text in pixels"

    def __init__(self, read: Callable | None = None, codec: Codec | None = None, store=None, least: float = 0.5):
        self.read, self.codec, self.store, self.least = read, codec or Codec(), store or Pixels._store, least
        self.needs = () if read else ("rapidocr_onnxruntime", "PIL")
        self._engine = None

    def __getstate__(self):
        return self.__dict__ | {"_engine": None}

    def _lines(self, pixels):
        if self.read:
            return self.read(pixels)
        if self._engine is None:
            from rapidocr_onnxruntime import RapidOCR

            self._engine = RapidOCR()
        found, _ = self._engine(pixels)
        corners = lambda quad: (min(x for x, _ in quad), min(y for _, y in quad), max(x for x, _ in quad), max(y for _, y in quad))
        return [(corners(quad), text, float(score)) for quad, text, score in found or []]

    def rewrite(self, path, kind, raw, settings, write=True):
        import re

        pixels, covered, out = self.codec.picture(raw), [], Outcome()
        for box, text, score in self._lines(pixels):
            if score < self.least:
                continue
            apart = re.sub(r"(?<=[A-Za-z])(?=\d)|(?<=\d)(?=[A-Za-z])", " ", text)
            hits = {(e[0], e[4]): e for t in (text, apart) for e in settings.find(t)}
            if hits:
                covered.append(box)
                out.entities += [(label, None, None, e[3], value) for (label, value), e in hits.items()]
        if write:
            out.content = self.store(mask_regions(pixels, covered, "blur" if settings.mode == "blur" else "solid"), os.path.splitext(path)[1])
        return out


class Flatten(Command):
    """PDF pages as pictures, by an external program that writes ``<stem>-final.pdf``
    beside its input; that is what comes back."""

    description = "flattens pages to images"

    def __init__(self, command: list[str] | None = None, name: str | None = None):
        from umbra.operators import routing

        name = name or routing.FLATTEN
        super().__init__(name, ("pdf",), 40, command or [name, "--sanitize", "{in}"])

    def rewrite(self, path, kind, raw, settings, write=True):
        if not write:
            return Outcome(notes=[f"would run {self.name}"])
        with tempfile.TemporaryDirectory() as d:  # of one executor, for one file
            with open(f"{d}/in.pdf", "wb") as f:
                f.write(raw)
            done = subprocess.run([x.replace("{in}", f"{d}/in.pdf") for x in self.command], cwd=d, capture_output=True, timeout=self.timeout)
            if done.returncode or not os.path.exists(f"{d}/in-final.pdf"):
                raise RuntimeError(f"{self.name} failed: {done.stderr.decode('utf-8', 'replace')[-200:]}")
            with open(f"{d}/in-final.pdf", "rb") as f:
                return Outcome(content=f.read(), notes=["pages are pictures now; nothing was detected"])
