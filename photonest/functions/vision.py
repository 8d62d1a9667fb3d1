"""Faces and eye states by ONNX models that the caller brings; without a model there are no faces and no states."""

from __future__ import annotations

import os
from dataclasses import dataclass
from typing import Any

import numpy as np

from photonest.functions.pixels import resize

#: Largest model file that is sent to the executors.
MODEL_BYTES = 256 << 20

# Thresholds, and where eyes sit in a face box, in shares of the box.
FACE_CONFIDENCE, OVERLAP, EYE_CONFIDENCE = 0.6, 0.4, 0.5
EYE_LINE, EYE_COLUMNS, EYE_WIDTH, EYE_HEIGHT = 0.38, (0.30, 0.70), 0.24, 0.18


@dataclass(frozen=True)
class Face:
    x: float
    y: float
    width: float
    height: float
    confidence: float


@dataclass
class Model:
    """A session with the image size it wants. ``session`` needs ``run(None, {name: tensor})`` only."""

    session: Any
    name: str
    width: int
    height: int

    @classmethod
    def of(cls, content: bytes, width: int, height: int) -> Model:
        import onnxruntime

        options = onnxruntime.SessionOptions()
        options.log_severity_level = 3
        session = onnxruntime.InferenceSession(content, options, providers=["CPUExecutionProvider"])
        wanted = session.get_inputs()[0]
        h, w = wanted.shape[2:4]
        known = isinstance(h, int) and isinstance(w, int)
        return cls(session, wanted.name, w if known else width, h if known else height)

    def __call__(self, rgb: np.ndarray, shift: float, scale: float) -> list[np.ndarray]:
        planes = np.stack([resize(rgb[..., c], self.height, self.width) for c in range(3)]).astype(np.float32)
        return self.session.run(None, {self.name: (planes[None] - np.float32(shift)) / np.float32(scale)})


def model_bytes(path: str | None) -> bytes | None:
    """The model file, if there is one. Models go to the executors, so their size is checked."""
    if path is None or not os.path.isfile(path):
        return None
    if os.path.getsize(path) > MODEL_BYTES:
        raise ValueError(f"{path} is larger than {MODEL_BYTES} bytes")
    with open(path, "rb") as f:
        return f.read()


def face_candidates(outputs: list[np.ndarray]) -> tuple[np.ndarray | None, np.ndarray | None]:
    """Corner boxes and face scores of a detector's outputs, told apart by their last dimension."""
    boxes = scores = None
    for out in map(np.asarray, outputs):
        table = out[0] if out.ndim == 3 else out
        if table.ndim != 2:
            continue
        match table.shape[1]:
            case 4:
                boxes = table
            case 2:
                # Of two logits the second is the face.
                scores = 1 / (1 + np.exp(np.clip(table[:, 0].astype(np.float64) - table[:, 1], -700, 700)))
            case 1:
                scores = table[:, 0]
    return boxes, scores


def distinct_boxes(boxes: np.ndarray, scores: np.ndarray, limit: float = OVERLAP) -> np.ndarray:
    """Indices of boxes, best first, that overlap no better kept box by more than ``limit`` of the union."""
    order = np.argsort(-scores, kind="stable")
    ranked = boxes[order].astype(np.float64)
    area = np.prod(np.clip(ranked[:, 2:] - ranked[:, :2], 0, None), axis=1)
    alive = np.ones(len(order), bool)
    for i in range(len(order)):
        if not alive[i]:
            continue
        later = ranked[i + 1 :]
        sides = np.minimum(later[:, 2:], ranked[i, 2:]) - np.maximum(later[:, :2], ranked[i, :2])
        shared = np.prod(np.clip(sides, 0, None), axis=1)
        union = area[i] + area[i + 1 :] - shared
        alive[i + 1 :] &= ~((union > 0) & (shared > limit * union))
    return order[alive]


def detect_faces(model: Model | None, rgb: np.ndarray) -> list[Face]:
    """Faces in shares of the image, best first."""
    if model is None:
        return []
    boxes, scores = face_candidates(model(rgb, 127.0, 128.0))
    if boxes is None or scores is None:
        return []
    sure = scores > FACE_CONFIDENCE
    boxes, scores = boxes[sure], scores[sure]
    inside = np.clip(boxes, 0.0, 1.0).astype(np.float64)
    kept = [i for i in distinct_boxes(boxes, scores) if (inside[i, 2:] > inside[i, :2]).all()]
    return [Face(*inside[i, :2].tolist(), *(inside[i, 2:] - inside[i, :2]).tolist(), float(scores[i])) for i in kept]


def eye_boxes(face: Face) -> list[tuple[float, float, float, float]]:
    """Left, top, right, bottom of both eyes, in shares of the image."""
    middle = face.y + EYE_LINE * face.height
    dx, dy = EYE_WIDTH * face.width / 2, EYE_HEIGHT * face.height / 2
    return [(c - dx, middle - dy, c + dx, middle + dy) for c in (face.x + share * face.width for share in EYE_COLUMNS)]


def eyes_open(model: Model | None, rgb: np.ndarray, face: Face) -> float | None:
    """How likely both eyes are open: the lesser of the two; null if neither can be judged."""
    if model is None or face.confidence < EYE_CONFIDENCE:
        return None
    size = np.array([rgb.shape[1], rgb.shape[0]] * 2)
    found = []
    for box in eye_boxes(face):
        left, top, right, bottom = (np.clip(box, 0, 1) * size).astype(int)
        if right - left >= 2 and bottom - top >= 2:
            answer = model(rgb[top:bottom, left:right], 0.0, 255.0)[0]
            found.append(float(np.clip(np.squeeze(answer), 0.0, 1.0)))
    return min(found, default=None)
