"""Raw OCR output to lines: text, box, confidence.

Output is a payload of JSON or what an engine returns: parallel arrays under one of several names, items
with a box and a text, rows of [box, text, score], lists of these, or one of these under a wrapper's name.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

# fixed values: the names that engines and their wrappers give to boxes, texts and scores
BOXES = ("boxes", "dt_polys", "rec_boxes", "polys")
TEXTS = ("txts", "texts", "rec_texts")
SCORES = ("scores", "rec_scores", "confidences")
ITEM_BOX = ("box", "bbox", "points", "poly", "dt_poly")
ITEM_TEXT = ("text", "txt", "rec_text", "label")
ITEM_SCORE = ("score", "confidence", "rec_score", "prob")
WRAPPERS = ("result", "results", "data", "ocr_result")
CORNERS = (("x0", "y0", "x1", "y1"), ("left", "top", "right", "bottom"))
MAX_TIMINGS = 16

Line = tuple[str, tuple[float, float, float, float], float]


def number(x) -> float | None:
    """S11f: the value as a float, if it can be one."""
    try:
        return float(x)
    except (TypeError, ValueError, OverflowError):
        return None


def plain(x):
    """What an engine returned, as lists and objects: arrays are listed, attributes of known names read."""
    if hasattr(x, "tolist"):
        return x.tolist()
    if isinstance(x, tuple):
        return [plain(v) for v in (x[:1] if _timed(x) else x)]
    if isinstance(x, list):
        return [plain(v) for v in x]
    if isinstance(x, dict):
        return {k: plain(v) for k, v in x.items()}
    names = BOXES + TEXTS + SCORES + ITEM_BOX + ITEM_TEXT + ITEM_SCORE
    held = {n: plain(getattr(x, n)) for n in names if not isinstance(x, (str, bytes)) and hasattr(x, n)}
    return held or x


def _timed(x: tuple) -> bool:
    """(rows, timing), where timing is nothing, a number, an object or a few numbers."""
    if len(x) != 2:
        return False
    t = plain(x[1])
    return t is None or isinstance(t, (int, float, dict)) or (
        isinstance(t, list) and len(t) <= MAX_TIMINGS and all(v is None or number(v) is not None for v in t)
    )


def confidence(x) -> float:
    """S11e: percents become shares, the rest is held within [0, 1]; nothing finite is 0."""
    v = number(x)
    if v is None or not math.isfinite(v):
        return 0.0
    return min(1.0, max(0.0, v / 100 if 1 < v <= 100 else v))


def box(raw) -> tuple[float, float, float, float] | None:
    """S11d: an object, four numbers, points, or a flat list of coordinates."""
    if isinstance(raw, dict):
        raw = next(([raw[n] for n in names] for names in CORNERS if all(n in raw for n in names)), None)
    if not isinstance(raw, list) or len(raw) < 4:
        return None
    flat = [number(v) for v in raw]
    if None not in flat:
        if len(flat) != 4 and (len(flat) < 8 or len(flat) % 2):
            return None
        xs, ys = flat[::2], flat[1::2]
    elif all(isinstance(p, list) and len(p) >= 2 for p in raw):
        xs, ys = ([number(p[i]) for p in raw] for i in (0, 1))
    else:
        return None
    if any(v is None or not math.isfinite(v) for v in [*xs, *ys]):
        return None
    return min(xs), min(ys), max(xs), max(ys)


def _line(raw_box, text, score) -> Line | None:
    b, text = box(raw_box), "" if text is None else str(text).strip()
    return (text, b, confidence(score)) if b and text else None


def _named(x: dict, names):
    return next((x[n] for n in names if n in x), None)


def _listed(x) -> list:
    return [] if x is None else x if isinstance(x, list) else [x]


def _item(x) -> Line | None:
    """One line, as an object or a row."""
    if isinstance(x, dict):
        return _line(*(_named(x, names) for names in (ITEM_BOX, ITEM_TEXT, ITEM_SCORE)))
    if isinstance(x, list) and len(x) >= 2 and isinstance(x[1], str):
        return _line(x[0], x[1], x[2] if len(x) > 2 else 0)
    return None


def lines(payload) -> list[Line]:
    """All lines of one output, in its order. Rows without a text or a finite box are left out."""
    payload = plain(payload)
    if isinstance(payload, dict) and any(n in payload for n in BOXES) and any(n in payload for n in TEXTS):
        boxes, texts, scores = (_listed(_named(payload, names)) for names in (BOXES, TEXTS, SCORES))
        scores = scores + [0] * len(texts)  # S11b
        return [x for x in map(_line, boxes, texts, scores) if x]
    own = _item(payload)
    if own:
        return [own]
    if isinstance(payload, dict):
        inner = next((n for n in WRAPPERS if n in payload), None)
        return lines(payload[inner]) if inner else []
    if not isinstance(payload, list):
        return []
    return [x for item in payload for x in ([_item(item)] if _item(item) else lines(item))]


def normalize(raw: DataFrame) -> DataFrame:
    """raw: doc, page, payload. Returns doc, page, pos, text, bbox, confidence."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for d, p, text in zip(pdf["doc"], pdf["page"], pdf["payload"]):
                for i, (t, b, c) in enumerate(lines(json.loads(text) if text else None)):
                    rows.append((d, p, i, t, dict(zip(("x0", "y0", "x1", "y1"), b)), c))
            yield pd.DataFrame(rows, columns=["doc", "page", "pos", "text", "bbox", "confidence"])

    return raw.select("doc", "page", "payload").mapInPandas(
        run, "doc string, page int, pos int, text string, bbox struct<x0:double,y0:double,x1:double,y1:double>, confidence double"
    )
