"""What a page's pixels show: red stamps and ruled tables (S9, S10). One page a call, arrays only."""

from __future__ import annotations

import numpy as np

# fixed values: what counts as a stamp or a table, as shares of the page
STAMP = {
    "red": 145, "over_green": 45, "over_blue": 40, "least": 35, "least_share": 0.00004, "side": 7, "max_side": 0.48,
    "max_area": 0.18, "density": 0.035
}
TABLE = {"dark": 205, "across": 24, "down": 36, "line": 20, "width": (0.35, 0.96), "height": (0.06, 0.75), "density": 0.015}


def _points(x0, y0, x1, y1, image: np.ndarray, width: float, height: float) -> dict[str, float]:
    sx, sy = width / image.shape[1], height / image.shape[0]
    return {"x0": x0 * sx, "y0": y0 * sy, "x1": x1 * sx, "y1": y1 * sy}


def red_stamp(image: np.ndarray, width: float, height: float) -> dict | None:
    """Bbox, confidence and density of the page's red ink, if it is compact."""
    r, g, b = (image[..., i].astype(np.int16) for i in range(3))
    mask = (r >= STAMP["red"]) & (r - g >= STAMP["over_green"]) & (r - b >= STAMP["over_blue"])
    ys, xs = np.nonzero(mask)
    h, w = mask.shape
    if len(xs) < max(STAMP["least"], int(w * h * STAMP["least_share"])):
        return None
    x0, y0, x1, y1 = int(xs.min()), int(ys.min()), int(xs.max()) + 1, int(ys.max()) + 1
    area = (x1 - x0) * (y1 - y0)
    density = len(xs) / area
    small = min(x1 - x0, y1 - y0) < STAMP["side"]
    large = x1 - x0 > w * STAMP["max_side"] or y1 - y0 > h * STAMP["max_side"] or area > w * h * STAMP["max_area"]
    if small or large or density < STAMP["density"]:
        return None
    return {
        "bbox": _points(x0, y0, x1, y1, image, width, height), "confidence": min(0.98, 0.65 + density * 0.5), "density": density
    }


def _window(mask: np.ndarray, n: int, before: int, every: bool) -> np.ndarray:
    """Whether all (or any) of the n places from ``before`` to the left on are set; places outside
    the image don't count."""
    size = mask.shape[1]
    total = np.concatenate((np.zeros((mask.shape[0], 1), np.int64), np.cumsum(mask, axis=1)), axis=1)
    begin, end = np.clip(np.arange(size) - before, 0, size), np.clip(np.arange(size) - before + n, 0, size)
    held = total[:, end] - total[:, begin]
    return held == end - begin if every else held > 0


def long_runs(mask: np.ndarray, n: int) -> np.ndarray:
    """A morphological opening by a horizontal line of n pixels, anchored at its middle."""
    return _window(_window(mask, n, n // 2, True), n, n // 2, False)


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """row, first and last column of each horizontal run."""
    edge = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    rows, first = np.nonzero(edge == 1)
    return rows, first, np.nonzero(edge == -1)[1] - 1


def labelled(mask: np.ndarray, diagonal: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The runs (row, first, last) and the component of each, by joining runs of neighbouring rows."""
    rows, first, last = _runs(mask)
    parent = list(range(len(rows)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    reach, starts = int(diagonal), np.searchsorted(rows, np.arange(mask.shape[0] + 1))
    for y in range(1, mask.shape[0]):
        i, j = int(starts[y - 1]), int(starts[y])
        while i < starts[y] and j < starts[y + 1]:
            if first[i] <= last[j] + reach and first[j] <= last[i] + reach:
                parent[root(i)] = root(j)
            if last[i] < last[j]:
                i += 1
            else:
                j += 1
    return rows, first, last, np.array([root(i) for i in range(len(rows))], np.int64)


def outer_boxes(mask: np.ndarray) -> list[tuple[int, int, int, int]]:
    """x0, y0, x1, y1 of each 8-connected component that isn't enclosed by another."""
    padded = np.pad(mask, 1)
    rows, first, last, own = labelled(~padded, diagonal=False)
    outside = np.zeros(padded.shape, bool)
    for y, a, b in zip(*(x[own == own[0]] for x in (rows, first, last))):  # the first run is the border's
        outside[y, a : b + 1] = True
    beside = np.zeros(padded.shape, bool)
    beside[1:-1, 1:-1] = outside[:-2, 1:-1] | outside[2:, 1:-1] | outside[1:-1, :-2] | outside[1:-1, 2:]
    rows, first, last, own = labelled(padded, diagonal=True)
    boxes: dict[int, list] = {}
    for y, a, b, k in zip(rows.tolist(), first.tolist(), last.tolist(), own.tolist()):
        box = boxes.setdefault(k, [a, y, b, y, False])
        box[:4] = min(box[0], a), min(box[1], y), max(box[2], b), max(box[3], y)
        box[4] = box[4] or bool(beside[y, a : b + 1].any())
    return [(x0 - 1, y0 - 1, x1, y1) for x0, y0, x1, y1, free in boxes.values() if free]


def table_regions(image: np.ndarray, width: float, height: float) -> list[dict]:
    """Boxes of ruled grids, from the top, by long dark lines across and down."""
    gray = np.rint(image[..., :3] @ np.array([0.299, 0.587, 0.114]))
    dark = gray <= TABLE["dark"]
    h, w = dark.shape
    grid = long_runs(dark, max(TABLE["line"], w // TABLE["across"])) | long_runs(dark.T, max(TABLE["line"], h // TABLE["down"])).T
    found = []
    for x0, y0, x1, y1 in outer_boxes(grid):
        wide = TABLE["width"][0] * w <= x1 - x0 <= TABLE["width"][1] * w
        tall = TABLE["height"][0] * h <= y1 - y0 <= TABLE["height"][1] * h
        if wide and tall and grid[y0:y1, x0:x1].mean() >= TABLE["density"]:
            found.append(_points(x0, y0, x1, y1, image, width, height))
    return sorted(found, key=lambda b: (b["y0"], b["x0"]))
