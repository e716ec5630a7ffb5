"""Grey images as numpy arrays of bytes (0 is ink): the array operators behind recognised pages, for columns of struct<w,h,px>."""

from __future__ import annotations

import numpy as np


def image(w: int, h: int, px: bytes) -> np.ndarray:
    return np.frombuffer(px, np.uint8).reshape(h, w)


def crop(a: np.ndarray, x0: int, y0: int, x1: int, y1: int) -> np.ndarray:
    h, w = a.shape
    return a[max(0, y0) : max(0, min(h, y1)), max(0, x0) : max(0, min(w, x1))]


def pad(a: np.ndarray, margin: int, value: int = 255) -> np.ndarray:
    return np.pad(a, margin, constant_values=value)


def thicken(a: np.ndarray, radius: int = 1) -> np.ndarray:
    """Ink spreads by ``radius`` in both directions: a separable minimum."""
    for axis in (0, 1):
        padded = np.pad(a, [(radius, radius) if i == axis else (0, 0) for i in (0, 1)], constant_values=255)
        a = np.min([np.take(padded, range(k, k + a.shape[axis]), axis=axis) for k in range(2 * radius + 1)], axis=0)
    return a


def shrink(a: np.ndarray, factor: int) -> np.ndarray:
    """Means of boxes of ``factor`` by ``factor``; what is left over at the edges goes."""
    h, w = (n // factor * factor for n in a.shape)
    return np.rint(a[:h, :w].reshape(h // factor, factor, w // factor, factor).mean((1, 3))).astype(np.uint8)


def resample(a: np.ndarray, width: int, height: int) -> np.ndarray:
    """Bilinear."""
    ys, xs = ((np.arange(n) + 0.5) * m / n - 0.5 for n, m in ((height, a.shape[0]), (width, a.shape[1])))
    y0, x0 = (np.clip(np.floor(v).astype(int), 0, m - 1) for v, m in ((ys, a.shape[0]), (xs, a.shape[1])))
    y1, x1 = np.minimum(y0 + 1, a.shape[0] - 1), np.minimum(x0 + 1, a.shape[1] - 1)
    fy, fx = np.clip(ys - y0, 0, 1)[:, None], np.clip(xs - x0, 0, 1)[None, :]
    f = a.astype(float)
    return np.rint((f[y0][:, x0] * (1 - fx) + f[y0][:, x1] * fx) * (1 - fy) + (f[y1][:, x0] * (1 - fx) + f[y1][:, x1] * fx) * fy).astype(np.uint8)


def percentile(a: np.ndarray, share: float) -> int:
    """First value whose cumulative count is over ``share`` of the pixels."""
    return int(np.searchsorted(np.cumsum(np.bincount(a.ravel(), minlength=256)), a.size * share, side="right"))


def normalize_contrast(a: np.ndarray) -> np.ndarray:
    """The 2nd percentile becomes black, the median white."""
    low, high = percentile(a, 0.02), percentile(a, 0.5)
    if high <= low:
        return a
    return np.clip((a.astype(int) - low) * 255 // (high - low), 0, 255).astype(np.uint8)


def stack(images: list[np.ndarray], gap: int) -> tuple[np.ndarray, list[int]]:
    """Images below each other on white, and where each begins."""
    width, offsets, rows, at = max((i.shape[1] for i in images), default=0), [], [], 0
    for i in images:
        offsets.append(at)
        rows += [np.pad(i, ((0, 0), (0, width - i.shape[1])), constant_values=255), np.full((gap, width), 255, np.uint8)]
        at += i.shape[0] + gap
    return (np.concatenate(rows) if rows else np.zeros((0, 0), np.uint8)), offsets


def leading_text_end(a: np.ndarray, dark: int = 128, dots: int = 3) -> int | None:
    """Where the text before dot leaders ends: the column before the first ``dots`` narrow, low runs of ink that follow each other evenly."""
    ink = (a < dark).any(0)
    edges = np.flatnonzero(np.diff(np.concatenate(([False], ink, [False])).astype(int)))
    runs = list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))
    small = [(b - x) <= max(2, a.shape[0] // 5) and int((a[:, x:b] < dark).any(1).sum()) <= max(2, a.shape[0] // 4) for x, b in runs]
    for i in range(len(runs) - dots + 1):
        steps = [runs[k + 1][0] - runs[k][0] for k in range(i, i + dots - 1)]
        if all(small[i : i + dots]) and max(steps) <= 1.5 * min(steps):
            return runs[i - 1][1] if i else 0
    return None


def components(a: np.ndarray, dark: int = 128) -> list[tuple[int, int, int, int, int]]:
    """(x0, y0, x1, y1, pixels) of 8-connected ink, from top left."""
    ink, label = a < dark, {}
    parent: list[int] = []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for y, x in zip(*np.nonzero(ink), strict=True):
        near = [label[p] for p in ((y - 1, x - 1), (y - 1, x), (y - 1, x + 1), (y, x - 1)) if p in label]
        if not near:
            parent.append(len(parent))
            label[y, x] = len(parent) - 1
        else:
            low = min(map(root, near))
            for n in near:
                parent[root(n)] = low
            label[y, x] = low
    boxes: dict[int, list[int]] = {}
    for (y, x), i in label.items():
        b = boxes.setdefault(root(i), [x, y, x + 1, y + 1, 0])
        b[:] = [min(b[0], x), min(b[1], y), max(b[2], x + 1), max(b[3], y + 1), b[4] + 1]
    return sorted((tuple(map(int, b)) for b in boxes.values()), key=lambda b: (b[1], b[0]))


def is_stroke(a: np.ndarray, dark: int = 128) -> bool:
    """One component at least three times as high as wide: a lone 1, l or I."""
    found = components(a, dark)
    return len(found) == 1 and (found[0][3] - found[0][1]) >= 3 * (found[0][2] - found[0][0])
