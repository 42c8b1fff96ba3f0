"""The machine-readable zone of a page's image: where it is, which format it has, and what it says.

A page is turned level, parted into ink and paper, and its letters are the
regions of a letter's size. Lines are runs of letters whose heights overlap;
those of uneven letters or spacing are none. The number of lines and letters
says the format. Reading compares each letter to a font's patterns.
"""

from __future__ import annotations

from statistics import median

import numpy as np

from inkspark.functions import capture, pixels
from inkspark.functions.mrz import SHAPES

# Greatest angle to turn back, block and offset of the threshold, a letter's height and shape, and how far a line's length may be off.
TURN_MOST = 10.0
BLOCK, OFFSET = 41, 10
HEIGHTS, SHAPE = (8, 24), (0.2, 2.5)
LENGTH_OFF = 2

Box = tuple[int, int, int, int]


def level(plane: np.ndarray) -> tuple[np.ndarray, float]:
    """The page turned level by the angle of its rows, and that angle; a page that leans more stays as it is. Corners are filled with paper."""
    angle = capture.text_skew(plane) or 0.0
    if not 0 < abs(angle) <= TURN_MOST:
        return plane, 0.0
    h, w = plane.shape
    t = np.deg2rad(angle)
    cx, cy = (w - 1) / 2, (h - 1) / 2
    back = np.array([[np.cos(t), -np.sin(t), cx - cx * np.cos(t) + cy * np.sin(t)], [np.sin(t), np.cos(t), cy - cx * np.sin(t) - cy * np.cos(t)], [0, 0, 1]])
    paper = float(np.median(np.concatenate([plane[0], plane[-1], plane[:, 0], plane[:, -1]])))
    turned = pixels.warped(plane.astype(np.float64) - paper, back, h, w) + paper
    return np.clip(np.floor(turned + 0.5), 0, 255).astype(np.uint8), angle


def letters(plane: np.ndarray) -> list[Box]:
    """Boxes (left, top, width, height) of regions of a letter's size and shape."""
    found = pixels.boxes(*pixels.components(capture.ink(plane, BLOCK, OFFSET), diagonal=True))
    return [b[:4] for b in found if HEIGHTS[0] <= b[3] <= HEIGHTS[1] and SHAPE[0] <= b[2] / b[3] <= SHAPE[1]]


def rows_of(boxes: list[Box]) -> list[list[Box]]:
    """Boxes by line, lines from the top, each from the left: a line ends where the next box starts below all of it."""
    lines: list[list[Box]] = []
    reach = -1
    for b in sorted(boxes, key=lambda b: (b[1], b[0])):
        if not lines or b[1] >= reach:
            lines.append([])
        lines[-1].append(b)
        reach = max(reach, b[1] + b[3]) if len(lines[-1]) > 1 else b[1] + b[3]
    return [sorted(line) for line in lines]


def sound(lines: list[list[Box]]) -> list[list[Box]]:
    """Lines of even letters, apart from each other by no more than a quarter over the tightest spacing."""
    tops = [min(b[1] for b in line) for line in lines]
    gaps = [b - a for a, b in zip(tops, tops[1:], strict=False)]
    near = [min(gaps[max(0, i - 1) : i + 1], default=None) for i in range(len(lines))]
    tightest = min(gaps, default=0)
    even = lambda line: max(b[3] for b in line) - min(b[3] for b in line) <= median(b[3] for b in line) / 3
    return [line for line, gap in zip(lines, near, strict=True) if even(line) and (gap is None or gap - tightest <= 0.25 * tightest)]


def cells(line: list[Box]) -> list[Box]:
    """A line's letters as cells from the left: boxes that overlap in width are one."""
    out: list[Box] = []
    for x, y, w, h in sorted(line):
        if out and x < out[-1][0] + out[-1][2]:
            a, b, c, d = out[-1]
            top, bottom = min(b, y), max(b + d, y + h)
            out[-1] = (a, top, max(a + c, x + w) - a, bottom - top)
        else:
            out.append((x, y, w, h))
    return out


def form_of(lines: list[list[Box]]) -> str | None:
    for name, (count, width) in SHAPES.items():
        if len(lines) == count and abs(median(len(line) for line in lines) - width) <= LENGTH_OFF:
            return name
    return None


def find(plane: np.ndarray) -> tuple[str | None, list[list[Box]], np.ndarray]:
    """Format, cells of each line, and the level page. The zone is the lowest lines that make a format."""
    turned, _ = level(plane)
    lines = [cells(line) for line in sound([line for line in rows_of(letters(turned)) if len(line) >= 20])]
    for count in (3, 2):
        if len(lines) >= count and (form := form_of(lines[-count:])):
            return form, lines[-count:], turned
    return None, [], turned


def read(plane: np.ndarray, font: dict[str, np.ndarray]) -> tuple[str | None, list[str]]:
    """Format and text of the zone, letter by letter the font's nearest pattern (a grid of 0 and 1)."""
    form, lines, turned = find(plane)
    names = sorted(font)
    patterns = np.stack([font[n].ravel() for n in names]).astype(float)
    high, wide = font[names[0]].shape
    dark = 255.0 - turned

    def letter(box: Box) -> str:
        x, y, w, h = box
        patch = pixels.resized(dark[y : y + h, x : x + w], high, wide).ravel()
        spread = np.ptp(patch)
        return names[int(((patterns - (patch - patch.min()) / (spread or 1)) ** 2).sum(1).argmin())]

    return form, ["".join(map(letter, line)) for line in lines]
