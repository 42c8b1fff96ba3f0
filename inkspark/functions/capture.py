"""Capture quality of one image: how it was taken, where the card is, and nine checks.

A check gives its value, whether it passed (None: it doesn't apply, which is no
failure) and the reasons of a failure. A flat scan has other rules than a photo:
white paper is no over-exposure, and glare and coverage don't apply.
"""

from __future__ import annotations

import numpy as np

from inkspark.functions import pixels

# Limits of the checks.
BLUR_LEAST, BLUR_WIDTH = 100.0, 1000
NOISE_MOST = 6.0
MEAN_LOW, MEAN_HIGH, CONTRAST_LEAST, DARK_MOST, BRIGHT_MOST = 60.0, 225.0, 50.0, 0.05, 0.10
EVEN_LEAST = 0.60
GLARE_LEVEL, GLARE_SATURATION, GLARE_AREA, GLARE_BLOB = 240, 50, 0.02, 0.01
PPI_LEAST, CARD_WIDE_MM, CARD_HIGH_MM, ASPECT_TOLERANCE = 150.0, 85.6, 54.0, 0.15
GLYPH_LEAST, GLYPHS_LEAST = 8.0, 30
SKEW_MOST, PERSPECTIVE_MOST = 10.0, 1.15
COVERAGE_LEAST, COVERAGE_MOST, MARGIN = 0.25, 0.95, 0.01
EDGE_MOST, EDGE_SOLID = 0.02, 0.90
TEXT_DENSITY_MOST = 0.10
# Module, flag, label.
CHECKS = [
    ("blur", "QUALITY_BLUR", "The capture is too blurred to read."),
    ("noise", "QUALITY_NOISE", "The capture carries sensor noise above the ceiling."),
    ("exposure", "QUALITY_EXPOSURE", "The capture is under- or over-exposed."),
    ("lighting", "QUALITY_UNEVEN_LIGHTING", "The page is lit unevenly across its own surface."),
    ("glare", "QUALITY_GLARE", "A reflection covers the page."),
    ("resolution", "QUALITY_LOW_RESOLUTION", "The capture resolves the page at too few pixels per inch."),
    ("skew", "QUALITY_SKEW", "The page is captured far off its own plane."),
    ("coverage", "QUALITY_LOW_COVERAGE", "The document fills too little of the frame to read."),
    ("cropped", "QUALITY_CROPPED", "An edge of the document is cut off by the frame."),
]

#: Rows that a blur takes at once.
STRIP = 16

Result = tuple[float | None, bool | None, list[str]]


def blurred(plane: np.ndarray, size: int) -> np.ndarray:
    """A Gaussian of an odd width, edges mirrored, one axis after the other."""
    sigma = 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    r = min(size // 2, min(plane.shape) - 1)
    x = np.arange(-r, r + 1)
    weights = np.exp(-x * x / (2 * sigma * sigma))
    weights /= weights.sum()
    out = plane.astype(np.float64)
    for axis in (0, 1):
        padded = np.pad(out, [(r, r) if a == axis else (0, 0) for a in (0, 1)], mode="reflect")
        n = out.shape[axis]
        out = np.empty(out.shape)
        # Strips of rows, so that what is added up stays in the processor's cache.
        for top in range(0, out.shape[0], STRIP):
            strip = out[top : top + STRIP]
            part = np.empty(strip.shape)
            for k, w in enumerate(weights):
                rows = padded[top + k : top + k + len(strip)] if axis == 0 else padded[top : top + len(strip), k : k + n]
                np.multiply(rows, w, out=part if k else strip)
                if k:
                    strip += part
    return out


def ink(plane: np.ndarray, block: int = 31, offset: float = 15) -> np.ndarray:
    """Pixels darker than their surroundings by an offset."""
    return plane < blurred(plane, block) - offset


def otsu(plane: np.ndarray) -> int:
    """The level that parts the histogram into two classes of least spread."""
    n = np.bincount(plane.ravel(), minlength=256).astype(np.float64)
    below, mass = np.cumsum(n), np.cumsum(n * np.arange(256))
    above = below[-1] - below
    with np.errstate(divide="ignore", invalid="ignore"):
        between = below * above * (mass / below - (mass[-1] - mass) / above) ** 2
    return int(np.nanargmax(np.where((below > 0) & (above > 0), between, -1)))


def corners(ys: np.ndarray, xs: np.ndarray) -> np.ndarray:
    """Top left, top right, bottom right and bottom left of points, by extremes of sum and difference."""
    total, apart = xs + ys, ys - xs
    return np.array([(xs[i], ys[i]) for i in (total.argmin(), apart.argmin(), total.argmax(), apart.argmax())], float)


def area_of(quad: np.ndarray) -> float:
    x, y = quad.T
    return abs(float(x @ np.roll(y, -1) - y @ np.roll(x, -1))) / 2


def find_card(plane: np.ndarray, least: float = 0.03) -> dict | None:
    """Corners of the largest region that stands out by its level, or None: bright on dark, or dark on bright."""
    h, w = plane.shape
    scale = min(1.0, 800 / max(h, w))
    small = pixels.resized(plane, max(1, round(h * scale)), max(1, round(w * scale))).round().astype(np.uint8)
    if small.min() == small.max():
        return None
    level, quad, share = otsu(small), None, 0.0
    for mask in (small > level, small <= level):
        labels, n = pixels.components(mask)
        for k in np.flatnonzero(np.bincount(labels.ravel(), minlength=n + 1)[1:] >= least / 4 * labels.size):
            own = corners(*np.nonzero(labels == k + 1))
            area = area_of(own) / labels.size  # of the outline, so what surrounds a card is as large as the frame
            if max(least, share) <= area <= 0.98:
                quad, share = own / scale, area
    if quad is None:
        return None
    near = (quad[:, 0] < 0.005 * w) | (quad[:, 0] > 0.995 * w) | (quad[:, 1] < 0.005 * h) | (quad[:, 1] > 0.995 * h)
    return {"corners": quad, "area": share, "at_border": bool(near.any())}


def sides(quad: np.ndarray) -> tuple[float, float, float, float]:
    """Lengths of top, right, bottom and left."""
    return tuple(float(np.linalg.norm(quad[(i + 1) % 4] - quad[i])) for i in range(4))


def inside(quad: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """Mask of the pixels within a convex outline."""
    ys, xs = np.indices(shape)
    out = np.ones(shape, bool)
    for i in range(4):
        (ax, ay), (bx, by) = quad[i], quad[(i + 1) % 4]
        out &= (bx - ax) * (ys - ay) - (by - ay) * (xs - ax) >= 0
    return out


def mode_of(plane: np.ndarray) -> str:
    """photo or scan: a scan has bright edges all around and no card that stands out."""
    h, w = plane.shape
    thick = max(2, int(0.03 * min(h, w)))
    edges = (plane[:thick], plane[-thick:], plane[:, :thick], plane[:, -thick:])
    if not all((e >= 190).mean() >= 0.6 for e in edges):
        return "photo"
    card = find_card(plane)
    if card is None or card["at_border"] or card["area"] > 0.85:
        return "scan"
    top, right, bottom, left = sides(card["corners"])
    a, b = (top + bottom) / 2, (left + right) / 2
    wanted = CARD_WIDE_MM / CARD_HIGH_MM
    alike = card["area"] >= 0.15 and abs(max(a, b) / max(min(a, b), 1e-6) - wanted) / wanted <= 0.25
    if not alike:
        return "scan"
    within = inside(card["corners"], plane.shape)
    return "scan" if within.any() and ink(plane)[within].mean() > TEXT_DENSITY_MOST else "photo"


def _verdict(value: float | None, *reasons: tuple[bool, str]) -> Result:
    found = [name for failed, name in reasons if failed]
    return value, not found, found


def blur(image: np.ndarray, plane: np.ndarray, mode: str) -> Result:
    width = min(BLUR_WIDTH, plane.shape[1])
    value = float(pixels.laplacian(pixels.resized(plane, max(1, round(plane.shape[0] * width / plane.shape[1])), width)).var())
    return _verdict(value, (value < BLUR_LEAST, "too_blurred"))


def noise(image: np.ndarray, plane: np.ndarray, mode: str) -> Result:
    """Robust spread of what a 3x3 median leaves."""
    left = plane.astype(np.float64) - np.median(pixels.around(plane), 2)
    value = float(1.4826 * np.median(np.abs(left - np.median(left))))
    return _verdict(value, (value > NOISE_MOST, "too_noisy"))


def exposure(image: np.ndarray, plane: np.ndarray, mode: str) -> Result:
    value, (low, high) = float(plane.mean()), np.percentile(plane, [5, 95])
    photo = mode == "photo"
    return _verdict(
        value, (value < MEAN_LOW, "too_dark"), (photo and value > MEAN_HIGH, "too_bright"), ((plane <= 5).mean() > DARK_MOST, "shadows_clipped"),
        (photo and (plane >= 250).mean() > BRIGHT_MOST, "highlights_clipped"), (high - low < CONTRAST_LEAST, "low_contrast"),
    )


def lighting(image: np.ndarray, plane: np.ndarray, mode: str) -> Result:
    """Darkest to brightest of coarse block means."""
    low, high = np.percentile(pixels.resized(plane, min(8, plane.shape[0]), min(8, plane.shape[1])), [5, 95])
    value = float(low / high) if high else 0.0
    return _verdict(value, (value < EVEN_LEAST, "uneven"))


def glare(image: np.ndarray, plane: np.ndarray, mode: str) -> Result:
    """Share of bright, colourless pixels, on the card if one is found."""
    if mode == "scan":
        return None, None, []
    mask = plane >= GLARE_LEVEL
    if image.ndim == 3 and image.shape[2] >= 3:
        high, low = image[:, :, :3].max(2).astype(int), image[:, :, :3].min(2).astype(int)
        mask = (high >= GLARE_LEVEL) & (255 * (high - low) <= GLARE_SATURATION * np.maximum(high, 1))
    card = find_card(plane)
    valid = inside(card["corners"], plane.shape) if card else np.ones(plane.shape, bool)
    area = max(int(valid.sum()), 1)
    labels, n = pixels.components(mask & valid)
    sizes = np.bincount(labels.ravel(), minlength=n + 1)[1:] / area
    value = float(sizes.sum())
    return _verdict(value, (value > GLARE_AREA, "glare_total"), (sizes.max(initial=0) > GLARE_BLOB, "glare_spot"))


def glyph_heights(plane: np.ndarray) -> np.ndarray:
    h, w = plane.shape
    found = pixels.boxes(*pixels.components(ink(plane)))
    return np.array([b[3] for b in found if 4 <= b[3] <= 0.08 * h and b[2] <= 0.08 * w and b[4] >= 6], float)


def resolution(image: np.ndarray, plane: np.ndarray, mode: str) -> Result:
    """Pixels an inch of the card; of a scan, whose size nobody knows, the median height of its letters."""
    if mode == "scan":
        heights = glyph_heights(plane)
        if len(heights) < GLYPHS_LEAST:
            return None, False, ["too_little_text"]
        value = float(np.median(heights))
        return _verdict(value, (value < GLYPH_LEAST, "text_too_small"))
    card = find_card(plane)
    if card is None:
        return None, False, ["card_not_found"]
    top, right, bottom, left = sides(card["corners"])
    long, short = sorted(((top + bottom) / 2, (left + right) / 2), reverse=True)
    value, wanted = long / (CARD_WIDE_MM / 25.4), CARD_WIDE_MM / CARD_HIGH_MM
    return _verdict(value, (value < PPI_LEAST, "too_low"), (abs(long / max(short, 1e-6) - wanted) / wanted > ASPECT_TOLERANCE, "outline_uncertain"), (card["at_border"], "cut_off"))


def text_skew(plane: np.ndarray, reach: float = 15.0, step: float = 0.5) -> float | None:
    """Angle at which row sums of ink vary most; of equal ones the smallest. None without ink."""
    ys, xs = np.nonzero(ink(plane))
    if len(xs) < 2:
        return None

    def sharp(angle: float) -> float:
        t = np.deg2rad(angle)
        rows = np.round(ys * np.cos(t) - xs * np.sin(t)).astype(int)
        return float((np.bincount(rows - rows.min()).astype(np.float64) ** 2).sum())

    return float(max(np.arange(-reach, reach + step / 2, step), key=lambda a: (sharp(a), -abs(a))))


def skew(image: np.ndarray, plane: np.ndarray, mode: str) -> Result:
    """Degrees off the level; of a photo, by the card's outline, whose sides also tell how far it is tilted."""
    card = find_card(plane) if mode == "photo" else None
    if card is None:
        angle = text_skew(plane)
        if angle is None:
            return None, (None if mode == "scan" else False), [] if mode == "scan" else ["not_measured"]
        return _verdict(abs(angle), (abs(angle) > SKEW_MOST, "rotated"))
    quad = card["corners"]
    turned = lambda a, b, off: (np.degrees(np.arctan2(b[1] - a[1], b[0] - a[0])) - off + 90) % 180 - 90
    angles = [turned(quad[0], quad[1], 0), turned(quad[3], quad[2], 0), turned(quad[0], quad[3], 90), turned(quad[1], quad[2], 90)]
    value = abs(float(np.mean(angles)))
    top, right, bottom, left = sides(quad)
    ratio = lambda a, b: max(a, b) / max(min(a, b), 1e-6)
    return _verdict(value, (value > SKEW_MOST, "rotated"), (max(ratio(top, bottom), ratio(left, right)) > PERSPECTIVE_MOST, "at_an_angle"), (card["at_border"], "cut_off"))


def coverage(image: np.ndarray, plane: np.ndarray, mode: str) -> Result:
    """Share of the frame that the card fills, and whether its corners are inside."""
    if mode == "scan":
        return None, None, []
    card = find_card(plane)
    if card is None:
        return None, False, ["card_not_found"]
    h, w = plane.shape
    x, y = card["corners"].T
    out = (x < MARGIN * w) | (x > (1 - MARGIN) * w) | (y < MARGIN * h) | (y > (1 - MARGIN) * h)
    value = area_of(card["corners"]) / (h * w)
    return _verdict(value, (bool(out.any()), "cut_off"), (value < COVERAGE_LEAST, "too_small"), (value > COVERAGE_MOST, "fills_the_frame"))


def cropped(image: np.ndarray, plane: np.ndarray, mode: str) -> Result:
    """Largest share of ink on an edge of a scan; an edge that is nearly all ink is a frame."""
    if mode == "photo":
        return None, None, []
    level = plane.mean() * 0.6
    shares = [float((edge < level).mean()) for edge in (plane[0], plane[-1], plane[:, 0], plane[:, -1])]
    value = max((s for s in shares if s <= EDGE_SOLID), default=0.0)
    return _verdict(value, (value > EDGE_MOST, "cut_at_edge"))


_RUN = {"blur": blur, "noise": noise, "exposure": exposure, "lighting": lighting, "glare": glare, "resolution": resolution, "skew": skew, "coverage": coverage, "cropped": cropped}


def report(image: np.ndarray, mode: str = "auto") -> list[tuple[str, str, float | None, bool | None, str, str | None]]:
    """module, mode, value, passed, reasons (comma-joined) and error of each check, in order.

    A flat border is taken off first. A check that breaks off is reported as
    such and doesn't stop the others.
    """
    image = pixels.trimmed(image)
    plane, out = pixels.gray(image), []
    mode = mode_of(plane) if mode == "auto" else mode
    for name, _, _ in CHECKS:
        try:
            value, passed, reasons = _RUN[name](image, plane, mode)
            out.append((name, mode, value, passed, ",".join(reasons), None))
        except Exception as error:
            out.append((name, mode, None, None, "", type(error).__name__))
    return out


def gate(height: int, width: int, least: int = 500) -> str:
    """The cheap check before an upload: pass if the shorter side is long enough, else warn."""
    return "pass" if min(height, width) >= least else "warn"
