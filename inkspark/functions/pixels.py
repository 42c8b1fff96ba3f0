"""Kernels on one image as numpy arrays: what no relational operator expresses.

Images are height by width, or by width by channels in BGR order, 8 bits.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

# The grid, ring, levels and spans of the face cues, and from what score on a face is suspect.
CANONICAL = 64
RING, DETAIL_LEVEL, DETAIL_SPAN = 0.30, 0.0345, 0.0092
OUTLINE_LEVEL, OUTLINE_SPAN = 1.162, 0.125
MORPH_SUSPECT = 0.221
FLAT_LEVEL, FLAT_SPAN = 0.1706, 0.7712
DEEPFAKE_SUSPECT = 0.0116
# stamps' least colour, closing, ink and side, and the least correlation of a match.
STAMP_CHROMA, STAMP_CLOSE, STAMP_INK, STAMP_SIDE, STAMP_MATCH = 55.0, 15, 1000, 40, 0.75


def gray(image: np.ndarray) -> np.ndarray:
    """Luma of one, three or four channels."""
    if image.ndim == 2:
        return image
    if image.shape[2] == 1:
        return image[:, :, 0]
    b, g, r = (image[:, :, i].astype(np.float64) for i in range(3))
    return np.floor(0.114 * b + 0.587 * g + 0.299 * r + 0.5).astype(np.uint8)


def _weights(n: int, m: int) -> np.ndarray:
    """Shares of n pixels in each of m."""
    edges = np.arange(m + 1) * (n / m)
    if m >= n:
        return np.eye(n)[np.minimum((edges[:-1]).astype(int), n - 1)]
    i = np.arange(n)
    return np.clip(np.minimum(edges[1:, None], i + 1) - np.maximum(edges[:-1, None], i), 0, 1) / (n / m)


#: Those of letters, which come again and again.
_few_weights = lru_cache(maxsize=256)(_weights)


def resized(plane: np.ndarray, height: int, width: int) -> np.ndarray:
    """Area means where an image shrinks, nearest pixels where it grows."""
    weights = _few_weights if max(*plane.shape, height, width) <= 64 else _weights
    return weights(plane.shape[0], height) @ plane.astype(np.float64) @ weights(plane.shape[1], width).T


def around(plane: np.ndarray, r: int = 1) -> np.ndarray:
    """Each pixel's square neighbourhood, edges repeated: height, width, (2r+1)^2."""
    padded = np.pad(plane, r, mode="edge")
    view = np.lib.stride_tricks.sliding_window_view(padded, (2 * r + 1, 2 * r + 1))
    return view.reshape(*plane.shape, -1)


def laplacian(plane: np.ndarray) -> np.ndarray:
    p = np.pad(plane.astype(np.float64), 1, mode="reflect") if min(plane.shape) > 1 else np.pad(plane.astype(np.float64), 1, mode="edge")
    return p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * p[1:-1, 1:-1]


def trimmed(image: np.ndarray, tolerance: int = 8) -> np.ndarray:
    """Without border rows and columns that are all the colour of the first corner."""
    plane = gray(image).astype(int)
    busy = np.abs(plane - plane[0, 0]) > tolerance
    rows, columns = np.flatnonzero(busy.any(1)), np.flatnonzero(busy.any(0))
    return image[rows[0] : rows[-1] + 1, columns[0] : columns[-1] + 1] if len(rows) else image


def components(mask: np.ndarray, diagonal: bool = False) -> tuple[np.ndarray, int]:
    """Labels of regions connected by sides (or corners too), 0 outside: two passes of row runs joined by union-find."""
    reach = int(diagonal)
    parent: list[int] = [0]

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    labels = np.zeros(mask.shape, np.int64)
    before: list[tuple[int, int, int]] = []
    for y, row in enumerate(mask):
        edges = np.flatnonzero(np.diff(np.concatenate([[0], row.astype(np.int8), [0]])))
        now, first = [], 0
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            name = len(parent)
            parent.append(name)
            # Runs go from the left: what ends before this one meets no later one either.
            while first < len(before) and before[first][1] + reach <= a:
                first += 1
            for c, _, other in before[first:]:
                if c >= b + reach:
                    break
                x, z = sorted((find(name), find(other)))
                parent[z] = x
            labels[y, a:b] = name
            now.append((a, b, name))
        before = now
    roots = np.array([find(i) for i in range(len(parent))])
    names, dense = np.unique(roots, return_inverse=True)
    return dense[labels], len(names) - 1


def boxes(labels: np.ndarray, n: int) -> list[tuple[int, int, int, int, int, float, float]]:
    """left, top, width, height, area and centre of each region, by top and left. One pass for all regions."""
    if not n:
        return []
    ys, xs = np.nonzero(labels)
    k = labels[ys, xs] - 1
    area = np.bincount(k, minlength=n)
    least = lambda v: np.minimum.reduceat(v[order], starts)
    most = lambda v: np.maximum.reduceat(v[order], starts)
    order = np.argsort(k, kind="stable")
    starts = np.concatenate([[0], np.cumsum(area)[:-1]])
    left, top, right, bottom = least(xs), least(ys), most(xs), most(ys)
    cx, cy = np.bincount(k, xs, n) / area, np.bincount(k, ys, n) / area
    out = [(int(left[i]), int(top[i]), int(right[i] - left[i]) + 1, int(bottom[i] - top[i]) + 1, int(area[i]), float(cx[i]), float(cy[i])) for i in range(n)]
    return sorted(out, key=lambda b: (b[1], b[0]))


def longest_run(mask: np.ndarray, axis: int) -> np.ndarray:
    """Longest run of true along an axis, by running counts that a false resets."""
    m = np.moveaxis(mask, axis, 0).astype(np.int64)
    count, best = np.zeros(m.shape[1:], np.int64), np.zeros(m.shape[1:], np.int64)
    for row in m:
        count = (count + 1) * row
        best = np.maximum(best, count)
    return best


# Tampering


def block_means(plane: np.ndarray, block: int = 8) -> np.ndarray:
    """Means of whole blocks; a ragged edge is left out."""
    h, w = plane.shape[0] // block, plane.shape[1] // block
    return plane[: h * block, : w * block].reshape(h, block, w, block).mean((1, 3), dtype=np.float64)


def block_variance(plane: np.ndarray, block: int = 8) -> np.ndarray:
    """Population variances of whole blocks."""
    p = plane.astype(np.float64)
    return np.maximum(block_means(p * p, block) - block_means(p, block) ** 2, 0)


def departure(variances: np.ndarray, factor: float = 8.0) -> np.ndarray:
    """How many factors a block's variance is from the median, 0 to 1."""
    middle = np.median(variances)
    if middle <= 0:
        return np.zeros_like(variances)
    return np.clip(np.abs(np.log2(np.maximum(variances, 1e-9) / middle)) / np.log2(factor), 0, 1)


def _cosines() -> np.ndarray:
    k = np.arange(8)
    basis = np.cos((2 * k[None] + 1) * k[:, None] * np.pi / 16) / 2
    basis[0] /= np.sqrt(2)
    return basis


# The luminance quantiser of the JPEG standard.
QUANTISER = np.array([
    [16, 11, 10, 16, 24, 40, 51, 61], [12, 12, 14, 19, 26, 58, 60, 55], [14, 13, 16, 24, 40, 57, 69, 56], [14, 17, 22, 29, 51, 87, 80, 62],
    [18, 22, 37, 56, 68, 109, 103, 77], [24, 35, 55, 64, 81, 104, 113, 92], [49, 64, 78, 87, 103, 121, 120, 101], [72, 92, 95, 98, 112, 100, 103, 99],
])


def recompressed(plane: np.ndarray, quality: int) -> np.ndarray:
    """What a JPEG of this quality keeps of whole 8x8 blocks: cosine transform, quantiser and back."""
    h, w = plane.shape[0] // 8, plane.shape[1] // 8
    scale = 5000 / quality if quality < 50 else 200 - 2 * quality
    table = np.clip(np.floor((QUANTISER * scale + 50) / 100), 1, 255)
    basis = _cosines()
    blocks = plane[: h * 8, : w * 8].astype(np.float64).reshape(h, 8, w, 8).swapaxes(1, 2) - 128
    kept = np.round((basis @ blocks @ basis.T) / table) * table
    back = np.clip(np.round(basis.T @ kept @ basis + 128), 0, 255)
    return back.swapaxes(1, 2).reshape(h * 8, w * 8)


def error_levels(plane: np.ndarray, qualities: tuple[int, ...] = (75, 85, 95)) -> np.ndarray:
    """Mean absolute error by block over recompressions, as a share of the greatest."""
    h, w = plane.shape[0] // 8 * 8, plane.shape[1] // 8 * 8
    errors = sum(np.abs(plane[:h, :w].astype(np.float64) - recompressed(plane, q)) for q in qualities) / len(qualities)
    means = block_means(errors)
    return means / means.max() if means.size and means.max() > 0 else means


def noise_map(plane: np.ndarray) -> np.ndarray:
    return departure(block_variance(plane.astype(np.float64) - np.median(around(plane), 2)))


def peak(heat: np.ndarray) -> tuple[float, int, int]:
    """Greatest value and its first place in row order."""
    if not heat.size:
        return 0.0, 0, 0
    y, x = np.unravel_index(int(heat.argmax()), heat.shape)
    return float(heat[y, x]), int(y), int(x)


def region(heat: np.ndarray, level: float) -> np.ndarray:
    """The connected region at a level around the peak."""
    labels, _ = components(heat >= level)
    _, y, x = peak(heat)
    return labels == labels[y, x] if heat.size and labels[y, x] else np.zeros(heat.shape, bool)


def copies(plane: np.ndarray, block: int = 8, least: int = 24, all_pairs: int = 16) -> list[tuple[int, int, int, int]]:
    """Blocks that stand again, at least so far away: (y, x, dy, dx).

    Equal quantised blocks meet by sorting. Of a few equal blocks all pairs are
    looked at; of more, each with the outermost ones on all four sides, so that
    rows grow with the number of blocks and not with its square.
    """
    h, w = plane.shape
    if h < block or w < block:
        return []
    view = np.lib.stride_tricks.sliding_window_view(plane, (block, block))
    flat = (view.reshape(-1, block * block) // 8).astype(np.uint8)
    busy = flat.max(1) - flat.min(1) >= 3  # flat blocks are alike everywhere
    spots = np.flatnonzero(busy)
    order = spots[np.lexsort(flat[spots].T[::-1])]
    if len(order) < 2:
        return []
    new = np.concatenate([[True], (flat[order[1:]] != flat[order[:-1]]).any(1)])
    out: set[tuple[int, int, int, int]] = set()
    for own in np.split(order, np.flatnonzero(new)[1:]):
        if len(own) < 2:
            continue
        places = [divmod(int(i), view.shape[1]) for i in sorted(own)]
        others = places if len(places) <= all_pairs else {f(places, key=lambda p: p[axis]) for f in (min, max) for axis in (0, 1)}
        for a in places:
            for b in others:
                if a != b and (a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2 >= least**2:
                    first, second = min(a, b), max(a, b)
                    out.add((*first, second[0] - first[0], second[1] - first[1]))
    return sorted(out)


def shift_votes(pairs: list[tuple[int, int, int, int]], shape: tuple[int, int], tolerance: int = 16, at_least: int = 8, block: int = 8) -> np.ndarray:
    """Votes by block for copied regions: both ends of pairs whose shift many share, a quarter each, at most 1."""
    shifts: dict[tuple[int, int], list[tuple[int, int, int, int]]] = {}
    for p in pairs:
        shifts.setdefault((round(p[2] / tolerance), round(p[3] / tolerance)), []).append(p)
    votes = np.zeros((-(-shape[0] // block), -(-shape[1] // block)))
    for own in shifts.values():
        if len(own) >= at_least:
            for y, x, dy, dx in own:
                votes[y // block, x // block] += 1
                votes[(y + dy) // block, (x + dx) // block] += 1
    return np.minimum(votes / 4, 1.0)


def joined_points(points: list[tuple[int, int]], reach: float = 48.0) -> list[tuple[int, int, int, int]]:
    """Boxes (left, top, right, bottom) of points that are linked by steps within reach: a grid finds neighbours, union-find joins them."""
    cell = max(1, int(reach))
    grid: dict[tuple[int, int], list[int]] = {}
    parent = list(range(len(points)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, (x, y) in enumerate(points):
        for gx in (x // cell - 1, x // cell, x // cell + 1):
            for gy in (y // cell - 1, y // cell, y // cell + 1):
                for j in grid.get((gx, gy), ()):
                    if (points[j][0] - x) ** 2 + (points[j][1] - y) ** 2 <= reach * reach:
                        parent[find(i)] = find(j)
        grid.setdefault((x // cell, y // cell), []).append(i)
    groups: dict[int, list[tuple[int, int]]] = {}
    for i, p in enumerate(points):
        groups.setdefault(find(i), []).append(p)
    return sorted((min(x for x, _ in g), min(y for _, y in g), max(x for x, _ in g), max(y for _, y in g)) for g in groups.values())


def box_polygon(box: tuple[int, int, int, int]) -> list[tuple[int, int]]:
    """Corners of a box (left, top, width, height), clockwise from the top left."""
    x, y, w, h = box
    return [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]


# Faces


def canonical(region: np.ndarray, size: int = CANONICAL) -> np.ndarray | None:
    """A region's grey levels on the grid that cues are read on; None if it is smaller."""
    plane = gray(region)
    if min(plane.shape) < size:
        return None
    return np.clip(np.floor(resized(plane, size, size) + 0.5), 0, 255).astype(np.uint8)


def detail_share(plane: np.ndarray, ring: float = RING) -> float | None:
    """Share of spectral power, without the mean, outside a ring around the centre; None for a flat region."""
    grid = plane.astype(np.float64) - plane.mean()
    power = np.abs(np.fft.fftshift(np.fft.fft2(grid))) ** 2
    total = float(power.sum())
    if total <= 0:
        return None
    ys, xs = np.ogrid[: power.shape[0], : power.shape[1]]
    far = np.hypot(ys - power.shape[0] / 2, xs - power.shape[1] / 2) > ring * min(power.shape) / 2
    return float(power[far].sum()) / total


def outline_factor(plane: np.ndarray) -> float | None:
    """Squared perimeter over 4 pi times the area of the largest dark shape: 1 for a circle; None without a shape.

    The outline runs through the centres of the shape's border pixels.
    """
    from inkspark.functions.capture import otsu

    if plane.min() == plane.max():
        return None
    mask = closed(plane < otsu(plane) + 1, 3)
    labels, n = components(mask)
    if not n:
        return None
    shape = labels == 1 + int(np.bincount(labels.ravel(), minlength=n + 1)[1:].argmax())
    path = border(shape)
    if len(path) < 4:
        return None
    points = np.array(path, float)
    steps = np.roll(points, -1, 0) - points
    area = abs(float(points[:, 0] @ np.roll(points[:, 1], -1) - points[:, 1] @ np.roll(points[:, 0], -1))) / 2
    return float(np.hypot(*steps.T).sum()) ** 2 / (4 * np.pi * area) if area > 0 else None


def border(shape: np.ndarray) -> list[tuple[int, int]]:
    """Border pixels (y, x) of a connected shape in order, by walking around it from its first pixel with the shape to the right."""
    ys, xs = np.nonzero(shape)
    if not len(ys):
        return []
    turns = [(0, -1), (-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1)]
    on = lambda p: 0 <= p[0] < shape.shape[0] and 0 <= p[1] < shape.shape[1] and shape[p]
    start = (int(ys[0]), int(xs[0]))
    path, at, came = [start], start, 0
    for _ in range(8 * shape.size):
        for k in range(8):
            turn = (came + 1 + k) % 8
            step = (at[0] + turns[turn][0], at[1] + turns[turn][1])
            if on(step):
                break
        else:
            return path  # one pixel
        came = (turn + 4) % 8
        if step == start and len(path) > 1 and path[1:2] and _next_is(shape, step, came, path[1], turns, on):
            return path
        path.append(step)
        at = step
    return path


def _next_is(shape, at, came, wanted, turns, on) -> bool:
    """Whether the walk goes on from here as it did from the start."""
    for k in range(8):
        turn = (came + 1 + k) % 8
        step = (at[0] + turns[turn][0], at[1] + turns[turn][1])
        if on(step):
            return step == wanted
    return False


def closed(mask: np.ndarray, size: int) -> np.ndarray:
    """Gaps narrower than a square of this size filled: grown by it, then shrunk."""
    r = size // 2

    def spread(m: np.ndarray, edge: bool) -> np.ndarray:
        for axis in (0, 1):
            padded = np.pad(m, [(r, size - 1 - r) if a == axis else (0, 0) for a in (0, 1)], constant_values=edge)
            n = m.shape[axis]
            m = np.any([np.take(padded, range(k, k + n), axis=axis) for k in range(size)], 0)
        return m

    return ~spread(~spread(mask, False), False)


def morph_cues(region: np.ndarray) -> tuple[float, float, float, bool] | None:
    """Lack of detail, doubled outline, their mean and whether it is suspect; None if a cue can't be read."""
    plane = canonical(region)
    share, factor = (None, None) if plane is None else (detail_share(plane), outline_factor(plane))
    if share is None or factor is None:
        return None
    detail = float(np.clip((DETAIL_LEVEL - share) / DETAIL_SPAN, 0, 1))
    outline = float(np.clip((factor - OUTLINE_LEVEL) / OUTLINE_SPAN, 0, 1))
    return detail, outline, (detail + outline) / 2, (detail + outline) / 2 >= MORPH_SUSPECT


def flat_share(plane: np.ndarray) -> float:
    """Share of zero steps between neighbours, across and down together."""
    p = plane.astype(int)
    steps = np.concatenate([np.diff(p, axis=1).ravel(), np.diff(p, axis=0).ravel()])
    return float((steps == 0).mean()) if len(steps) else 0.0


def deepfake_cue(region: np.ndarray) -> tuple[float, bool] | None:
    """How flat a region is, and whether that is suspect; None for one of a single level."""
    plane = canonical(region)
    if plane is None or plane.min() == plane.max():
        return None
    cue = float(np.clip((flat_share(plane) - FLAT_LEVEL) / FLAT_SPAN, 0, 1))
    return cue, cue >= DEEPFAKE_SUSPECT


# Stamps


def matched(template: np.ndarray, candidate: np.ndarray) -> float:
    """Normalised correlation of two equal-sized planes, 0 if one is flat."""
    a, b = (x.astype(np.float64) - x.mean() for x in (template, candidate))
    norm = np.sqrt((a * a).sum() * (b * b).sum())
    return float((a * b).sum() / norm) if norm else 0.0


def chroma(image: np.ndarray) -> np.ndarray:
    """Greatest less least channel: 0 where there is no colour."""
    if image.ndim < 3 or image.shape[2] < 3:
        return np.zeros(image.shape[:2], int)
    return image[:, :, :3].astype(int).max(2) - image[:, :, :3].astype(int).min(2)


def stamps(image: np.ndarray, level: float = STAMP_CHROMA, close: int = STAMP_CLOSE, least_area: int = STAMP_INK, least_side: int = STAMP_SIDE) -> list[tuple[int, int, int, int]]:
    """Boxes of coloured regions, gaps closed, large enough for a stamp, by top and left."""
    mask = chroma(image) >= level
    if not mask.any():
        return []
    return [b[:4] for b in boxes(*components(closed(mask, close))) if b[4] >= least_area and min(b[2:4]) >= least_side]


def stamp_template(image: np.ndarray, level: float = STAMP_CHROMA) -> np.ndarray | None:
    """A mark cropped to its ink, on the grid that stamps are compared on; None without ink."""
    ys, xs = np.nonzero(chroma(image) >= level)
    return on_grid(image[ys.min() : ys.max() + 1, xs.min() : xs.max() + 1]) if len(ys) else None


def on_grid(patch: np.ndarray, size: int = CANONICAL) -> np.ndarray:
    """All channels of a patch at a fixed size."""
    return np.stack([resized(patch[:, :, c], size, size) for c in range(3)], 2)


def match_stamps(image: np.ndarray, templates: dict[str, np.ndarray], least: float = STAMP_MATCH) -> tuple[str, list[tuple[str, float, tuple[int, int, int, int]]]]:
    """not_configured, no_match or matched, and each box with its best template (the first on a tie) that is alike enough."""
    boxes_found = stamps(image)
    if not templates:
        return "not_configured", []
    out = []
    for x, y, w, h in boxes_found:
        patch = on_grid(image[y : y + h, x : x + w])
        scored = [(matched(t, patch), name) for name, t in templates.items()]
        score, name = max(scored, key=lambda s: s[0])
        if score >= least:
            out.append((name, score, (x, y, w, h)))
    return ("matched" if out else "no_match"), out


# Geometry


def homography(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The projective map of four points to four points."""
    rows, values = [], []
    for (x, y), (u, v) in zip(source, target, strict=True):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
        values += [u, v]
    return np.append(np.linalg.solve(np.array(rows, float), np.array(values, float)), 1).reshape(3, 3)


def warped(plane: np.ndarray, map_back: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear samples of a plane where a map leads each target pixel; outside is 0."""
    ys, xs = np.indices((height, width))
    x, y, s = map_back @ np.stack([xs.ravel(), ys.ravel(), np.ones(xs.size)])
    x, y = x / s, y / s
    x0, y0 = np.floor(x).astype(int), np.floor(y).astype(int)
    out = np.zeros(xs.size)
    for dy in (0, 1):
        for dx in (0, 1):
            inside = (0 <= y0 + dy) & (y0 + dy < plane.shape[0]) & (0 <= x0 + dx) & (x0 + dx < plane.shape[1])
            part = np.where(dx, x - x0, 1 - (x - x0)) * np.where(dy, y - y0, 1 - (y - y0))
            out[inside] += part[inside] * plane[y0[inside] + dy, x0[inside] + dx]
    return out.reshape(height, width)


def similarity_fit(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Least-squares rotation, scale and shift of points to points, as a 2x3 matrix."""
    a, b = source.mean(0), target.mean(0)
    p, q = source - a, target - b
    u, d, vt = np.linalg.svd(q.T @ p / len(p))
    sign = np.diag([1, np.sign(np.linalg.det(u @ vt)) or 1])
    turn = u @ sign @ vt
    scale = np.trace(np.diag(d) @ sign) / (p**2).sum(1).mean()
    return np.hstack([scale * turn, (b - scale * turn @ a)[:, None]])


# Features and outliers


def features(plane: np.ndarray) -> list[float]:
    """Fifteen measures of a page."""
    p = plane.astype(np.float64)
    levels = np.bincount(plane.ravel() // 16, minlength=16) / plane.size
    entropy = -sum(x * np.log2(x) for x in levels if x > 0) / 4
    ela, var = error_levels(plane), block_variance(p - np.median(around(plane), 2))
    ink = plane < p.mean() * 0.6
    flat = lambda a: a.ravel() if a.size else np.zeros(1)
    return [
        float(flat(ela).mean()), float(flat(ela).max()), float(np.median(flat(var))), float(np.percentile(flat(var), 95)), float(flat(var).max()), float(p.mean()), float(p.std()), float(ink.mean()), float(entropy),
        float(laplacian(plane).var()), detail_share(plane) or 0.0, flat_share(plane), float(longest_run(ink, 1).max(initial=0) / plane.shape[1]), float(longest_run(ink, 0).max(initial=0) / plane.shape[0]), float(ink.any(1).mean()),
    ]


class Forest:
    """An isolation forest: how few random cuts set a row apart."""

    def __init__(self, rows: np.ndarray, trees: int = 200, sample: int = 256, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.sample = min(sample, len(rows))
        depth = int(np.ceil(np.log2(max(self.sample, 2))))
        self.trees = [self._grow(rows[rng.choice(len(rows), self.sample, replace=False)], depth, rng) for _ in range(trees)]

    def _grow(self, rows: np.ndarray, depth: int, rng: np.random.Generator):
        spread = np.flatnonzero(rows.max(0) > rows.min(0)) if len(rows) > 1 else []
        if depth == 0 or len(spread) == 0:
            return len(rows)
        f = int(rng.choice(spread))
        cut = rng.uniform(rows[:, f].min(), rows[:, f].max())
        left = rows[:, f] < cut
        return f, cut, self._grow(rows[left], depth - 1, rng), self._grow(rows[~left], depth - 1, rng)

    @staticmethod
    def _expected(n: int) -> float:
        return 0.0 if n < 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n

    def _paths(self, tree, rows: np.ndarray, depth: int, out: np.ndarray, at: np.ndarray) -> None:
        if not isinstance(tree, tuple):
            out[at] = depth + self._expected(tree)
            return
        f, cut, low, high = tree
        left = rows[at, f] < cut
        self._paths(low, rows, depth + 1, out, at[left])
        self._paths(high, rows, depth + 1, out, at[~left])

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """0 to 1; outliers are near 1."""
        total = np.zeros(len(rows))
        for tree in self.trees:
            out = np.zeros(len(rows))
            self._paths(tree, rows, 0, out, np.arange(len(rows)))
            total += out
        return 2 ** -(total / len(self.trees) / max(self._expected(self.sample), 1e-9))
