"""Kernels against direct computation, and operators on images."""

import numpy as np
import pytest

from inkspark.functions import capture, pixels
from inkspark.operators import risk, vision
from inkspark.operators.weights import weightset

RNG = np.random.default_rng(2)


def plain(h=40, w=60, level=180):
    return np.full((h, w), level, np.uint8)


def busy(h=64, w=64):
    return RNG.integers(0, 256, (h, w)).astype(np.uint8)


def test_components_by_flood_fill():
    mask = RNG.random((30, 40)) < 0.45
    labels, n = pixels.components(mask)
    seen, count = np.zeros(mask.shape, int), 0
    for y, x in zip(*np.nonzero(mask), strict=True):
        if seen[y, x]:
            continue
        count += 1
        stack = [(y, x)]
        while stack:
            a, b = stack.pop()
            if 0 <= a < 30 and 0 <= b < 40 and mask[a, b] and not seen[a, b]:
                seen[a, b] = count
                stack += [(a + 1, b), (a - 1, b), (a, b + 1), (a, b - 1)]
    assert n == count
    assert len({(a, b) for a, b in zip(labels.ravel(), seen.ravel(), strict=True)}) == n + 1


def test_block_statistics():
    plane = busy(33, 21)
    means, variances = pixels.block_means(plane), pixels.block_variance(plane)
    assert means.shape == (4, 2)
    assert means[1, 1] == pytest.approx(plane[8:16, 8:16].mean())
    assert variances[3, 0] == pytest.approx(plane[24:32, 0:8].astype(float).var())


def test_cosine_transform_is_orthonormal():
    basis = pixels._cosines()
    assert np.allclose(basis @ basis.T, np.eye(8))
    assert np.abs(pixels.recompressed(plain(16, 16), 95) - 180).max() <= 1


def test_error_levels_find_the_edit():
    plane = pixels.recompressed(busy(), 75).astype(np.uint8)
    plane[16:24, 32:40] = RNG.integers(0, 256, (8, 8))
    score, y, x = pixels.peak(pixels.error_levels(plane, (75,)))
    assert (score, y, x) == (1.0, 2, 4)


def test_noise_map_finds_the_patch():
    plane = (128 + RNG.normal(0, 3, (64, 64))).clip(0, 255).astype(np.uint8)
    plane[8:16, 40:48] = RNG.integers(0, 256, (8, 8))
    assert pixels.peak(pixels.noise_map(plane))[1:] == (1, 5)


def test_copies():
    plane = busy()
    plane[40:56, 40:56] = plane[2:18, 2:18]
    found = pixels.copies(plane)
    assert found
    assert {(dy, dx) for _, _, dy, dx in found} == {(38, 38)}
    assert pixels.copies(plain()) == []


def test_copies_at_odd_shifts():
    for dy, dx in ((37, 38), (38, 37), (37, 37)):
        plane = busy()
        plane[2 + dy : 18 + dy, 2 + dx : 18 + dx] = plane[2:18, 2:18]
        assert {(y, x) for _, _, y, x in pixels.copies(plane)} == {(dy, dx)}


def test_longest_run():
    mask = np.array([[1, 1, 0, 1], [0, 1, 1, 1]], bool)
    assert pixels.longest_run(mask, 1).tolist() == [2, 3]
    assert pixels.longest_run(mask, 0).tolist() == [1, 2, 1, 2]


def test_region_and_peak():
    heat = np.array([[0.1, 0.9, 0.8], [0.9, 0.1, 0.1]])
    assert pixels.peak(heat) == (0.9, 0, 1)
    assert pixels.region(heat, 0.5).tolist() == [[False, True, True], [False, False, False]]


def test_projective_map_round_trip():
    source = np.array([[0, 0], [9, 1], [10, 8], [1, 9]], float)
    target = np.array([[0, 0], [19, 0], [19, 19], [0, 19]], float)
    h = pixels.homography(source, target)
    for (x, y), want in zip(source, target, strict=True):
        p = h @ [x, y, 1]
        assert np.allclose(p[:2] / p[2], want)
    plane = busy(12, 12)
    assert np.allclose(pixels.warped(plane, np.eye(3), 12, 12), plane)


def test_similarity_fit():
    turn = np.array([[0.6, -0.8], [0.8, 0.6]])
    source = RNG.random((5, 2)) * 50
    fit = pixels.similarity_fit(source, 2 * source @ turn.T + [3, -4])
    assert np.allclose(fit, np.hstack([2 * turn, [[3], [-4]]]))


def test_area_resize():
    plane = busy(8, 8)
    assert np.allclose(pixels.resized(plane, 4, 2), plane.reshape(4, 2, 2, 4).mean((1, 3)))


def test_copies_of_three_equal_blocks():
    plane = plain(130, 130)
    block = RNG.integers(0, 256, (8, 8))
    for y, x in ((0, 0), (0, 10), (100, 100)):
        plane[y : y + 8, x : x + 8] = block
    found = pixels.copies(plane)
    assert {(0, 0, 100, 100), (0, 10, 100, 90)} <= set(found)


def test_copies_of_many_blocks_are_few_rows():
    plane = np.tile(RNG.integers(0, 256, (8, 8)).astype(np.uint8), (20, 20))
    found = pixels.copies(plane)
    blocks = 153 * 153
    assert blocks / 2 < len(found) < 8 * blocks


def test_votes_and_regions_of_a_copy():
    plane = busy(96, 96)
    plane[50:82, 56:88] = plane[4:36, 6:38]
    votes = pixels.shift_votes(pixels.copies(plane), plane.shape)
    assert votes.max() == 1.0
    assert votes[1:4, 1:4].min() > 0 and votes[7:10, 8:10].min() > 0
    assert pixels.joined_points([(0, 0), (30, 0), (60, 10), (300, 300)], 48) == [(0, 0, 60, 10), (300, 300, 300, 300)]
    assert pixels.box_polygon((1, 2, 3, 4)) == [(1, 2), (4, 2), (4, 6), (1, 6)]


def test_boxes_region_by_region():
    labels, n = pixels.components(RNG.random((40, 30)) < 0.4)
    want = []
    for k in range(1, n + 1):
        ys, xs = np.nonzero(labels == k)
        want.append((xs.min(), ys.min(), np.ptp(xs) + 1, np.ptp(ys) + 1, len(xs), xs.mean(), ys.mean()))
    assert pixels.boxes(labels, n) == sorted(want, key=lambda b: (b[1], b[0]))


def test_closing_by_definition():
    mask = RNG.random((14, 17)) < 0.2
    grown = np.array([[mask[max(0, y - 1) : y + 2, max(0, x - 1) : x + 2].any() for x in range(17)] for y in range(14)])
    shrunk = np.array([[grown[max(0, y - 1) : y + 2, max(0, x - 1) : x + 2].all() for x in range(17)] for y in range(14)])
    assert (pixels.closed(mask, 3) == shrunk).all()


def disc(r, hole=0, size=64):
    y, x = np.indices((size, size)) - size // 2
    far = np.hypot(y, x)
    return np.where((far <= r) & (far >= hole), 30, 220).astype(np.uint8)


def test_outline_of_shapes():
    assert pixels.outline_factor(disc(20)) == pytest.approx(1.1, abs=0.08)
    square = np.full((64, 64), 220, np.uint8)
    square[10:51, 10:51] = 30
    assert pixels.outline_factor(square) == pytest.approx(4 / np.pi, abs=1e-9)
    assert len(pixels.border(square < 100)) == 160
    long = np.full((64, 64), 220, np.uint8)
    long[30:34, 2:62] = 30
    assert pixels.outline_factor(long) > 5
    assert pixels.outline_factor(plain(64, 64)) is None


def test_face_cues_by_hand():
    """Each cue against its own formula: morphs lack detail and have long outlines, generated faces are flat."""
    face = np.clip(disc(20).astype(int) + RNG.integers(-6, 7, (64, 64)), 0, 255).astype(np.uint8)
    grid = face.astype(float) - face.mean()
    power = np.abs(np.fft.fft2(grid)) ** 2
    f = np.fft.fftfreq(64) * 64
    share = power[np.hypot(*np.meshgrid(f, f, indexing="ij")) > 0.3 * 32].sum() / power.sum()
    detail, outline, score, suspect = pixels.morph_cues(face)
    assert detail == pytest.approx(np.clip((0.0345 - share) / 0.0092, 0, 1))
    assert score == pytest.approx((detail + outline) / 2)
    assert suspect == (score >= 0.221)
    flat = np.kron(RNG.integers(0, 256, (8, 8)), np.ones((8, 8))).astype(np.uint8)
    zero = np.concatenate([(np.diff(flat.astype(int), axis=a) == 0).ravel() for a in (0, 1)]).mean()
    assert pixels.deepfake_cue(flat) == (pytest.approx(np.clip((zero - 0.1706) / 0.7712, 0, 1)), True)
    assert pixels.deepfake_cue(busy()) == (0.0, False)
    assert pixels.morph_cues(plain(64, 64)) is pixels.deepfake_cue(plain(64, 64)) is pixels.deepfake_cue(busy(20, 20)) is None


def test_faces_go_to_their_own_columns(spark):
    flat = np.kron(RNG.integers(0, 256, (8, 8)), np.ones((8, 8))).astype(np.uint8)
    rows = spark.createDataFrame([(1, (64, 64, 1, flat.tobytes())), (2, (64, 64, 1, busy().tobytes()))], "id long, image struct<height:int,width:int,nChannels:int,data:binary>")
    got = {r["id"]: r for r in vision.suspicion(rows, "id").collect()}
    assert (got[1]["deepfake_suspected"], got[2]["deepfake_suspected"]) == (True, False)
    assert got[1]["morph_score"] == pixels.morph_cues(flat)[2]
    assert got[2]["morph_suspected"] == pixels.morph_cues(np.frombuffer(rows.collect()[1]["image"]["data"], np.uint8).reshape(64, 64))[3]


def stamp_image():
    page = np.full((200, 200, 3), 230, np.uint8)
    y, x = np.indices((60, 60)) - 30
    ring = (np.hypot(y, x) <= 29) & ((np.hypot(y, x) >= 22) | (np.abs(y) < 4))
    page[100:160, 40:100][ring] = (200, 40, 40)
    return page


def test_stamps():
    page = stamp_image()
    template = pixels.stamp_template(page[95:170, 30:110])
    other = pixels.stamp_template(np.kron(np.eye(2), np.ones((30, 30)))[:, :, None] * np.array([200, 40, 40]) // 1)
    status, found = pixels.match_stamps(page, {"other": other, "ring": template})
    assert status == "matched"
    assert found[0][0] == "ring" and found[0][1] > 0.99 and found[0][2] == (41, 101, 59, 59)
    assert pixels.match_stamps(page, {}) == ("not_configured", [])
    assert pixels.match_stamps(np.full((80, 80, 3), 200, np.uint8), {"ring": template}) == ("no_match", [])
    assert pixels.stamps(plain()) == []


def card_photo(w=900, h=600, margin=120, angle=0.0):
    photo = np.full((h, w), 60, np.uint8)
    y, x = np.indices((h, w)).astype(float)
    t = np.deg2rad(angle)
    u = (x - w / 2) * np.cos(t) + (y - h / 2) * np.sin(t)
    v = -(x - w / 2) * np.sin(t) + (y - h / 2) * np.cos(t)
    wide = w / 2 - margin
    card = (np.abs(u) <= wide) & (np.abs(v) <= wide * 54 / 85.6)
    photo[card] = 200
    photo[card & (np.abs(v) < 80) & ((u // 9).astype(int) % 2 == 0) & ((v // 20).astype(int) % 2 == 0)] = 30
    return photo


def test_capture_checks():
    run = lambda name, plane, mode="photo": capture._RUN[name](plane, plane, mode)
    assert run("blur", plain())[1] is False and run("blur", busy())[1] is True
    assert run("noise", busy())[1] is False
    assert run("exposure", plain(level=250))[2] == ["too_bright", "highlights_clipped", "low_contrast"]
    assert run("exposure", plain(level=250), "scan")[2] == ["low_contrast"]
    framed = plain()
    framed[10:20, 10:20] = 20
    assert pixels.trimmed(framed).shape == (10, 10)
    glared = plain()
    glared[15:25, 20:30] = 255
    assert run("glare", glared)[1] is False and run("glare", glared, "scan")[1] is None
    lines = plain(160, 400, 230)
    for x in range(400):
        for y in range(30, 130, 12):
            lines[int(y + x * np.tan(np.deg2rad(3))) % 160, x] = 0
    assert run("skew", lines, "scan")[0] == pytest.approx(3, abs=0.6)
    photo = card_photo(angle=4)
    card = capture.find_card(photo)
    assert card and not card["at_border"]
    assert run("skew", photo)[0] == pytest.approx(4, abs=0.7)
    assert run("coverage", photo)[1] is True
    assert run("coverage", card_photo(margin=330))[2] == ["too_small"]
    assert run("resolution", photo)[0] == pytest.approx(660 / (85.6 / 25.4), rel=0.03)
    assert run("resolution", card_photo(margin=330))[2] == ["too_low"]
    assert run("resolution", plain(), "scan")[2] == ["too_little_text"]
    assert run("cropped", photo)[1] is None
    assert capture.mode_of(photo) == "photo"
    page = plain(300, 200, 250)
    page[40:260:12, 20:180] = 0
    assert capture.mode_of(page) == "scan"
    assert capture.area_of(np.array([[0, 0], [4, 0], [4, 3], [0, 3]], float)) == 12
    assert (capture.gate(600, 500), capture.gate(600, 499)) == ("pass", "warn")
    assert 60 < capture.otsu(np.repeat(np.uint8([50, 70, 180, 200]), 9)) < 180


def test_capture_of_rotated_card_fails():
    report = {r[0]: r for r in capture.report(card_photo(margin=200, angle=14), "photo")}
    assert report["skew"][3] is False and "rotated" in report["skew"][4].split(",")
    assert capture.report(plain(), "auto")[0][1] in ("photo", "scan")


def test_forest_sets_outliers_apart():
    rows = np.vstack([RNG.normal(0, 1, (200, 3)), [[9, 9, 9]]])
    scores = pixels.Forest(rows, trees=60).scores(rows)
    assert scores.argmax() == 200
    assert (pixels.Forest(rows, trees=20).scores(rows) == pixels.Forest(rows, trees=20).scores(rows)).all()


def test_operators_on_bad_images(spark):
    image = "struct<height:int,width:int,nChannels:int,data:binary>"
    good = (8, 8, 1, bytes(range(64)))
    rows = spark.createDataFrame([(1, good), (2, None), (3, (8, 8, 1, b"short")), (4, (0, 0, 1, b""))], f"id long, image {image}")
    assert {r["id"] for r in vision.exposure(rows, "id").collect()} == {1}
    report = vision.quality(rows, "id").collect()
    assert [r["module"] for r in report] == [name for name, *_ in capture.CHECKS]
    flags = vision.quality_flags(vision.quality(rows, "id"), "id").collect()
    assert {r["flag"] for r in flags} == {flag for (_, flag, _), r in zip(capture.CHECKS, report, strict=True) if r["passed"] is False}
    scored = risk.score(spark.createDataFrame([("d", flag, 1.0, False) for _, flag, _ in capture.CHECKS], "doc string, id string, value double, hard boolean"), weightset(spark), "doc").first()
    assert scored["raw"] > 0  # each flag has a weight
    verdict = vision.quality_verdict(vision.quality(rows, "id"), "id").first()
    assert verdict["passed"] == (not flags) and verdict["failed"].count(",") == max(0, len(flags) - 1)
    assert vision.quality(rows.limit(0), "id").collect() == []
    assert vision.anomalies(rows.limit(0), "id").collect() == []


def test_image_source(spark, tmp_path):
    import struct
    import zlib

    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    raw = b"".join(b"\0" + bytes([10, 20, 30] * 4) for _ in range(3))
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 4, 3, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")
    (tmp_path / "a.png").write_bytes(png)
    (tmp_path / "b.png").write_bytes(b"not an image")
    got = vision.read_images(spark, str(tmp_path)).collect()
    assert len(got) == 1
    assert vision.array_of(got[0]["image"].asDict())[0, 0].tolist() == [30, 20, 10]


def test_pages_are_made_once(spark):
    """Reading zones makes each page once, and what was printed goes along with it."""
    from inkspark.plans.catalog import QUERIES

    plan = QUERIES["zones_read"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 2 and "Join" not in plan


def test_blurs_and_regions_by_the_plain_way():
    """Blurs in strips and regions found from the left are those of plain sums and of all pairs of runs."""
    rng = np.random.default_rng(3)
    for shape in ((1, 1), (5, 3), (17, 33), (40, 70)):
        plane = rng.integers(0, 256, shape).astype(np.uint8)
        for size in (3, 31):
            sigma, r = 0.3 * ((size - 1) * 0.5 - 1) + 0.8, min(size // 2, min(shape) - 1)
            x = np.arange(-r, r + 1)
            weights = np.exp(-x * x / (2 * sigma * sigma)) / np.exp(-x * x / (2 * sigma * sigma)).sum()
            padded = np.pad(plane.astype(float), r, mode="reflect")
            want = np.array([[weights @ padded[i : i + 2 * r + 1, j : j + 2 * r + 1] @ weights for j in range(shape[1])] for i in range(shape[0])])
            assert np.allclose(capture.blurred(plane, size), want, atol=1e-9)
        for diagonal, near in ((False, 1), (True, 2)):
            labels, n = pixels.components(plane < 110, diagonal)
            ys, xs = np.nonzero(plane < 110)
            assert len(np.unique(labels[ys, xs])) == n and (labels[plane >= 110] == 0).all()
            own = np.arange(len(ys))  # the least number that is reached by steps to neighbours
            touch = (abs(ys[:, None] - ys) <= 1) & (abs(xs[:, None] - xs) <= 1) & (abs(ys[:, None] - ys) + abs(xs[:, None] - xs) <= near)
            while len(ys) and (new := np.where(touch, own, len(ys)).min(1)).tolist() != own.tolist():
                own = new
            assert len({*zip(labels[ys, xs].tolist(), own.tolist(), strict=True)}) == n == len(set(own.tolist()))
