"""Made-up pages are read back whole, and their manifests say what is on them."""

import copy

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkspark.functions import mrz, pages, pixels, zone_image
from inkspark.operators import vision

CORPUS = [(kind, seed) for kind in pages.FORMATS for seed in range(3)]


def test_letters_differ():
    font = pages.font()
    assert len({g.tobytes() for g in font.values()}) == len(font) == 37
    assert all(pixels.components(np.kron(g, np.ones((2, 2), bool)), True)[1] >= 1 for g in font.values())


@pytest.mark.parametrize("tampers", [(), ("text_edit",), ("date_of_birth_change",), ("photo_replacement",), ("stamp_edit",)])
def test_zones_are_read_whole(tampers):
    """Field accuracy over the corpus: every line of every zone, on clean and tampered pages."""
    font = pages.font()
    for kind, seed in CORPUS:
        page, manifest = pages.make(seed, kind, tampers)
        assert zone_image.read(pixels.gray(page), font) == (manifest["format"], manifest["mrz_lines"]), (kind, seed)
        assert pages.problems(manifest) == []
        assert [t["kind"] for t in manifest["tampering"]] == list(tampers)


def test_tampering_changes_its_box_only():
    for kind in pages.TAMPERING:
        clean, _ = pages.make(1, "passport")
        page, manifest = pages.make(1, "passport", (kind,))
        x, y, w, h = manifest["tampering"][0]["box"]
        changed = (page != clean).any(2)
        assert changed[y : y + h, x : x + w].any()
        changed[y : y + h, x : x + w] = False
        assert not changed.any()
    with pytest.raises(ValueError):
        pages.make(1, "passport", ("magic",))


def test_leaning_pages_are_turned_level():
    page, manifest = pages.make(2, "passport")
    plane = pixels.gray(page)
    t = np.deg2rad(-3.0)
    h, w = plane.shape
    cx, cy = (w - 1) / 2, (h - 1) / 2
    back = np.array([[np.cos(t), -np.sin(t), cx - cx * np.cos(t) + cy * np.sin(t)], [np.sin(t), np.cos(t), cy - cx * np.sin(t) - cy * np.cos(t)], [0, 0, 1]])
    leaning = np.clip(pixels.warped(plane.astype(float) - 235, back, h, w) + 235, 0, 255).astype(np.uint8)
    turned, angle = zone_image.level(leaning)
    assert abs(angle) == pytest.approx(3, abs=0.6)
    assert zone_image.find(leaning)[0] == "TD3"
    assert np.abs(turned.astype(int) - plane).mean() < 12


def test_manifests_with_problems():
    _, good = pages.make(0, "visa", ("text_edit",))
    changes = [
        lambda m: m.pop("seed"), lambda m: m.update(schema_version=9), lambda m: m.update(format="TD3"), lambda m: m["mrz_lines"].__setitem__(0, "short"), lambda m: m["cells"][0].pop(),
        lambda m: m.update(portrait=[0, 0, 9999, 5]), lambda m: m["tampering"][0].update(kind="magic"), lambda m: m["tampering"][0].update(replacement=m["tampering"][0]["original"]),
    ]
    for change in changes:
        bad = copy.deepcopy(good)
        change(bad)
        assert pages.problems(bad), change


def test_islands_of_boxes():
    assert zone_image.rows_of([(30, 0, 5, 10), (0, 2, 5, 10), (0, 12, 5, 9), (9, 40, 5, 9)]) == [[(0, 2, 5, 10), (30, 0, 5, 10)], [(0, 12, 5, 9)], [(9, 40, 5, 9)]]
    assert zone_image.cells([(0, 0, 6, 9), (4, 1, 4, 12), (8, 0, 2, 9)]) == [(0, 0, 8, 13), (8, 0, 2, 9)]
    assert zone_image.form_of([[(0, 0, 1, 1)] * 43, [(0, 0, 1, 1)] * 45]) == "TD3"
    assert zone_image.form_of([[(0, 0, 1, 1)] * 12] * 2) is None
    uneven = [[(0, 0, 5, 10), (9, 0, 5, 18)], [(0, 24, 5, 10)], [(0, 48, 5, 10)], [(0, 95, 5, 10)]]
    assert zone_image.sound(uneven) == uneven[1:3]


def test_zones_of_an_image_table(spark):
    """From pixels to verdicts: pages as rows, zones read, check digits right."""
    rows = []
    for i, (kind, seed) in enumerate(CORPUS):
        page, _ = pages.make(seed, kind)
        rows.append((i, (page.shape[0], page.shape[1], 3, page.tobytes())))
    rows.append((99, (64, 64, 1, bytes(64 * 64))))
    frame = spark.createDataFrame(rows, "id long, image struct<height:int,width:int,nChannels:int,data:binary>")
    zones = vision.zones(frame, "id", pages.font())
    got = {r["id"]: r for r in zones.collect()}
    assert {i: r["form"] for i, r in got.items()} == {i: pages.FORMATS[kind] for i, (kind, _) in enumerate(CORPUS)} | {99: None}
    parsed = mrz.parse(zones.filter("form is not null"))
    verdicts = parsed.select("id", F.explode(mrz.verdicts(parsed)).alias("v")).select("id", "v.*").collect()
    assert verdicts and all(r["passed"] for r in verdicts)
