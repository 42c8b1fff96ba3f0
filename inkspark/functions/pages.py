"""Made-up document pages with known contents, whole or tampered with, for measuring readers and detectors.

Everything follows from a seed. Letters are of an invented font, whose patterns
come from a rule, so no font file is needed. A page comes with a manifest: what
is printed where, the zone's lines and letters, and what was changed.
"""

from __future__ import annotations

import hashlib
import random

import numpy as np

from inkspark.functions.mrz import ALPHABET, COMPOSITE, LAYOUT, SHAPES, WEIGHTS

SCHEMA_VERSION = 1
FORMATS = {"passport": "TD3", "visa": "TD2", "national_id": "TD1"}
TAMPERING = ["text_edit", "date_of_birth_change", "photo_replacement", "stamp_edit"]
GRID, DOT = (7, 5), 2
MARGIN, STEP, LEADING = 24, 14, 24


def pattern(letter: str) -> np.ndarray:
    """A letter's grid: a frame on two sides, so that it hangs together, and dots that the letter's hash places."""
    bits = np.unpackbits(np.frombuffer(hashlib.sha256(f"letter {letter}".encode()).digest(), np.uint8))
    grid = np.zeros(GRID, bool)
    grid[:, 0] = grid[0] = grid[-1, -1] = True
    grid[1:, 1:] |= bits[: (GRID[0] - 1) * (GRID[1] - 1)].reshape(GRID[0] - 1, GRID[1] - 1).astype(bool)
    grid[-1] = True  # so that all letters are equally high and wide
    grid[:, -1] |= grid[:, 0] & (np.arange(GRID[0]) % 3 == 0)
    return grid


def font() -> dict[str, np.ndarray]:
    return {c: pattern(c) for c in ALPHABET + "<"}


def digit(text: str) -> str:
    value = lambda c: 0 if c == "<" else ALPHABET.index(c)
    return str(sum(value(c) * WEIGHTS[i % 3] for i, c in enumerate(text)) % 10)


def zone(form: str, fields: dict[str, str]) -> list[str]:
    """A zone's lines from its fields, with right check digits."""
    count, width = SHAPES[form]
    lines = [["<"] * width for _ in range(count)]

    def put(line: int, first: int, last: int, text: str) -> None:
        lines[line - 1][first - 1 : last] = list(text.ljust(last - first + 1, "<")[: last - first + 1])

    for f, line, name, first, last in LAYOUT:
        if f == form and name in fields:
            put(line, first, last, fields[name])
    for f, line, name, first, last in LAYOUT:
        if f == form and name.endswith("_check_digit") and name != "composite_check_digit":
            at = next((y, a, b) for g, y, n, a, b in LAYOUT if g == form and n == name.removesuffix("_check_digit"))
            put(line, first, last, digit("".join(lines[at[0] - 1][at[1] - 1 : at[2]])))
    whole = "".join("".join(lines[y - 1][a - 1 : b]) for y, a, b in COMPOSITE[form])
    for f, line, name, first, last in LAYOUT:
        if f == form and name == "composite_check_digit":
            put(line, first, last, digit(whole))
    return ["".join(line) for line in lines]


def _draw(page: np.ndarray, x: int, y: int, text: str, letters: dict[str, np.ndarray], dark: int = 20) -> list[list[int]]:
    boxes = []
    for i, c in enumerate(text):
        left = x + i * STEP
        if c != " ":
            mask = np.kron(letters[c], np.ones((DOT, DOT), bool))
            page[y : y + mask.shape[0], left : left + mask.shape[1]][mask] = dark
        boxes.append([left, y, GRID[1] * DOT, GRID[0] * DOT])
    return boxes


def make(seed: int, document_type: str = "passport", tampers: tuple[str, ...] = ()) -> tuple[np.ndarray, dict]:
    """The page (height, width, 3) and its manifest."""
    form, rng, letters = FORMATS[document_type], random.Random(f"{seed} {document_type}"), font()
    word = lambda n: "".join(rng.choice("ABCDEFGHIKLMNOPRSTUV") for _ in range(n))
    birth, expiry = f"{rng.randint(50, 99)}{rng.randint(1, 12):02}{rng.randint(1, 28):02}", f"{rng.randint(30, 40)}{rng.randint(1, 12):02}{rng.randint(1, 28):02}"
    surname, given, number = word(rng.randint(4, 8)), word(rng.randint(3, 6)), f"{rng.choice('CDEFGH')}{rng.randint(0, 10**7 - 1):07}"
    fields = {"document_code": {"passport": "P", "visa": "V", "national_id": "I"}[document_type], "issuing_state": "UTO", "name": f"{surname}<<{given}", "document_number": number, "nationality": "UTO", "date_of_birth": birth, "sex": rng.choice("MF"), "date_of_expiry": expiry}
    lines = zone(form, fields)
    width = 2 * MARGIN + SHAPES["TD3"][1] * STEP
    height = 420 + LEADING * len(lines)
    page = np.full((height, width, 3), 235, np.uint8)
    printed = []
    for i, (name, value) in enumerate((("name", f"{given} {surname}"), (f"{document_type}_number", number), ("date_of_birth", birth), ("date_of_expiry", expiry))):
        boxes = _draw(page, 180, 70 + 36 * i, value, letters)
        printed.append({"name": name, "label": name.replace("_", " "), "value": value, "value_box": [180, 70 + 36 * i, boxes[-1][0] + GRID[1] * DOT - 180, GRID[0] * DOT]})
    grid = [_draw(page, MARGIN, height - LEADING * (len(lines) - k) - 30, line, letters) for k, line in enumerate(lines)]
    photo = [MARGIN, 60, 120, 150]
    page[60:210, MARGIN : MARGIN + 120] = np.array([rng.randint(60, 200) for _ in range(3)])
    ys, xs = np.indices((60, 60)) - 30
    ring = (np.hypot(ys, xs) <= 29) & (np.hypot(ys, xs) >= 23)
    page[230:290, 440:500][ring] = (190, 40, 40)
    manifest = {
        "schema_version": SCHEMA_VERSION, "document_id": f"{document_type}-{seed}", "synthetic": True, "seed": seed, "document_type": document_type, "format": form, "size": [width, height], "printed": printed,
        "mrz_lines": lines, "cells": grid, "portrait": photo, "stamp": [440, 230, 60, 60], "tampering": [],
    }
    for kind in tampers:
        _tamper(page, manifest, kind, rng, letters)
    return page, manifest


def _tamper(page: np.ndarray, manifest: dict, kind: str, rng: random.Random, letters: dict[str, np.ndarray]) -> None:
    if kind not in TAMPERING:
        raise ValueError(f"no tampering {kind}")
    field, original, new = None, None, None
    if kind in ("text_edit", "date_of_birth_change"):
        field = "date_of_birth" if kind == "date_of_birth_change" else manifest["printed"][1]["name"]
        entry = next(p for p in manifest["printed"] if p["name"] == field)
        x, y, w, h = box = entry["value_box"]
        original = entry["value"]
        new = original[:-1] + str((int(original[-1]) + rng.randint(1, 9)) % 10)
        page[y : y + h, x : x + w] = 235
        _draw(page, x, y, new, letters)
    else:
        x, y, w, h = box = manifest["portrait"] if kind == "photo_replacement" else manifest["stamp"]
        patch = page[y : y + h, x : x + w]
        noise = np.random.default_rng(rng.randint(0, 10**6)).integers(0, 60, patch.shape)
        page[y : y + h, x : x + w] = np.clip(patch.astype(int) + noise - 30, 0, 255).astype(np.uint8)
    manifest["tampering"].append({"kind": kind, "field": field, "box": list(box), "original": original, "replacement": new})


def problems(manifest: dict) -> list[str]:
    """What is wrong with a manifest, step by step; an empty list if nothing is. Later steps need the earlier ones."""
    needed = {"schema_version": int, "document_id": str, "synthetic": bool, "seed": int, "document_type": str, "format": str, "size": list, "printed": list, "mrz_lines": list, "cells": list, "portrait": list, "tampering": list}
    out = [f"{k} is missing or of another type" for k, t in needed.items() if not isinstance(manifest.get(k), t)]
    if out:
        return out
    if manifest["schema_version"] != SCHEMA_VERSION or not manifest["synthetic"]:
        out.append("not a synthetic page of this schema")
    form = FORMATS.get(manifest["document_type"])
    if form is None or form != manifest["format"]:
        return [*out, "document type and format don't go together"]
    count, width = SHAPES[form]
    if [len(x) for x in manifest["mrz_lines"]] != [width] * count or any(c not in ALPHABET + "<" for line in manifest["mrz_lines"] for c in line):
        out.append("the zone's lines aren't of their format")
    if [len(x) for x in manifest["cells"]] != [len(x) for x in manifest["mrz_lines"]]:
        out.append("cells and letters differ in number")
    w, h = manifest["size"]
    inside = lambda b: len(b) == 4 and min(b[:2]) >= 0 and min(b[2:]) > 0 and b[0] + b[2] <= w and b[1] + b[3] <= h
    boxes = [manifest["portrait"], *(p["value_box"] for p in manifest["printed"]), *(b for line in manifest["cells"] for b in line), *(t["box"] for t in manifest["tampering"])]
    if not all(map(inside, boxes)):
        out.append("a box is outside the page")
    if any(t["kind"] not in TAMPERING or t["original"] == t["replacement"] is not None for t in manifest["tampering"]):
        out.append("a tampering is of no known kind or changes nothing")
    return out
