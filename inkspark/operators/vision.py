"""Image operators: kernels of inkspark.functions.pixels over an image column, in Arrow batches.

An image is the struct that Spark's image source reads: height, width,
nChannels, data. An image that can't be read gives null, not an error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkspark.functions import capture, pixels, zone_image
from inkspark.operators.seams import Seam

MAX_PIXELS = 20_000_000
MAX_BYTES = 10 * 1024 * 1024


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Images of a folder, those that can't be decoded left out by the source: origin and image."""
    rows = spark.read.format("image").option("dropInvalid", True).load(path)
    sound = (F.col("image.height") > 0) & (F.col("image.width") > 0) & (F.col("image.height").cast("long") * F.col("image.width") <= MAX_PIXELS)
    return rows.filter(sound).select(F.col("image.origin").alias("origin"), "image")


# Declared media types with the format that the contents must have, modes, and reject codes with their sentences.
MEDIA_TYPES = {"image/jpeg": "JPEG", "image/png": "PNG", "image/webp": "WEBP"}
MODES = ["auto", "photo", "scan"]
REJECTS = {
    "IMAGE_TOO_LARGE": "Choose an image that is 10 MB or smaller.",
    "INVALID_IMAGE": "The uploaded file is empty or is not a supported image.",
    "UNSUPPORTED_MEDIA_TYPE": "Upload a JPEG, PNG, or WebP image.",
    "INVALID_MODE": "Mode must be one of: auto, photo, or scan.",
    "MEDIA_TYPE_MISMATCH": "The file contents do not match the declared image type.",
    "IMAGE_DIMENSIONS_TOO_LARGE": "The image dimensions exceed the supported limit.",
}


def format_of(contents: Column) -> Column:
    """JPEG, PNG or WEBP by a file's first bytes, else null."""
    head = F.hex(F.substring(contents, 1, 12))
    return F.when(head.startswith("FFD8FF"), "JPEG").when(head.startswith("89504E470D0A1A0A"), "PNG").when(head.startswith("52494646") & head.endswith("57454250"), "WEBP")


def ingest_fault(size: Column, media_type: Column, mode: Column, found: Column | None = None, width: Column | None = None, height: Column | None = None) -> Column:
    """The code of the first rule that an upload breaks, else null.

    found: the contents' own format (null: none known); width and height: as
    decoded (null: not decodable). Rules on what isn't given aren't applied.
    """
    declared = F.lower(F.trim(F.split(F.coalesce(media_type, F.lit("")), ";", 2)[0]))
    expected = F.create_map(*(F.lit(x) for kv in MEDIA_TYPES.items() for x in kv))[declared]
    out = F.when(size > MAX_BYTES, "IMAGE_TOO_LARGE").when(F.coalesce(size, F.lit(0)) <= 0, "INVALID_IMAGE").when(expected.isNull(), "UNSUPPORTED_MEDIA_TYPE").when(~F.coalesce(mode, F.lit("auto")).isin(MODES), "INVALID_MODE")
    if found is not None:
        out = out.when(found.isNull(), "INVALID_IMAGE").when(found != expected, "MEDIA_TYPE_MISMATCH")
    if width is not None and height is not None:
        out = out.when(width.isNull() | height.isNull(), "INVALID_IMAGE").when((width <= 0) | (height <= 0) | (width.cast("long") * height > MAX_PIXELS), "IMAGE_DIMENSIONS_TOO_LARGE")
    return out


def array_of(image: dict | None) -> np.ndarray | None:
    if image is None or image["data"] is None:
        return None
    h, w, c = image["height"], image["width"], image["nChannels"]
    data = np.frombuffer(image["data"], np.uint8)
    return data.reshape(h, w, c) if h > 0 and w > 0 and len(data) == h * w * c else None


def _each(rows: DataFrame, key: str, schema: str, kernel: Callable[[np.ndarray], list[tuple]], kept: tuple[str, ...] = ()) -> DataFrame:
    """Rows that a kernel makes of each image, with its key and other columns that are kept; images are taken one at a time."""
    out = rows.sparkSession.createDataFrame([], f"{key} long, {schema}").schema
    for c in kept:
        out = out.add(rows.schema[c])
    fields = [f.name for f in out.fields]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(out)
        for batch in batches:
            made: list[tuple] = []
            others = [batch.column(c).to_pylist() for c in kept]
            for i, (k, image) in enumerate(zip(batch.column(key).to_pylist(), batch.column("image"), strict=True)):
                plane = array_of(image.as_py())
                if plane is not None:
                    made += [(k, *r, *(c[i] for c in others)) for r in kernel(plane)]
            columns = list(zip(*made, strict=True)) or [()] * len(fields)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return rows.select(key, "image", *kept).mapInArrow(of, out)


def quality(rows: DataFrame, key: str, mode: str = "auto") -> DataFrame:
    """One row for each check of each image: module, mode, value, passed, reasons, error."""
    return _each(rows, key, "module string, mode string, value double, passed boolean, reasons string, error string", lambda image: capture.report(image, mode))


def quality_flags(report: DataFrame, key: str) -> DataFrame:
    """A flag of the closed set for each failed check; one that doesn't apply hasn't failed. A check without a flag is an error."""
    failed = report.filter(F.col("passed") == False)  # noqa: E712
    names = F.broadcast(report.sparkSession.createDataFrame(capture.CHECKS, "__module string, __flag string, label string"))
    rows = failed.join(names, F.col("module") == F.col("__module"), "left")
    flag = F.coalesce("__flag", F.raise_error(F.concat(F.lit("unknown check "), F.coalesce("module", F.lit("null")))).cast("string"))
    reason = F.coalesce(F.nullif(F.replace("reasons", F.lit(","), F.lit(", ")), F.lit("")), F.lit("the check did not pass"))
    return rows.select(F.col(key), flag.alias("flag"), "label", F.lit(1.0).alias("value"), F.round("value", 6).alias("found"), reason.alias("reason"))


def quality_verdict(report: DataFrame, key: str) -> DataFrame:
    """Whether all checks of an image pass that apply, and which failed, in order."""
    order = F.create_map(*(F.lit(x) for i, (name, *_) in enumerate(capture.CHECKS) for x in (name, i)))
    failed = F.array_sort(F.collect_list(F.when(~F.col("passed"), F.struct(order[F.col("module")].alias("i"), "module"))))
    rows = report.groupBy(key).agg(F.min("mode").alias("mode"), failed.alias("f"), F.count("error").alias("errors"))
    return rows.select(key, "mode", (F.size("f") == 0).alias("passed"), F.array_join(F.transform("f", lambda x: x["module"]), ",").alias("failed"), "errors")


def heat(rows: DataFrame, key: str, kind: str) -> DataFrame:
    """Peak of an error-level or noise map, with its block and the size of the region around it."""
    kernel = {"ela": pixels.error_levels, "noise": pixels.noise_map}[kind]

    def of(image: np.ndarray) -> list[tuple]:
        found = kernel(pixels.gray(image))
        score, y, x = pixels.peak(found)
        return [(score, y, x, int(pixels.region(found, max(score / 2, 1e-9)).sum()))]

    return _each(rows, key, "score double, block_y int, block_x int, region int", of)


def corners(rows: DataFrame, key: str) -> DataFrame:
    """Outline of the card on each image: four corners from the top left, clockwise, or none."""

    def of(image: np.ndarray) -> list[tuple]:
        card = capture.find_card(pixels.gray(image))
        return [(card["corners"].tolist() if card else None,)]

    return _each(rows, key, "corners array<array<double>>", of)


def gate(rows: DataFrame, least: int = 500) -> DataFrame:
    """The cheap check on size alone: pass or warn, null without an image."""
    return rows.withColumn("gate", F.when(F.least(F.col("image.width"), F.col("image.height")) >= least, "pass").when(F.col("image").isNotNull(), "warn"))


def exposure(rows: DataFrame, key: str) -> DataFrame:
    """Mean level and shares of dark and bright pixels."""

    def of(image: np.ndarray) -> list[tuple]:
        plane = pixels.gray(image)
        return [(float(plane.mean()), float((plane <= 5).mean()), float((plane >= 250).mean()))]

    return _each(rows, key, "mean double, dark double, bright double", of)


def copy_moves(rows: DataFrame, key: str) -> DataFrame:
    """Pairs of equal blocks: place and shift."""
    return _each(rows, key, "y int, x int, dy int, dx int", lambda image: pixels.copies(pixels.gray(image)))


def copy_move_scores(rows: DataFrame, key: str) -> DataFrame:
    """Greatest share of votes of a block among copied regions, and how many regions they make."""

    def of(image: np.ndarray) -> list[tuple]:
        plane = pixels.gray(image)
        votes = pixels.shift_votes(pixels.copies(plane), plane.shape)
        hot = [(int(x) * 8, int(y) * 8) for y, x in np.argwhere(votes >= 0.5)]
        return [(float(votes.max(initial=0.0)), len(pixels.joined_points(hot)))]

    return _each(rows, key, "score double, regions int", of)


def stamp_matches(rows: DataFrame, key: str, templates: dict[str, np.ndarray]) -> DataFrame:
    """Status of each image, its best match or 0, and how many stamps match a template."""

    def of(image: np.ndarray) -> list[tuple]:
        status, found = pixels.match_stamps(image, templates)
        return [(status, max((s for _, s, _ in found), default=0.0), len(found))]

    return _each(rows, key, "status string, score double, matches int", of)


def glyph_components(rows: DataFrame, key: str) -> DataFrame:
    """Dark regions: left, top, width, height, area, centre."""

    def of(image: np.ndarray) -> list[tuple]:
        plane = pixels.gray(image)
        return pixels.boxes(*pixels.components(plane < plane.mean() * 0.6))

    return _each(rows, key, "left int, top int, width int, height int, area int, cx double, cy double", of)


def zones(rows: DataFrame, key: str, font: dict[str, np.ndarray], kept: tuple[str, ...] = ()) -> DataFrame:
    """Format and lines of each image's machine-readable zone, with the columns that are kept; null and none where there isn't one."""
    return _each(rows, key, "form string, lines array<string>", lambda image: [zone_image.read(pixels.gray(image), font)], kept)


def suspicion(rows: DataFrame, key: str) -> DataFrame:
    """Cues, scores and verdicts of both face checks: morphed (lack of detail, doubled outline) and generated (flatness). Null where a cue can't be read."""

    def of(image: np.ndarray) -> list[tuple]:
        return [(*(pixels.morph_cues(image) or (None,) * 4), *(pixels.deepfake_cue(image) or (None,) * 2))]

    return _each(rows, key, "detail double, outline double, morph_score double, morph_suspected boolean, flat double, deepfake_suspected boolean", of)


def face_modules() -> list[Seam]:
    """The two face checks as modules: what they found, and in words that no model was asked. A region that can't be read has no answer."""

    def run(score: str, suspect: str, said: str) -> Callable[[DataFrame], DataFrame]:
        def of(pages: DataFrame) -> DataFrame:
            found = suspicion(pages.select(F.col("page").cast("long").alias("page"), "image"), "page").filter(F.col(score).isNotNull())
            return found.select("page", F.col(score).alias("score"), F.col(suspect).alias("suspect"), F.concat(F.lit(said), F.round(score, 3).cast("string"), F.when(F.col(suspect), F.lit(", suspected.")).otherwise(F.lit(", not suspected."))).alias("detail"))

        return of

    return [
        Seam("tamper_morph", "classifier", "heuristic-v0", True, run("morph_score", "morph_suspected", "Two cues and no model: ")),
        Seam("tamper_deepfake", "classifier", "heuristic-v0", True, run("flat", "deepfake_suspected", "One cue and no model: ")),
    ]


def strongest(verdicts: DataFrame, key: str, members: list[str]) -> DataFrame:
    """Of several classifiers' rows (key, member, suspect, score) the strongest: suspects first, then the score, then the members' order."""
    rank = F.create_map(*(F.lit(x) for i, m in enumerate(members) for x in (m, -i)))
    best = F.max_by(F.struct("member", "suspect", "score"), F.struct("suspect", "score", rank[F.col("member")].alias("r")))
    return verdicts.groupBy(key).agg(best.alias("b")).select(key, "b.*")


def feature_rows(rows: DataFrame, key: str) -> DataFrame:
    return _each(rows, key, "features array<double>", lambda image: [(pixels.features(pixels.gray(image)),)])


def sample_keys(rows: DataFrame, key: str, n: int) -> list[int]:
    """The n keys of the smallest hash: only hashes are read to find them."""
    return [r[key] for r in rows.select(key, F.xxhash64(key).alias("__h")).orderBy("__h", key).limit(n).collect()]


def anomalies(rows: DataFrame, key: str, fit_rows: int = 256, contamination: float = 0.05) -> DataFrame:
    """Isolation forest: of each image the share of fit rows whose raw score is lower, the raw score, whether it is beyond the fit rows' share of outliers, and its features.

    The forest is fitted on at most ``fit_rows`` images, those of the smallest
    hash of the key. Their features are computed first; then each image's
    features and score are, in one pass.
    """
    schema = f"{key} long, score double, raw double, outlier boolean, features array<double>"
    empty = rows.sparkSession.createDataFrame([], schema)
    keys = sample_keys(rows, key, fit_rows)
    sample = feature_rows(rows.filter(F.col(key).isin(keys)), key).orderBy(F.xxhash64(key), key).collect() if keys else []
    if not sample:
        return empty
    fit = np.array([r["features"] for r in sample], float)
    forest = pixels.Forest(fit)
    seen = np.sort(forest.scores(fit))
    limit = float(np.quantile(seen, 1 - contamination))
    shared = rows.sparkSession.sparkContext.broadcast((forest, seen))
    width = fit.shape[1]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            planes = [array_of(i.as_py()) for i in batch.column("image")]
            own = [(k, pixels.features(pixels.gray(p))) for k, p in zip(batch.column(key).to_pylist(), planes, strict=True) if p is not None]
            # Trees are walked once for a batch, not once for an image.
            got = shared.value[0].scores(np.array([f for _, f in own], float).reshape(-1, width))
            below = np.searchsorted(shared.value[1], got) / len(shared.value[1])
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in own], pa.int64()), pa.array(below), pa.array(got), pa.array(got > limit), pa.array([f for _, f in own], pa.list_(pa.float64()))], names=[key, "score", "raw", "outlier", "features"])

    return rows.select(key, "image").mapInArrow(of, schema)
