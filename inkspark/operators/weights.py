"""The closed domain of evidence flags with their weights and bands."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

RULESET_VERSION = "0.2.0"
# Flag, weight, band.
WEIGHTS = [
    ("QUALITY_BLUR", 5, "low"),
    ("QUALITY_NOISE", 5, "low"),
    ("QUALITY_EXPOSURE", 5, "low"),
    ("QUALITY_UNEVEN_LIGHTING", 5, "low"),
    ("QUALITY_GLARE", 5, "low"),
    ("QUALITY_LOW_RESOLUTION", 5, "low"),
    ("QUALITY_SKEW", 5, "low"),
    ("QUALITY_LOW_COVERAGE", 5, "low"),
    ("QUALITY_CROPPED", 5, "low"),
    ("MRZ_DOCUMENT_NUMBER_CHECK_DIGIT_MISMATCH", 65, "high"),
    ("MRZ_DOB_CHECK_DIGIT_MISMATCH", 60, "high"),
    ("MRZ_EXPIRY_CHECK_DIGIT_MISMATCH", 60, "high"),
    ("MRZ_OPTIONAL_DATA_CHECK_DIGIT_MISMATCH", 55, "high"),
    ("MRZ_COMPOSITE_CHECK_DIGIT_MISMATCH", 65, "high"),
    ("DATE_EXPIRED", 55, "high"),
    ("DATE_NOT_YET_VALID", 30, "review"),
    ("DATE_IMPLAUSIBLE_DOB", 55, "high"),
    ("DATE_ISSUE_AFTER_EXPIRY", 40, "review"),
    ("DATE_IMPOSSIBLE", 40, "review"),
    ("WATCHLIST_HIT", 65, "high"),
    ("WATCHLIST_STOLEN_DOCUMENT", 55, "high"),
    ("WATCHLIST_IDENTITY_SEEN", 35, "review"),
    ("OCR_MRZ_MISMATCH", 55, "high"),
    ("OCR_LOW_CONFIDENCE", 15, "low"),
    ("OCR_BARCODE_MISMATCH", 40, "review"),
    ("LAYOUT_DEVIATION", 15, "low"),
    ("FACE_LOW_SIMILARITY", 40, "review"),
    ("FACE_MISMATCH", 60, "high"),
    ("TAMPER_ELA_ANOMALY", 40, "review"),
    ("TAMPER_NOISE_RESIDUAL_ANOMALY", 40, "review"),
    ("TAMPER_COPY_MOVE_ANOMALY", 40, "review"),
    ("TAMPER_FUSION_ANOMALY", 60, "high"),
    ("TAMPER_STAMP_ANOMALY", 30, "review"),
    ("TAMPER_MORPH_SUSPECTED", 65, "high"),
    ("TAMPER_DEEPFAKE_SUSPECTED", 65, "high"),
    ("TAMPER_OUT_OF_DISTRIBUTION", 55, "high"),
    ("CROSSDOC_NAME_MISMATCH", 30, "review"),
    ("CROSSDOC_UNKNOWN_PASSPORT_REFERENCE", 40, "review"),
    ("CROSSDOC_VALIDITY_WINDOW_MISMATCH", 40, "review"),
    ("CROSSDOC_FACE_MISMATCH", 65, "high"),
]
FLAG_IDS = [w[0] for w in WEIGHTS]


def weightset(spark: SparkSession) -> DataFrame:
    """One row a flag: ruleset_version, id, weight, weight_band."""
    return spark.createDataFrame([(RULESET_VERSION, i, float(w), b) for i, w, b in WEIGHTS], "ruleset_version string, id string, weight double, weight_band string")
