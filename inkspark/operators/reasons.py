"""What an officer reads for each flag."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The sentence of each flag.
REASONS = [
    ("QUALITY_BLUR", "The photograph is too blurred to read, so nothing on the page could be checked from it."),
    ("QUALITY_NOISE", "The photograph carries heavy camera noise, which makes the fine print on the page harder to read."),
    ("QUALITY_EXPOSURE", "The photograph is under- or over-exposed, so part of the page is lost in shadow or washed out."),
    ("QUALITY_UNEVEN_LIGHTING", "The page is lit unevenly, so one part of it reads darker than the rest."),
    ("QUALITY_GLARE", "A reflection covers part of the card and hides what is underneath it."),
    ("QUALITY_LOW_RESOLUTION", "The photograph resolves too little detail to read the print at the size it was meant to be read."),
    ("QUALITY_SKEW", "The page was captured off its own plane, so its lines run at an angle no reading of it expects."),
    ("QUALITY_LOW_COVERAGE", "The card fills too little of the frame to be read out of what was captured."),
    ("QUALITY_CROPPED", "An edge of the card is cut off, so part of the page is not in the frame at all."),
    ("MRZ_DOCUMENT_NUMBER_CHECK_DIGIT_MISMATCH", "The check digits printed over the document number do not match the number printed beneath them."),
    ("MRZ_DOB_CHECK_DIGIT_MISMATCH", "The check digits printed over the date of birth do not match that date."),
    ("MRZ_EXPIRY_CHECK_DIGIT_MISMATCH", "The check digits printed over the date of expiry do not match that date."),
    ("MRZ_OPTIONAL_DATA_CHECK_DIGIT_MISMATCH", "The check digits printed over the optional data do not match the optional data."),
    ("MRZ_COMPOSITE_CHECK_DIGIT_MISMATCH", "The single check digit printed over the whole machine-readable zone does not match what that zone spells out."),
    ("DATE_EXPIRED", "The printed date of expiry falls before the date the scan compared it against."),
    ("DATE_NOT_YET_VALID", "The printed validity of the document has not opened yet on the date the scan compared it against."),
    ("DATE_IMPLAUSIBLE_DOB", "The printed date of birth is in the future, or implies an age no living person could have reached."),
    ("DATE_ISSUE_AFTER_EXPIRY", "The printed date of issue falls after the printed date of expiry."),
    ("DATE_IMPOSSIBLE", "The printed date cannot exist, so the field was not read as a real date."),
    ("WATCHLIST_HIT", "The document number appears on the blacklist this deployment checks against."),
    ("WATCHLIST_STOLEN_DOCUMENT", "The document number is recorded as stolen."),
    ("WATCHLIST_IDENTITY_SEEN", "The same name and date of birth were screened here before."),
    ("OCR_MRZ_MISMATCH", "A field read off the printed page disagrees with the same field in the machine-readable zone."),
    ("OCR_LOW_CONFIDENCE", "A field is still read with low confidence after a second look, so what it says may be wrong."),
    ("OCR_BARCODE_MISMATCH", "The barcode payload disagrees with the field printed beside it."),
    ("LAYOUT_DEVIATION", "A field sits outside the place the document template puts it."),
    ("FACE_LOW_SIMILARITY", "The photograph and the live capture are not similar enough for the match to be read as the same person."),
    ("FACE_MISMATCH", "The photograph and the live capture are the same person as far as the comparison can tell, and they disagree."),
    ("TAMPER_ELA_ANOMALY", "Error-level analysis found a block of the image that recompresses differently from the rest of it."),
    ("TAMPER_NOISE_RESIDUAL_ANOMALY", "Noise-residual analysis found local variation that the paper around it does not have."),
    ("TAMPER_COPY_MOVE_ANOMALY", "Self-similarity matching found a region of the page duplicated somewhere else on it."),
    ("TAMPER_FUSION_ANOMALY", "The three forensic modules together scored this page outside the range they agree on."),
    ("TAMPER_STAMP_ANOMALY", "A stamp on the page disagrees with the stamp templates this deployment holds."),
    ("TAMPER_MORPH_SUSPECTED", "The morph classifier scored this photograph as a face that has been altered."),
    ("TAMPER_DEEPFAKE_SUSPECTED", "The synthetic-image classifier scored this photograph as generated rather than photographed."),
    ("TAMPER_OUT_OF_DISTRIBUTION", "This page looks unlike every forgery style the anomaly detector was trained on."),
    ("CROSSDOC_NAME_MISMATCH", "The same person's name is written differently across two documents in this case."),
    ("CROSSDOC_UNKNOWN_PASSPORT_REFERENCE", "A visa in this case refers to a passport number that is not among the documents in the case."),
    ("CROSSDOC_VALIDITY_WINDOW_MISMATCH", "A document's validity window does not cover the travel date written on the other document."),
    ("CROSSDOC_FACE_MISMATCH", "The same face does not match across two documents in this case, or the comparison could not be made and said so."),
]


def with_reason(flags: DataFrame) -> DataFrame:
    """Flags with their sentence, by a closed table of forty rows."""
    table = flags.sparkSession.createDataFrame(REASONS, "__flag string, reason string")
    return flags.join(F.broadcast(table), flags["id"] == table["__flag"], "left").drop("__flag")
