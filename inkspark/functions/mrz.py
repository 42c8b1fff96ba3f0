"""Machine-readable zones as column expressions: check digits, layouts, parsing, names.

A zone is an array of lines. All three formats are parsed by one layout table,
so a position is data. A field that can't be read is null, never an error: a
verdict on it is null as well.
"""

from __future__ import annotations

from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The layouts of ICAO 9303 zones. Format, line, field, first and last position (from 1, inclusive).
LAYOUT = [
    ("TD3", 1, "document_code", 1, 2),
    ("TD3", 1, "issuing_state", 3, 5),
    ("TD3", 1, "name", 6, 44),
    ("TD3", 2, "document_number", 1, 9),
    ("TD3", 2, "document_number_check_digit", 10, 10),
    ("TD3", 2, "nationality", 11, 13),
    ("TD3", 2, "date_of_birth", 14, 19),
    ("TD3", 2, "date_of_birth_check_digit", 20, 20),
    ("TD3", 2, "sex", 21, 21),
    ("TD3", 2, "date_of_expiry", 22, 27),
    ("TD3", 2, "date_of_expiry_check_digit", 28, 28),
    ("TD3", 2, "personal_number", 29, 42),
    ("TD3", 2, "personal_number_check_digit", 43, 43),
    ("TD3", 2, "composite_check_digit", 44, 44),
    ("TD1", 1, "document_code", 1, 2),
    ("TD1", 1, "issuing_state", 3, 5),
    ("TD1", 1, "document_number", 6, 14),
    ("TD1", 1, "document_number_check_digit", 15, 15),
    ("TD1", 1, "optional_data_1", 16, 29),
    ("TD1", 1, "optional_data_1_check_digit", 30, 30),
    ("TD1", 2, "date_of_birth", 1, 6),
    ("TD1", 2, "date_of_birth_check_digit", 7, 7),
    ("TD1", 2, "sex", 8, 8),
    ("TD1", 2, "date_of_expiry", 9, 14),
    ("TD1", 2, "date_of_expiry_check_digit", 15, 15),
    ("TD1", 2, "nationality", 16, 18),
    ("TD1", 2, "optional_data_2", 19, 29),
    ("TD1", 2, "composite_check_digit", 30, 30),
    ("TD1", 3, "name", 1, 30),
    ("TD2", 1, "document_code", 1, 2),
    ("TD2", 1, "issuing_state", 3, 5),
    ("TD2", 1, "name", 6, 36),
    ("TD2", 2, "document_number", 1, 9),
    ("TD2", 2, "document_number_check_digit", 10, 10),
    ("TD2", 2, "nationality", 11, 13),
    ("TD2", 2, "date_of_birth", 14, 19),
    ("TD2", 2, "date_of_birth_check_digit", 20, 20),
    ("TD2", 2, "sex", 21, 21),
    ("TD2", 2, "date_of_expiry", 22, 27),
    ("TD2", 2, "date_of_expiry_check_digit", 28, 28),
    ("TD2", 2, "optional_data", 29, 34),
    ("TD2", 2, "optional_data_check_digit", 35, 35),
    ("TD2", 2, "composite_check_digit", 36, 36),
]
# Lines and width of each format, what its composite digit covers (line, first, last), and its document codes.
SHAPES = {"TD1": (3, 30), "TD2": (2, 36), "TD3": (2, 44)}
COMPOSITE = {
    "TD1": [(1, 1, 10), (1, 15, 30), (2, 1, 7), (2, 9, 15), (2, 19, 29)],
    "TD2": [(1, 6, 36), (2, 1, 10), (2, 14, 20), (2, 22, 35)],
    "TD3": [(2, 1, 10), (2, 14, 20), (2, 22, 43)],
}
CODES = {"TD1": ["I<", "I"], "TD2": ["V<", "V"], "TD3": ["P<", "P"]}
CHECKED = {
    "TD1": ["document_number", "date_of_birth", "date_of_expiry", "optional_data_1"],
    "TD2": ["document_number", "date_of_birth", "date_of_expiry", "optional_data"],
    "TD3": ["document_number", "date_of_birth", "date_of_expiry", "personal_number"],
}
# Weights of the check digit, and characters by value.
WEIGHTS = [7, 3, 1]
ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
FIELDS = list(dict.fromkeys(f for _, _, f, _, _ in LAYOUT))


def char_value(c: Column) -> Column:
    """0 to 35 of a character, 0 of filler, null of anything else."""
    at = F.instr(F.lit(ALPHABET), c)
    return F.when(c == "<", 0).when((F.char_length(c) == 1) & (at > 0), at - 1)


def check_digit(text: Column) -> Column:
    """Weighted sum of the characters' values modulo 10; null if one can't be read.

    Only a value's last digit counts, so characters become digits in one pass.
    """
    digits = F.translate(text, ALPHABET + "<", "".join(str(i % 10) for i in range(len(ALPHABET))) + "0")
    weight = lambda i: F.when(i % 3 == 0, WEIGHTS[0]).when(i % 3 == 1, WEIGHTS[1]).otherwise(WEIGHTS[2])
    total = F.aggregate(F.transform(F.split(digits, ""), lambda c, i: c.cast("int") * weight(i)), F.lit(0), lambda a, x: a + x)
    return F.when(text == "", 0).when(text.rlike(f"^[{ALPHABET}<]*$"), (total % 10).cast("int"))


def printed_digit(text: Column) -> Column:
    """The digit 0 to 9 that a character prints, else null."""
    return F.when(text.rlike("^[0-9]$"), text).cast("int")


def verdict(text: Column, printed: Column) -> Column:
    """expected (printed), found (computed) and passed; passed is null if either can't be read."""
    expected, found = printed_digit(printed), check_digit(text)
    return F.struct(expected.alias("expected"), found.alias("found"), (expected == found).alias("passed"))


def detect_format(lines: Column) -> Column:
    """TD1, TD2 or TD3 by number and common width of lines, else null."""
    widths = F.array_distinct(F.transform(lines, lambda x: F.char_length(x)))
    found = F.lit(None).cast("string")
    for name, (count, width) in SHAPES.items():
        found = F.when((F.size(lines) == count) & (F.size(widths) == 1) & (F.get(widths, 0) == width), F.lit(name)).otherwise(found)
    return found


def span(lines: Column, line: int, first: int, last: int) -> Column:
    return F.substring(F.get(lines, line - 1), first, last - first + 1)


def field(lines: Column, form: Column, name: str) -> Column:
    """A field's characters as printed; null where the format has no such field."""
    found = F.lit(None).cast("string")
    for f, line, field_name, first, last in LAYOUT:
        if field_name == name:
            found = F.when(form == f, span(lines, line, first, last)).otherwise(found)
    return found


def composite(lines: Column, form: Column) -> Column:
    """The characters that the composite digit covers."""
    found = F.lit(None).cast("string")
    for f, spans in COMPOSITE.items():
        found = F.when(form == f, F.concat(*(span(lines, *s) for s in spans))).otherwise(found)
    return found


def parse(zones: DataFrame, lines: str = "lines") -> DataFrame:
    """Adds format and one column for each field of any layout."""
    with_format = zones.withColumn("format", detect_format(F.col(lines)))
    return with_format.select("*", *(field(F.col(lines), F.col("format"), f).alias(f) for f in FIELDS))


def verdicts(parsed: DataFrame, lines: str = "lines") -> Column:
    """Array of (field, expected, found, passed) of a parsed zone, the composite last. Each digit is computed once."""
    parts = []
    part = lambda name, text, printed: F.struct(F.lit(name).alias("field"), text.alias("text"), printed.alias("printed"))
    for name in dict.fromkeys(f for fs in CHECKED.values() for f in fs):
        has = reduce(lambda a, b: a | b, (F.col("format") == k for k, fs in CHECKED.items() if name in fs))
        parts.append(F.when(has, part(name, F.col(name), F.col(f"{name}_check_digit"))))
    parts.append(F.when(F.col("format").isNotNull(), part("composite", composite(F.col(lines), F.col("format")), F.col("composite_check_digit"))))
    both = F.transform(F.array_compact(F.array(*parts)), lambda p: F.struct(p["field"].alias("field"), printed_digit(p["printed"]).alias("expected"), check_digit(p["text"]).alias("found")))
    return F.transform(both, lambda v: F.struct(v["field"].alias("field"), v["expected"].alias("expected"), v["found"].alias("found"), (v["expected"] == v["found"]).alias("passed")))


# Names


def name_parts(name: Column) -> Column:
    """surname and given names: what stands before and after the first <<, each with single spaces for filler."""
    words = lambda x: F.array_join(F.filter(F.split(x, "<"), lambda w: w != ""), " ")
    at = F.instr(name, "<<")
    surname = F.when(at > 0, F.substring(name, F.lit(1), at - 1)).otherwise(name)
    given = F.when(at > 0, F.substring(name, at + 2, F.char_length(name))).otherwise("")
    return F.struct(words(surname).alias("surname"), words(given).alias("given_names"))


def compact_name(name: Column) -> Column:
    """Upper case without filler and white space."""
    return F.upper(F.regexp_replace(name, r"[<\s]", ""))


# Letters that have no decomposition.
WHOLE_LETTERS = {"ß": "SS", "Ø": "O", "Ł": "L", "Đ": "D"}


@lru_cache(maxsize=1)
def _accented() -> tuple[str, str]:
    """All capitals of the basic plane that decompose into a capital from A to Z and marks, or into a letter without a decomposition and marks, with that letter."""
    import unicodedata

    found = {}
    for code in range(0xC0, 0x10000):
        base = unicodedata.normalize("NFD", chr(code))
        if len(base) > 1 and all(unicodedata.category(c) == "Mn" for c in base[1:]):
            letter = WHOLE_LETTERS.get(base[0], base[0])
            if len(letter) == 1 and "A" <= letter <= "Z":
                found[chr(code)] = letter
    return "".join(found), "".join(found.values())


def transliterate(name: Column) -> Column:
    """Capitals without diacritics, by rule: decompose, drop combining marks."""
    upper = F.upper(name)
    for letter, other in WHOLE_LETTERS.items():
        upper = F.replace(upper, F.lit(letter), F.lit(other))
    return F.regexp_replace(F.translate(upper, *_accented()), r"\p{Mn}", "")


OPTIONAL_WIDTHS = {"optional_data_1": 14, "optional_data_2": 11}


def optional_data(text: Column, name: str) -> Column:
    """The characters of an optional field without filler, '' if it is all filler; null if its width or an unreadable character is wrong."""
    sound = (F.char_length(text) == OPTIONAL_WIDTHS[name]) & text.rlike(f"^[{ALPHABET}<]*$")
    return F.when(sound, F.rtrim(F.translate(text, "<", " ")))


def valid_fields(parsed_format: str) -> dict[str, Column]:
    """Whether each field of a parsed zone has the form that its format asks for."""
    letters = lambda f: F.col(f).rlike("^[A-Z]{3}$")
    date = lambda f: F.col(f).rlike("^[0-9]{6}$")
    sexes = "^[MFX<]$" if parsed_format == "TD3" else "^[MF<]$"
    return {
        "document_code": F.rtrim(F.col("document_code")).isin(CODES[parsed_format]),
        "issuing_state": letters("issuing_state"),
        "nationality": letters("nationality"),
        "document_number": F.col("document_number").rlike("[^<]"),
        "date_of_birth": date("date_of_birth"),
        "date_of_expiry": date("date_of_expiry"),
        "sex": F.col("sex").rlike(sexes),
    }
