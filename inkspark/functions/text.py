"""Tokens of a summary, its verification, and texts made from findings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The shapes of numbers, dates and capitalised words.
NUMBER = r"(?<!\w)(\d+(?:\.\d+)?)(?!\w)"
DATE = r"(?<!\w)(\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{2,4})(?!\w)"
CAPITALISED = r"(?<!\w)([A-Z][A-Za-z0-9]*)(?!\w)"


def numbers(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(NUMBER), 1)


def dates(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(DATE), 1)


def capitalised(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(CAPITALISED), 1)


def flag_ids(text: Column, known: list[str]) -> Column:
    """Known flag ids that stand as words in a text, longest first where one is part of another."""
    return F.regexp_extract_all(text, F.lit(r"(?<!\w)(" + "|".join(sorted(known, key=lambda k: (-len(k), k))) + r")(?!\w)"), 1)


def unsupported(summary: Column, printed: Column) -> Column:
    """Numbers and dates of a summary that the printed data doesn't contain, once each."""
    return F.array_distinct(F.filter(F.concat(numbers(summary), dates(summary)), lambda t: ~F.contains(printed, t)))


def verified(summary: Column, printed: Column) -> Column:
    return F.size(unsupported(summary, printed)) == 0


def narration(summary: Column, printed: Column, template: Column) -> Column:
    """A model's text if it is verified, else the template's."""
    return F.when(summary.isNotNull() & verified(summary, printed), summary).otherwise(template)


def one_decimal(score: Column) -> Column:
    """A score with one decimal, .0 left out."""
    return F.regexp_replace(F.format_string("%.1f", F.bround(score, 1)), r"\.0$", "")


def template_summary(band: Column, score: Column, labels: Column) -> Column:
    """A sentence on the band, a headline, one bullet for each finding, and a closing line."""
    head = F.concat(F.lit("Risk band: "), F.coalesce(band, F.lit("not scored")), F.lit(" ("), F.coalesce(one_decimal(score), F.lit("-")), F.lit(")."))
    count = F.concat(F.size(labels).cast("string"), F.when(F.size(labels) == 1, " finding.").otherwise(" findings."))
    bullets = F.array_join(F.transform(labels, lambda x: F.concat(F.lit("\n- "), x)), "")
    return F.concat(head, F.lit("\n"), count, bullets, F.lit("\nAn officer decides."))


def request_id(value: Column, fallback: Column) -> Column:
    """A caller's id if it is 1 to 64 harmless characters, else the fallback."""
    return F.when(value.rlike(r"^[A-Za-z0-9._:-]{1,64}$"), value).otherwise(fallback)


def escaped(text: Column) -> Column:
    """Text for HTML; null reads as not recorded."""
    out = F.coalesce(text, F.lit("not recorded"))
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def completion(url: str, prompt: str, seconds: float, model: str = "local", most: int = 1 << 20) -> str | None:
    """Text of a chat completion from a service, or None: on any failure, and when all of it isn't there within so many seconds."""
    import json
    import time
    import urllib.request

    until = time.monotonic() + seconds
    body = json.dumps({"model": model, "messages": [{"role": "user", "content": prompt}], "stream": False}).encode()
    try:
        request = urllib.request.Request(url, body, {"Content-Type": "application/json"})
        parts, size = [], 0
        with urllib.request.urlopen(request, timeout=seconds) as answer:
            while part := answer.read1(65_536):
                size += len(part)
                if time.monotonic() > until or size > most:
                    return None
                parts.append(part)
        found = json.loads(b"".join(parts))["choices"][0]["message"]["content"].strip()
        return found if found and time.monotonic() <= until else None
    except Exception:
        return None
