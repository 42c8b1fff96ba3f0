"""Rows as HTML, CSV, JSON lines and server-sent events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkspark.functions.hashing import canonical, json_text
from inkspark.functions.text import escaped


def html_row(cells: list[Column]) -> Column:
    return F.concat(F.lit("<tr>"), *(F.concat(F.lit("<td>"), escaped(c), F.lit("</td>")) for c in cells), F.lit("</tr>"))


def html_table(rows: DataFrame, key: str, order: str, row: str, head: list[str]) -> DataFrame:
    """One table for each key; a key's rows are one document's findings."""
    top = "<table><tr>" + "".join(f"<th>{h}</th>" for h in head) + "</tr>"
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, row))), lambda x: x[row]), "")
    return rows.groupBy(key).agg(F.concat(F.lit(top), body, F.lit("</table>")).alias("html"))


def csv_line(fields: list[Column]) -> Column:
    """Every field in double quotes, quotes doubled, CRLF at the end."""
    quoted = [F.concat(F.lit('"'), F.replace(F.coalesce(f, F.lit("")), F.lit('"'), F.lit('""')), F.lit('"')) for f in fields]
    return F.concat(F.concat_ws(",", *quoted), F.lit("\r\n"))


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.csv(path, header=True, quoteAll=True, escape='"', lineSep="\r\n")


def frames(events: DataFrame, key: str) -> DataFrame:
    """Server-sent events of each key in order, and one done frame with their number."""
    body = canonical({"id": F.col("id").cast("string"), "type": json_text(F.col("type"))})
    frame = lambda name, data: F.concat(F.lit("event: "), name, F.lit("\ndata: "), data, F.lit("\n\n"))
    order = Window.partitionBy(key).orderBy("created_at", "id")
    rows = events.select(key, (F.row_number().over(order) - 1).cast("long").alias("position"), frame(F.col("type"), body).alias("frame"))
    done = events.groupBy(key).agg(F.count(F.lit(1)).alias("position"))
    return rows.union(done.select(key, "position", frame(F.lit("done"), F.concat(F.lit('{"count":'), F.col("position").cast("string"), F.lit("}")))))


def log_lines(rows: DataFrame, lead: list[str]) -> DataFrame:
    """One JSON object a row, leading fields first."""
    rest = [c for c in rows.columns if c not in lead]
    return rows.select(F.to_json(F.struct(*lead, *rest)).alias("value"))
