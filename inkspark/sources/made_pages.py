"""Made-up document pages as a table: one for each row of seeds."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from inkspark.functions import pages

IMAGE = pa.struct([("height", pa.int32()), ("width", pa.int32()), ("nChannels", pa.int32()), ("data", pa.binary())])
FIELDS = pa.schema([("id", pa.int64()), ("image", IMAGE), ("manifest", pa.string()), ("problems", pa.list_(pa.string()))])


def made_pages(seeds: DataFrame) -> DataFrame:
    """id, image, manifest (JSON) and its problems, of rows id, document_type, tampering (array of kinds). Pages are made one at a time."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                page, manifest = pages.make(row["id"], row["document_type"], tuple(row["tampering"] or ()))
                image = {"height": page.shape[0], "width": page.shape[1], "nChannels": page.shape[2], "data": page.tobytes()}
                columns = [[row["id"]], [image], [json.dumps(manifest, sort_keys=True)], [pages.problems(manifest)]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, FIELDS, strict=True)], schema=FIELDS)

    schema = "id long, image struct<height:int,width:int,nChannels:int,data:binary>, manifest string, problems array<string>"
    return seeds.select("id", "document_type", "tampering").mapInArrow(of, schema)
