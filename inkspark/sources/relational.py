"""Tables of a relational database as a Spark data source: ``spark.read.format("relational")`` and ``df.write``.

Options: ``url`` (``sqlite:/file`` or ``postgresql://...``, others are refused),
``table``, ``key`` (a unique, indexed column), ``partitions`` (4) and ``page``
(1,000 rows).

Reading: the key's range is cut at keys that lie a partition's share of rows apart,
so partitions are of equal size whatever the keys are. A task reads its range by
pages, each from the last key of the one before, in the order of the key; so no
cursor is held open, a page is what a task holds, and a lost task starts its range
anew. Comparisons with constants, IN and IS NULL go into the statement.

Writing: tasks put their rows into a staging table, marked by the attempt. The
commit moves the rows of the attempts that Spark names to the table, in one
transaction; an abort drops the staging table. So an append is whole or not there,
rows of failed and repeated attempts don't count, and what the table itself
refuses (a key that is there, a guard) refuses the whole append. ``overwrite``
replaces all rows in that transaction.

A SQLite file must be at the same path on all machines. Databases other than
SQLite need their Python driver.
"""

from __future__ import annotations

import datetime
import re
import uuid
from collections.abc import Iterable, Iterator, Sequence
from contextlib import closing
from dataclasses import dataclass
from decimal import Decimal
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import BinaryType, BooleanType, DataType, DateType, DoubleType, LongType, StringType, StructField, StructType, TimestampType

COMPARED = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
#: What a declared type starts with, and its type here; others are text.
KINDS: list[tuple[str, DataType]] = [
    ("INT", LongType()), ("BIGINT", LongType()), ("SMALLINT", LongType()), ("REAL", DoubleType()), ("DOUBLE", DoubleType()), ("FLOAT", DoubleType()),
    ("BOOL", BooleanType()), ("BLOB", BinaryType()), ("BYTEA", BinaryType()), ("TIMESTAMP", TimestampType()), ("DATETIME", TimestampType()), ("DATE", DateType()),
]
WAIT_SECONDS = 60


def connect(url: str) -> tuple[Any, str]:
    """A connection and how its statements mark a parameter."""
    if match := re.fullmatch(r"sqlite:(?://)?(/.+)", url):
        import sqlite3

        return sqlite3.connect(match[1], timeout=WAIT_SECONDS, isolation_level="IMMEDIATE"), "?"
    if url.startswith(("postgresql:", "postgres:")):
        try:
            import psycopg
        except ImportError:
            raise ValueError("PostgreSQL needs the psycopg driver") from None
        return psycopg.connect(url), "%s"
    raise ValueError("not a database this engine knows")


def quoted(name: str) -> str:
    """A table or column as an identifier; anything but letters, digits and underscores is refused."""
    if not re.fullmatch(r"[A-Za-z_]\w*", name, re.ASCII):
        raise ValueError(f"not a name of a table or column: {name!r}")
    return f'"{name}"'


def _kind(declared: str | None) -> DataType:
    return next((t for start, t in KINDS if (declared or "").upper().startswith(start)), StringType())


def _stored(value: Any) -> Any:
    """A value as the database takes it: moments as text in UTC."""
    if isinstance(value, datetime.datetime):
        return value.astimezone(datetime.timezone.utc).isoformat(sep=" ")
    if isinstance(value, datetime.date):
        return value.isoformat()
    if isinstance(value, Decimal):
        return str(value)
    return bytes(value) if isinstance(value, bytearray) else value


def _read(value: Any, kind: DataType) -> Any:
    if value is None:
        return None
    if isinstance(kind, TimestampType) and isinstance(value, str):
        moment = datetime.datetime.fromisoformat(value)
        return moment if moment.tzinfo else moment.replace(tzinfo=datetime.timezone.utc)
    if isinstance(kind, DateType) and isinstance(value, str):
        return datetime.date.fromisoformat(value)
    return bool(value) if isinstance(kind, BooleanType) else value


@dataclass
class KeyRange(InputPartition):
    """Keys over ``low`` (None: from the start) up to ``high`` (None: to the end)."""

    low: Any
    high: Any

    def __init__(self, low: Any, high: Any):
        self.low, self.high = low, high


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType):
        self.url, self.table, self.key = options["url"], quoted(options["table"]), options["key"]
        self.schema, self.n, self.page = schema, int(options.get("partitions", 4)), int(options.get("page", 1000))
        self.where: list[str] = []
        self.values: list[Any] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes what a statement can say of plain columns; the rest stays Spark's."""
        mark = "%s" if self.url.startswith("postgres") else "?"
        for f in filters:
            column = quoted(f.attribute[0]) if len(getattr(f, "attribute", ())) == 1 and f.attribute[0] in self.schema.names else None
            if column and type(f) in COMPARED:
                self.where.append(f"{column} {COMPARED[type(f)]} {mark}")
                self.values.append(_stored(f.value))
            elif column and isinstance(f, In):
                self.where.append(f"{column} in ({', '.join([mark] * len(f.value))})")
                self.values += map(_stored, f.value)
            elif column and isinstance(f, IsNull | IsNotNull):
                self.where.append(f"{column} is {'not ' if isinstance(f, IsNotNull) else ''}null")
            else:
                yield f

    def _conditions(self, more: Sequence[str]) -> str:
        every = [*self.where, *more]
        return f" where {' and '.join(every)}" if every else ""

    def partitions(self) -> Sequence[InputPartition]:
        key = quoted(self.key)
        connection, mark = connect(self.url)
        with closing(connection), closing(connection.cursor()) as cursor:
            cursor.execute(f"select count(*) from {self.table}{self._conditions([])}", self.values)
            n = cursor.fetchone()[0]
            cuts = []
            for i in range(1, min(self.n, n)):
                cursor.execute(f"select {key} from {self.table}{self._conditions([])} order by {key} limit 1 offset {mark}", [*self.values, i * n // self.n - 1])
                cuts.append(cursor.fetchone()[0])
        return [KeyRange(low, high) for low, high in zip([None, *cuts], [*cuts, None], strict=True)]

    def read(self, partition: KeyRange) -> Iterator[tuple]:
        """A range's rows page by page, in the key's order."""
        key, names = quoted(self.key), self.schema.names
        columns = ", ".join(map(quoted, names))
        kinds = [f.dataType for f in self.schema]
        after = partition.low
        connection, mark = connect(self.url)
        with closing(connection), closing(connection.cursor()) as cursor:
            while True:
                more = ([f"{key} > {mark}"] if after is not None else []) + ([f"{key} <= {mark}"] if partition.high is not None else [])
                bounds = [x for x in (after, partition.high) if x is not None]
                cursor.execute(f"select {key}, {columns} from {self.table}{self._conditions(more)} order by {key} limit {mark}", [*self.values, *bounds, self.page])
                rows = cursor.fetchall()
                for row in rows:
                    yield tuple(_read(v, k) for v, k in zip(row[1:], kinds, strict=True))
                if len(rows) < self.page:
                    return
                after = rows[-1][0]


@dataclass
class Staged(WriterCommitMessage):
    attempt: str
    rows: int


class Writer(DataSourceWriter):
    def __init__(self, options: dict[str, str], schema: StructType, overwrite: bool):
        self.url, self.table, self.overwrite = options["url"], options["table"], overwrite
        self.names, self.page = schema.names, int(options.get("page", 1000))
        self.staging = f"{self.table}__{uuid.uuid4().hex}"
        columns = ", ".join(map(quoted, self.names))
        connection, _ = connect(self.url)
        with closing(connection), closing(connection.cursor()) as cursor:
            cursor.execute(f"create table {quoted(self.staging)} as select {columns}, '' as \"__attempt\" from {quoted(self.table)} where 1 = 0")
            connection.commit()

    def write(self, iterator: Iterator) -> Staged:
        attempt, n = uuid.uuid4().hex, 0
        connection, mark = connect(self.url)
        statement = f"insert into {quoted(self.staging)} values ({', '.join([mark] * (len(self.names) + 1))})"
        with closing(connection), closing(connection.cursor()) as cursor:
            page: list[tuple] = []
            for row in iterator:
                page.append((*(_stored(row[c]) for c in self.names), attempt))
                n += 1
                if len(page) == self.page:  # short transactions, since a SQLite file has one writer at a time
                    cursor.executemany(statement, page)
                    connection.commit()
                    page = []
            cursor.executemany(statement, page)
            connection.commit()
        return Staged(attempt, n)

    def commit(self, messages: list[Staged | None]) -> None:
        columns = ", ".join(map(quoted, self.names))
        connection, mark = connect(self.url)
        with closing(connection), closing(connection.cursor()) as cursor:
            try:
                if self.overwrite:
                    cursor.execute(f"delete from {quoted(self.table)}")
                for m in filter(None, messages):
                    cursor.execute(f"insert into {quoted(self.table)} ({columns}) select {columns} from {quoted(self.staging)} where \"__attempt\" = {mark}", [m.attempt])
                cursor.execute(f"drop table {quoted(self.staging)}")
                connection.commit()
            except BaseException:
                connection.rollback()
                raise

    def abort(self, messages: list[Staged | None]) -> None:
        connection, _ = connect(self.url)
        with closing(connection), closing(connection.cursor()) as cursor:
            cursor.execute(f"drop table if exists {quoted(self.staging)}")
            connection.commit()


class Relational(DataSource):
    @classmethod
    def name(cls) -> str:
        return "relational"

    def schema(self) -> StructType:
        """From the table's declared types."""
        connection, _ = connect(self.options["url"])
        with closing(connection), closing(connection.cursor()) as cursor:
            if self.options["url"].startswith("sqlite"):
                cursor.execute(f"pragma table_info({quoted(self.options['table'])})")
                found = [(r[1], r[2]) for r in cursor.fetchall()]
            else:
                cursor.execute("select column_name, data_type from information_schema.columns where table_name = %s order by ordinal_position", [self.options["table"]])
                found = cursor.fetchall()
        if not found:
            raise ValueError(f"no table {self.options['table']}")
        return StructType([StructField(n, _kind(t)) for n, t in found])

    def reader(self, schema: StructType) -> Reader:
        return Reader(dict(self.options), schema)

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(dict(self.options), schema, overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, with filters pushed down to it."""
    spark.dataSource.register(Relational)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
