"""The relational source and sink on SQLite: round trips, ranges, pushed filters, aborted and refused writes."""

import datetime
import sqlite3

import pytest

from inkspark.sources import relational, store

UTC = datetime.timezone.utc


@pytest.fixture
def db(spark, tmp_path):
    path = str(tmp_path / "store.db")
    with sqlite3.connect(path) as c:
        c.execute("create table events (id text primary key, n integer, score real, ok boolean, body blob, created_at timestamp)")
        c.execute("create table log (batch bigint primary key, root text)")
        for statement in (x.replace("ledger", "log") for x in store.guards("sqlite") if "ledger" in x):
            c.execute(statement)
    relational.register(spark)
    return path


def options(path, table, key, **more):
    return {"url": f"sqlite:{path}", "table": table, "key": key} | {k: str(v) for k, v in more.items()}


def rows(n):
    at = datetime.datetime(2024, 1, 1, tzinfo=UTC)
    return [(f"{(i * 7919) % 1000:04d}", i if i % 7 else None, i / 3, i % 2 == 0, bytes([i % 256]), at + datetime.timedelta(seconds=i)) for i in range(n)]


SCHEMA = "id string, n long, score double, ok boolean, body binary, created_at timestamp"


def plain(frame):
    return sorted((r["id"], r["n"], r["score"], r["ok"], bytes(r["body"]), r["created_at"]) for r in frame.select(*SCHEMA.replace(",", "").split()[::2]).collect())


def write(frame, path, table="events", key="id", mode="append", **more):
    frame.write.format("relational").options(**options(path, table, key, **more)).mode(mode).save()


def test_round_trip_in_ranges(spark, db):
    given = spark.createDataFrame(rows(950), SCHEMA).repartition(4)
    write(given, db, page=100)
    back = spark.read.format("relational").options(**options(db, "events", "id", partitions=4, page=50)).load()
    assert back.schema == given.schema
    assert back.rdd.getNumPartitions() == 4
    sizes = back.rdd.glom().map(len).collect()
    assert sum(sizes) == 950 and max(sizes) - min(sizes) <= 1
    parts = back.rdd.glom().map(lambda p: [r["id"] for r in p]).collect()
    assert [x for p in parts for x in p] == sorted(r[0] for r in rows(950))
    assert plain(back) == plain(given)
    with sqlite3.connect(db) as c:
        assert [r[0] for r in c.execute("select name from sqlite_master where type = 'table' order by 1")] == ["events", "log"]


def test_filters_are_in_the_statement(spark, db, tmp_path):
    write(spark.createDataFrame(rows(300), SCHEMA), db)
    reader = relational.Reader(options(db, "events", "id"), relational.Relational(options(db, "events", "id")).schema())
    from pyspark.sql.datasource import EqualTo, GreaterThan, In, IsNull, StringContains

    left = list(reader.pushFilters([GreaterThan(("n",), 250), In(("n",), (251, 253, 7)), StringContains(("id",), "1")]))
    assert left == [StringContains(("id",), "1")]
    assert [r[1] for p in reader.partitions() for r in reader.read(p)] == sorted([251, 253], key=lambda n: f"{n * 7919 % 1000:04d}")
    assert list(relational.Reader(options(db, "events", "id"), reader.schema).pushFilters([EqualTo(("id",), "x' or 1=1 --"), IsNull(("n",))])) == []
    back = spark.read.format("relational").options(**options(db, "events", "id")).load()
    assert sorted(r["n"] for r in back.filter("n > 290 and n <> 295").collect()) == [291, 292, 293, 296, 297, 298, 299]
    assert back.filter("n is null").count() == len([r for r in rows(300) if r[1] is None])
    moment = datetime.datetime(2024, 1, 1, 0, 4, tzinfo=UTC)
    assert back.filter(back["created_at"] >= moment).count() == 60
    assert back.filter("id = '0000' and ok").count() == 1


def test_an_aborted_write_leaves_nothing(spark, db):
    from pyspark.sql import functions as F

    write(spark.createDataFrame(rows(10), SCHEMA), db)
    bad = spark.createDataFrame(rows(200)[100:], SCHEMA).repartition(4)
    bad = bad.withColumn("n", F.when(F.col("id") == rows(200)[150][0], F.raise_error(F.lit("torn")).cast("long")).otherwise(F.col("n")))
    with pytest.raises(Exception, match="torn"):
        write(bad, db, page=5)
    with sqlite3.connect(db) as c:
        assert c.execute("select count(*) from events").fetchone()[0] == 10
        assert c.execute("select count(*) from sqlite_master where name like 'events\\_\\_%' escape '\\'").fetchone()[0] == 0


def test_a_refused_row_refuses_the_append(spark, db):
    """A key that is there refuses all new rows; the log's own guards refuse an overwrite."""
    entries = lambda *bs: spark.createDataFrame([(b, "r") for b in bs], "batch long, root string")
    write(entries(1, 2), db, "log", "batch")
    with pytest.raises(Exception, match="UNIQUE"):
        write(entries(3, 2), db, "log", "batch")
    with pytest.raises(Exception, match="append-only"):
        write(entries(9), db, "log", "batch", "overwrite")
    back = spark.read.format("relational").options(**options(db, "log", "batch", partitions=9)).load()
    assert sorted(r["batch"] for r in back.collect()) == [1, 2]
    write(spark.createDataFrame(rows(20), SCHEMA), db)
    write(spark.createDataFrame(rows(3), SCHEMA), db, mode="overwrite")
    assert spark.read.format("relational").options(**options(db, "events", "id")).load().count() == 3


def test_repeated_attempts_count_once(spark, db):
    writer = relational.Writer(options(db, "log", "batch"), spark.createDataFrame([], "batch long, root string").schema, False)
    first, again = (writer.write(iter([{"batch": 5, "root": "r"}])) for _ in range(2))
    assert first.rows == again.rows == 1
    writer.commit([again, None])
    with sqlite3.connect(db) as c:
        assert c.execute("select batch from log").fetchall() == [(5,)]


def test_unknown_databases_and_names(spark, db):
    for url in ("mysql://x/y", "sqlite:relative.db", ""):
        with pytest.raises(ValueError, match="know"):
            relational.connect(url)
    for name in ("a b", 'x"; drop table log; --', "1a", ""):
        with pytest.raises(ValueError, match="name"):
            relational.quoted(name)
    with pytest.raises(ValueError, match="no table"):
        relational.Relational(options(db, "nothing", "id")).schema()
    empty = spark.read.format("relational").options(**options(db, "events", "id")).load()
    assert empty.count() == 0
