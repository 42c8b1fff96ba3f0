"""The commit log, and anchoring by a stream on it: writers, restarts and kills."""

import datetime
import hashlib
import threading

import pytest

from inkspark.functions import ed25519
from inkspark.operators import ledger
from inkspark.sources.commits import CommitLog, KeyRefused
from inkspark.streaming import anchor

ENTRY = ("batch bigint, root string", ["batch"])
SECRET = bytes(range(32))


def log_of(spark, tmp_path):
    return CommitLog(spark, str(tmp_path / "log"), {"ledger": ENTRY})


def entry(spark, *batches, root="r"):
    return {"ledger": spark.createDataFrame([(b, root) for b in batches], "batch bigint, root string")}


def batches(log, version=None):
    return sorted(r["batch"] for r in log.read("ledger", version).collect())


def test_snapshots_and_refusals(spark, tmp_path):
    log = log_of(spark, tmp_path)
    assert batches(log) == [] and log.version() == 0
    assert log.append(entry(spark, 1, 2)) == 0
    assert log.append(entry(spark, 3)) == 1
    assert batches(log) == [1, 2, 3] and batches(log, 1) == [1, 2] and batches(log, 0) == []
    with pytest.raises(KeyRefused):
        log.append(entry(spark, 9, 2))
    with pytest.raises(KeyRefused):
        log.append(entry(spark, 7, 7))
    assert batches(log_of(spark, tmp_path)) == [1, 2, 3]
    assert len(log.unreferenced()) == 2
    assert log.append(entry(spark, 4), "once") == log.append(entry(spark, 5), "once") == 2
    assert batches(log) == [1, 2, 3, 4]
    assert log.append({"ledger": spark.createDataFrame([], ENTRY[0])}) == 3 and batches(log) == [1, 2, 3, 4]


def test_two_writers_of_one_key(spark, tmp_path):
    """Both look before either commits: one row, one refusal. Writers of different keys both get in."""
    log_of(spark, tmp_path).append(entry(spark, 0))
    outcomes, ready = [], threading.Barrier(2)

    class Slow(CommitLog):
        waited = False

        def _put(self, number, body):
            if not self.waited:
                self.waited = True
                ready.wait(60)
            return super()._put(number, body)

    def write(batch, root):
        log = Slow(spark, str(tmp_path / "log"), {"ledger": ENTRY})
        try:
            outcomes.append(log.append(entry(spark, batch, root=root)))
        except KeyRefused:
            outcomes.append("refused")

    for wanted in ((7, 7), (8, 9)):
        ready.reset()
        writers = [threading.Thread(target=write, args=(b, f"writer {i}")) for i, b in enumerate(wanted)]
        for w in writers:
            w.start()
        for w in writers:
            w.join(120)
    assert outcomes[:2].count("refused") == 1 and "refused" not in outcomes[2:]
    assert batches(log_of(spark, tmp_path)) == [0, 7, 8, 9]


def test_known_keys_are_left_out_on_request(spark, tmp_path):
    log = log_of(spark, tmp_path)
    log.append(entry(spark, 1, 2))
    rows = spark.createDataFrame([(2, "new"), (3, "z"), (3, "a"), (None, "x")], "batch bigint, root string")
    assert log.append({"ledger": rows}, skip_known=True) == 1
    assert sorted(map(tuple, log.read("ledger").collect())) == [(1, "r"), (2, "r"), (3, "a")]
    other = log_of(spark, tmp_path)
    put = log._put

    def late(number, body):
        """Another writer commits one of the keys just before."""
        log._put = put
        other.append(entry(spark, 5, root="faster"))
        return put(number, body)

    log._put = late
    log.append(entry(spark, 4, 5, root="slower"), skip_known=True)
    assert sorted(map(tuple, log.read("ledger").collect()))[3:] == [(4, "slower"), (5, "faster")]


def test_a_number_is_put_once(spark, tmp_path):
    log = log_of(spark, tmp_path)
    log.version()
    assert [log._put(0, "{}"), log._put(0, "{}"), log._put(1, "{}")] == [True, False, True]


def events(n, start=0):
    at = datetime.datetime(2024, 1, 1)
    return [(i, at + datetime.timedelta(seconds=(i * 7919) % 1000), hashlib.sha256(str(i).encode()).hexdigest()) for i in range(start, start + n)]


EVENTS = "id bigint, created_at timestamp, digest string"


def source(spark, tmp_path, *groups):
    for g in groups:
        spark.createDataFrame(g, EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "events"))
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "events"))


def run(spark, tmp_path, name="anchoring"):
    log = anchor.open_log(spark, str(tmp_path / "log"))
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "events"))
    q = anchor.anchoring(stream, log, SECRET, str(tmp_path / name), name, availableNow=True)
    try:
        assert q.awaitTermination(180)
    finally:
        q.stop()
    return log


def state(log):
    return sorted(map(tuple, log.read("stamps").collect())), sorted(tuple(r)[:4] for r in log.read("ledger").collect())


def test_a_killed_stream_goes_on(spark, tmp_path, monkeypatch):
    """Killed before a commit and, another time, between a commit and the stream's own note of it: the same entries as without, no event twice."""
    source(spark, tmp_path, events(60), events(30, 60), events(10, 90))
    (tmp_path / "plain").mkdir()
    source(spark, tmp_path / "plain", events(60), events(30, 60), events(10, 90))
    want = state(run(spark, tmp_path / "plain"))
    append, calls = CommitLog.append, []

    def dying(self, rows, transaction=None):
        calls.append(transaction)
        if len(calls) == 2:
            raise OSError("killed before the commit")
        number = append(self, rows, transaction)
        if len(calls) == 4:
            raise OSError("killed after the commit")
        return number

    monkeypatch.setattr(CommitLog, "append", dying)
    for _ in range(2):
        with pytest.raises(Exception, match="killed"):
            run(spark, tmp_path)
    log = run(spark, tmp_path)
    stamps, entries = state(log)
    assert calls[1] == calls[2] and calls[3] == calls[4]  # the same micro-batch came again
    assert [s[0] for s in stamps] == list(range(100))
    assert (stamps, entries) == want
    assert sorted(e[1] for e in entries) == [5, 10, 10, 25, 25, 25] or sum(e[1] for e in entries) == 100


def test_entries_are_the_roots_of_their_events(spark, tmp_path):
    source(spark, tmp_path, events(40), events(40, 20))  # twenty events come twice
    log = run(spark, tmp_path)
    stamps, entries = state(log)
    assert [s[0] for s in stamps] == list(range(60))
    rows = spark.createDataFrame(events(60), EVENTS).join(log.read("stamps"), "id")
    want = {r["batch"]: (r["n_leaves"], r["merkle_root"]) for r in ledger.roots(rows).collect()}
    assert {e[0]: e[1:3] for e in entries} == want
    assert all(ed25519.verify(ed25519.public_key(SECRET), bytes.fromhex(e[2]), bytes.fromhex(e[3])) for e in entries)
    order = {r["id"]: r["created_at"] for r in rows.collect()}
    for batch in want:
        own = [s for s in sorted(stamps, key=lambda s: s[2]) if s[1] == batch]
        assert [s[2] for s in own] == list(range(len(own)))
        assert [s[0] for s in own] == sorted((s[0] for s in own), key=lambda i: (order[i], i))


def test_two_streams_share_the_log(spark, tmp_path):
    """A second stream over the same events anchors nothing again; a bad digest stops a stream and leaves nothing."""
    source(spark, tmp_path, events(30))
    before = state(run(spark, tmp_path))
    assert state(run(spark, tmp_path, "another")) == before
    source(spark, tmp_path, [(500, datetime.datetime(2024, 1, 1), "no digest")])
    with pytest.raises(Exception, match="no digest"):
        run(spark, tmp_path)
    assert state(anchor.open_log(spark, str(tmp_path / "log"))) == before
