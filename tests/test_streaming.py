"""The stream ends where the batch does, and a batch run twice changes nothing."""

import time

import pytest

from tallyloom.operators.replicate import resolve
from tallyloom.streaming import feed, spending, steady, worker

SCHEMA = "kind string, id long, updated_at long, deleted_at long, rev long, payload string"


def log(spark):
    rows = [("r", i % 5, i * 7 % 11, 0 if i % 3 else i, i, str(i)) for i in range(1, 40)]
    return spark.createDataFrame(rows, SCHEMA)


def test_stream_equals_batch(spark, tmp_path):
    path = str(tmp_path / "log")
    df = log(spark)
    df.where("rev <= 20").coalesce(1).write.parquet(path)
    latest = feed.Latest(spark, str(tmp_path / "state"))
    for part in (None, df.where("rev > 20")):
        if part is not None:
            part.coalesce(1).write.mode("append").parquet(path)
        feed.follow(feed.read_log(spark, path, df.schema), latest, str(tmp_path / "check")).awaitTermination()
    assert sorted(map(tuple, latest.read().select(*df.columns).collect())) == sorted(map(tuple, resolve(df).select(*df.columns).collect()))
    before = latest.version()
    latest(df.where("rev = 1"), before)  # the same batch again
    assert latest.version() == before
    assert sum(n.startswith("manifest-") for n in latest._names()) <= 2


def test_a_batch_that_dies_before_its_manifest_loses_nothing(spark, tmp_path, monkeypatch):
    df = log(spark)
    latest = feed.Latest(spark, str(tmp_path / "state"), buckets=4)
    latest(df.where("rev <= 20"), 0)
    before = sorted(map(tuple, latest.read().collect()))

    def die(*_):
        raise OSError("killed")

    with monkeypatch.context() as m:
        m.setattr(feed.Latest, "publish", die)
        with pytest.raises(OSError):
            latest(df.where("rev > 20"), 1)
    again = feed.Latest(spark, str(tmp_path / "state"), buckets=4)
    assert again.version() == 0 and sorted(map(tuple, again.read().collect())) == before
    again(df.where("rev > 20"), 1)
    assert sorted(map(tuple, again.read().select(*df.columns).collect())) == sorted(map(tuple, resolve(df).select(*df.columns).collect()))
    again(df.limit(0), 2)  # an empty batch moves on and keeps all
    assert again.version() == 2 and again.read().count() == 5


def test_only_touched_buckets_are_written(spark, tmp_path):
    df = log(spark)
    latest = feed.Latest(spark, str(tmp_path / "state"), buckets=16)
    latest(df, 0)
    was = latest.manifest(0).tables["records"]
    latest(spark.createDataFrame([("r", 1, 10**6, 0, 99, "new")], SCHEMA), 1)
    now = latest.manifest(1).tables["records"]
    assert [len(now[b]) - len(was[b]) for b in was if now[b] != was[b]] == [1]  # one folder more in one bucket
    assert latest.read().where("payload = 'new'").count() == 1


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def test_buckets_grow_merge_and_are_remembered(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(feed.Latest, "ROWS", 10)
    monkeypatch.setattr(feed.Latest, "MOST_PARTS", 3)
    latest, every = feed.Latest(spark, str(tmp_path / "state"), buckets=2), []
    for batch in range(8):
        every += [("r", (i * 7 + batch) % (20 * (batch + 1)), i % 5 + batch, 0, 1000 * batch + i, str(i)) for i in range(30)]
        latest = feed.Latest(spark, str(tmp_path / "state"), buckets=3)  # the stored number counts, but for the first batch
        latest(spark.createDataFrame(every[-30:], SCHEMA), batch)
        df = spark.createDataFrame(every, SCHEMA)
        assert rows_of(latest.read().select(*df.columns)) == rows_of(resolve(df).select(*df.columns))
        m = latest.manifest()
        assert all(len(fs) < 3 for fs in m.tables["records"].values()) and int(max(m.tables["records"], key=int)) < m.notes["buckets"]
    assert m.notes["buckets"] == 12 and m.notes["rows"] <= 240


def spent(rows):
    """Sums of the final state, plainly. rows: (kind, id, owner, updated, deleted, payload)."""
    import json
    from decimal import Decimal

    last = {}
    for kind, i, owner, updated, deleted, payload in rows:
        v = (updated, deleted != 0, payload)
        if (kind, i) not in last or v > last[kind, i][0]:
            last[kind, i] = (v, owner)
    live = {k: (o, json.loads(v[2])) for k, (v, o) in last.items() if not v[1]}
    out = {}

    def put(by, key, amount):
        total, n = out.get((by, key), (Decimal(0), 0))
        out[by, key] = (total + Decimal(str(amount or 0)), n + 1)

    for (kind, i), (owner, p) in live.items():
        if kind == "receipts":
            put("month", (p.get("purchased_at") or "okänt")[:7], p.get("total"))
            put("merchant", p.get("merchant") or "Okänd butik", p.get("total"))
        elif ("receipts", owner) in live and not p.get("is_discount") and not p.get("is_deposit"):
            put("category", p.get("category_id"), p.get("total_price"))
    return {k: (float(t), n) for k, (t, n) in out.items()}


def test_sums_follow_inserts_changes_deletions_and_restorations(spark, tmp_path, monkeypatch):
    import json
    import random

    monkeypatch.setattr(feed.Latest, "MOST_PARTS", 3)
    rng = random.Random(4)
    kept, every = spending.Spending(spark, str(tmp_path / "s"), buckets=2), []
    for batch in range(6):
        new = []
        for _ in range(25):
            r = str(rng.randrange(12))
            day = rng.choice(["2024-01-05", "2024-02-01", None])
            head = {"purchased_at": day, "total": rng.choice([1.25, 10, None, -3]), "merchant": rng.choice(["A", "B", None])}
            line = {"category_id": rng.choice(["x", "y", None]), "total_price": rng.randrange(400) / 100, "is_discount": rng.random() < 0.2, "is_deposit": rng.random() < 0.2}
            receipt = rng.random() < 0.5
            new.append(("receipts" if receipt else "items", r if receipt else f"{r}-{rng.randrange(3)}", r, rng.randrange(9) + batch, rng.choice([0, 0, 7]), json.dumps(head if receipt else line)))
        every += new
        rows = [(k, i, o, u, dl, 100 * batch + j, p) for j, (k, i, o, u, dl, p) in enumerate(new)]
        df = spark.createDataFrame(rows, "kind string, id string, owner string, updated_at long, deleted_at long, rev long, payload string")
        if batch == 3:  # dies after everything is written, and comes again
            with monkeypatch.context() as m, pytest.raises(OSError):
                m.setattr(feed.Latest, "publish", lambda *_: (_ for _ in ()).throw(OSError("killed")))
                kept(df, batch)
        kept(df, batch)
        kept(df, batch)  # the same batch again
        got = {(by, r["key"]): (r["total"], r["n"]) for by in spending.BY for r in kept.sums(by).collect()}
        assert got == spent(every)
    kept.views("seen_")
    assert spark.sql("SELECT sum(n) FROM seen_month").first()[0] == sum(n for (by, _), (_, n) in got.items() if by == "month")
    assert all(len(fs) < 3 for fs in kept.manifest().tables["spending"].values())


def test_sums_before_the_first_batch(spark, tmp_path):
    kept = spending.Spending(spark, str(tmp_path / "s"))
    assert kept.sums("month").count() == 0
    kept(spark.createDataFrame([], "kind string, id string, owner string, updated_at long, deleted_at long, rev long, payload string"), 0)
    assert kept.version() == 0 and kept.sums("category").count() == 0
    with pytest.raises(ValueError):
        kept.sums("shop")


def plain_watch(rows):
    steady, corners, out = 0, None, []
    for at, ok, found in rows:
        if not ok:
            steady, corners = 0, None
        else:
            near = corners is not None and all(((corners[i] - found[i]) ** 2 + (corners[i + 1] - found[i + 1]) ** 2) ** 0.5 <= 0.025 * 500 for i in range(0, 8, 2))
            steady, corners = (steady + 1 if near else 1), found
        out.append((at, steady, steady >= 3))
    return out


def test_a_hold_goes_on_over_batches(spark, tmp_path):
    square = [100.0, 100.0, 200.0, 100.0, 200.0, 200.0, 100.0, 200.0]
    rows = []
    for at in range(12):
        moved = [x + (40 if at == 5 else 3) * (at >= 5) for x in square]
        rows.append(("a", at, "paper" if at != 8 else "frame", 0.5, 0.2, moved, 300.0, 400.0))
    path = str(tmp_path / "frames")
    for part in (rows[:4], rows[4:]):
        spark.createDataFrame(part, steady.FRAME).coalesce(1).write.mode("append").parquet(path)
    got = []
    frames = spark.readStream.schema(steady.FRAME).option("maxFilesPerTrigger", 1).parquet(path)
    q = steady.watch(frames).writeStream.foreachBatch(lambda df, _: got.extend(map(tuple, df.collect()))).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    want = plain_watch([(r[1], r[2] == "paper", r[5]) for r in rows])
    assert sorted((at, n, fire) for _, at, _, n, fire in got) == want
    assert [fire for *_, fire in want].count(True) > 2


def test_listeners_hear_of_rows(spark, tmp_path):
    heard = []
    listener = feed.Notify(lambda name, batch, rows: heard.append(rows))
    spark.streams.addListener(listener)
    try:
        path = str(tmp_path / "log")
        log(spark).coalesce(1).write.parquet(path)
        feed.follow(feed.read_log(spark, path, log(spark).schema), feed.Latest(spark, str(tmp_path / "s")), str(tmp_path / "c")).awaitTermination()
        for _ in range(50):
            if heard:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    assert sum(heard) == 39


def test_breaker_and_idle():
    b = feed.Breaker()
    assert [b.failure() for _ in range(8)] == [30, 60, 120, 240, 480, 960, 1800, 1800] and b.open
    b.success()
    assert not b.open and b.failure() == 30
    idle = worker.Idle(10)
    assert [idle.next(n) for n in (1, 0, 0, 0, 0, 0, 2)] == [10, 10, 20, 40, 80, 80, 10]


def test_failures_after_progress_do_not_add_up():
    class Query:
        runs = 0
        recentProgress = [{"numInputRows": 3}]

        def awaitTermination(self):
            Query.runs += 1
            if Query.runs < 9:
                raise RuntimeError("x")

    waits = []
    feed.supervise(Query, failures=3, wait=waits.append)
    assert waits == [30] * 8


def test_lines_of_json(spark, tmp_path):
    from tallyloom.sources.adapter import read_lines

    (tmp_path / "x.ndjson").write_text('{"a": 1}\n\nnot json\n{"a": 2}')
    got = read_lines(spark, str(tmp_path), "a int")
    assert sorted((r["a"] or 0, r["_corrupt"]) for r in got.collect()) == [(0, "not json"), (1, None), (2, None)]


def test_supervision():
    calls, waits = [], []

    class Query:
        def awaitTermination(self):
            calls.append(1)
            if len(calls) < 3:
                raise RuntimeError("x")

    assert feed.supervise(Query, wait=waits.append) and waits == [30, 60]
    calls.clear()

    class Never:
        def awaitTermination(self):
            raise RuntimeError("x")

    with pytest.raises(RuntimeError):
        feed.supervise(Never, failures=2, wait=waits.append)
