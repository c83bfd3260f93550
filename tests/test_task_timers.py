import datetime as dt

from quern.session import shared_dir
from quern.streaming import streams as H

SCHEMA = "task_id long, ts timestamp, event_id long, status string"
T0 = dt.datetime(2024, 1, 1)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def expected(rows, gap, lateness):
    """Sessions per task closed by the watermark, last status not final."""
    end = max(r[1] for r in rows) - dt.timedelta(minutes=lateness)
    out = []
    for task in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == task), key=lambda r: (r[1], r[2]))
        sessions = [[mine[0]]]
        for r in mine[1:]:
            if r[1] >= sessions[-1][-1][1] + dt.timedelta(minutes=gap):
                sessions.append([r])
            else:
                sessions[-1].append(r)
        for s in sessions:
            last = max(s, key=lambda r: (r[1], r[2]))
            if last[1] + dt.timedelta(minutes=gap) <= end and last[3] not in ("success", "failed"):
                out.append((task, last[3], last[1], len(s)))
    return sorted(out)


def test_restart_and_drain(spark):
    first = [(1, at(0), 1, "running"), (1, at(5), 2, "running"), (2, at(1), 3, "running"), (2, at(2), 4, "success"),
             (3, at(3), 5, "running"), (3, at(3), 6, "failed"), (4, at(10), 7, "running")]
    second = [(1, at(100), 8, "running"), (4, at(40), 9, "running"), (5, at(200), 10, "running"), (5, at(300), 11, "running")]
    root = shared_dir(spark, "timers-test")
    spark.createDataFrame(first, SCHEMA).write.parquet(f"{root}/in/part=1")
    out, check = f"{root}/out", f"{root}/check"
    stream = H.read_stream(spark, f"{root}/in", spark.read.parquet(f"{root}/in").schema)
    H.start_batches(H.stream_task_timers(stream, gap_ms=30 * 60_000), out, check, "append").awaitTermination()
    spark.createDataFrame(second, SCHEMA).write.parquet(f"{root}/in/part=2")
    stream = H.read_stream(spark, f"{root}/in", spark.read.parquet(f"{root}/in").schema)
    H.start_batches(H.stream_task_timers(stream, gap_ms=30 * 60_000), out, check, "append").awaitTermination()
    got = H.read_batches(spark, out, spark.createDataFrame([], H.TIMEOUTS).schema).collect()
    got = sorted((r.task_id, r.last_status, r.last_seen, r.messages) for r in got)
    assert got == expected(first + second, 30, 10)
    assert all(r.status == "timeout" for r in H.read_batches(spark, out, spark.createDataFrame([], H.TIMEOUTS).schema).collect())


class Held:
    """State and timers of one task in memory."""

    def __init__(self):
        self.value, self.timers, self.calls = None, set(), 0

    def getValueState(self, name, schema):
        return self

    def exists(self):
        return self.value is not None

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls += 1
        self.value = tuple(value)

    def clear(self):
        self.value = None

    def listTimers(self):
        self.calls += 1
        return iter(sorted(self.timers))

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.remove(at)


def test_one_frame_per_task_and_batch():
    import random

    import pandas as pd

    rng = random.Random(3)
    rows = [(1, at(k * 20 + rng.randint(0, 19)), k, rng.choice(["running", "success", "queued"])) for k in range(3000)]
    held = Held()
    machine = H._task_lifecycle(30 * 60_000, ("success", "failed"))
    machine.init(held)
    got, frames = [], 0
    for part in (rows[:2000], rows[2000:]):
        rng.shuffle(part)
        batch = pd.DataFrame(part, columns=["task_id", "ts", "tie", "status"]).drop(columns="task_id")
        for frame in machine.handleInputRows((1,), iter([batch[:700], batch[700:]]), None):
            frames += 1
            got += [(r.task_id, r.last_status, r.last_seen.to_pydatetime(), r.messages) for r in frame.itertuples()]
    assert frames == 2  # one for every batch, however many sessions closed
    assert held.calls <= 8 and len(held.timers) == 1
    for frame in machine.handleExpiredTimer((1,), None, None):
        got += [(r.task_id, r.last_status, r.last_seen.to_pydatetime(), r.messages) for r in frame.itertuples()]
    assert held.value is None
    assert sorted(got, key=lambda r: r[2]) == sorted(expected([*rows, (2, at(90_000), 0, "failed")], 30, 10), key=lambda r: r[2])


def test_late_message_only_counts():
    import pandas as pd

    held = Held()
    machine = H._task_lifecycle(30 * 60_000, ("success", "failed"))
    machine.init(held)
    for part in ([(at(100), 5, "running")], [(at(90), 9, "failed"), (at(100), 4, "failed")], [(at(100), 5, "waiting"), (at(101), 1, "queued")]):
        assert list(machine.handleInputRows((1,), iter([pd.DataFrame(part, columns=["ts", "tie", "status"])]), None)) == []
    assert held.value == ("queued", at(101), 1, 5) and len(held.timers) == 1
