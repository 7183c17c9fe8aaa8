"""State that is kept between runs of a stream, and state that expires."""

import time

import pandas as pd
from pyspark.sql import functions as F

from tidewheel.session import table
from tidewheel.streaming import events


def test_list_and_map_state_over_two_runs(spark, sf_dir, tmp_path):
    bought = table(spark, sf_dir, "events").where("event_type = 'purchase'")
    folder = str(tmp_path / "events")
    stream = lambda: spark.readStream.schema(bought.schema).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))
    rows = sorted(bought.collect(), key=lambda r: (r["ts"], r["event_id"]))
    middle = rows[len(rows) // 2]["ts"]

    def kept(ttl_ms, place):
        with events._rocks_db(spark):
            return {r["user_id"]: r for r in events.purchases_kept(stream(), ttl_ms, str(tmp_path / place)).collect()}

    bought.where(F.col("ts") < F.lit(middle)).coalesce(1).write.parquet(folder)
    first = kept(None, "stays")
    kept(1000, "expires")
    time.sleep(2)
    bought.where(F.col("ts") >= F.lit(middle)).coalesce(1).write.mode("append").parquet(folder)
    stays, expires = kept(None, "stays"), kept(1000, "expires")
    for user in {r["user_id"] for r in rows}:
        own = [r for r in rows if r["user_id"] == user]
        late = [r for r in own if r["ts"] >= middle]
        assert stays[user]["last"] == [r["event_id"] for r in reversed(own)][:3]
        assert stays[user]["days"] == len({r["ts"].day for r in own})
        if late:  # what the first run left has expired
            assert expires[user]["last"] == [r["event_id"] for r in reversed(late)][:3]
            assert expires[user]["days"] == len({r["ts"].day for r in late})
    assert any(first[u]["last"] != stays[u]["last"] for u in first)


class Calls:
    """A store of states in memory that counts calls."""

    def __init__(self):
        self.n, self.states, self.timers = 0, {}, []

    def getValueState(self, name, *_):  # noqa: N802  Spark's name
        return Held(self, self.states.setdefault(name, {}))

    getListState = getMapState = getValueState  # noqa: N815

    def registerTimer(self, at):  # noqa: N802
        self.n += 1
        self.timers.append(at)


class Held:
    def __init__(self, calls, held):
        self.calls, self.held = calls, held

    def exists(self):
        self.calls.n += 1
        return bool(self.held)

    def get(self):
        self.calls.n += 1
        return self.held.get("value")

    def put(self, value):
        self.calls.n += 1
        self.held["value"] = value

    update = put

    def iterator(self):
        self.calls.n += 1
        return iter(list(self.held.items()))

    def updateValue(self, key, value):  # noqa: N802
        self.calls.n += 1
        self.held[key] = value


class Now:
    def __init__(self, at):
        self.at = at

    getCurrentWatermarkInMs = getExpiryTimeInMs = lambda self: self.at  # noqa: E731, N815


def test_reminders_need_few_calls_and_one_frame():
    calls, day = Calls(), 86_400_000
    own = events.Reminders()
    own.init(calls)
    at = lambda *ms: pd.DataFrame({"ts": pd.to_datetime(list(ms), unit="ms")})
    list(own.handleInputRows((1,), iter([at(*range(5000, 6000)), at(5000)]), None))
    assert calls.timers == [5000 + day] and calls.n <= 4
    list(own.handleInputRows((1,), iter([at(100)]), None))  # earlier than what a timer stands for
    assert calls.timers[-1] == 100 + day
    out = list(own.handleExpiredTimer((1,), Now(5499 + day), Now(100 + day)))
    assert len(out) == 1 and out[0]["due"].tolist() == [100 + day, *range(5000 + day, 5500 + day)] and set(out[0]["n"]) == {1002}
    assert calls.timers[-1] == 5500 + day
    assert not list(own.handleExpiredTimer((1,), Now(5499 + day), Now(5000 + day)))  # told before
    out = list(own.handleExpiredTimer((1,), Now(9000 + day), Now(5500 + day)))
    assert out[0]["due"].tolist() == list(range(5500 + day, 6000 + day))


def test_last_purchases_call_the_store_once_a_day():
    calls = Calls()
    own = events.LastPurchases()
    own.init(calls)
    rows = pd.DataFrame({"at": range(310), "event_id": range(310), "value": 1.0, "day": [k % 31 for k in range(310)]})
    out = list(own.handleInputRows((1,), iter([rows]), None))[0].iloc[0]
    assert (out["last"], out["days"], out["busiest"], out["most"]) == ([309, 308, 307], 31, 0, 10)
    assert calls.n <= 31 + 5
