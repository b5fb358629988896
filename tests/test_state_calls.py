"""How often keyed logic calls its states: once a micro-batch, not once a row. A counting handle stands in for Spark's."""

from collections import Counter

import pandas as pd

from rillspark.streaming import changing, processors


class States:
    """Value, list and map states in plain dictionaries; ``calls`` counts what would go to the JVM."""

    def __init__(self):
        self.calls, self.timers = Counter(), set()

    def __getattr__(self, name):
        if name in ("getValueState", "getListState", "getMapState"):
            return lambda *args: State(self, name)
        if name in ("registerTimer", "deleteTimer"):
            return lambda at: (self.calls.update([name]), (self.timers.add if name == "registerTimer" else self.timers.discard)(at))
        raise AttributeError(name)


class State:
    def __init__(self, owner, kind):
        self.owner, self.value = owner, {"getListState": [], "getMapState": {}}.get(kind)

    def called(self, value=None):
        self.owner.calls["state"] += 1
        return value

    def exists(self):
        return self.called(bool(self.value))

    def get(self):
        return self.called(iter(list(self.value)) if isinstance(self.value, list) else self.value)

    def update(self, value):
        self.value = self.called(value)

    def put(self, rows):
        self.value = self.called(list(rows))

    def appendList(self, rows):
        self.value = self.called([*self.value, *rows])

    def appendValue(self, row):
        self.appendList([row])

    def clear(self):
        self.value = self.called([] if isinstance(self.value, list) else {} if isinstance(self.value, dict) else None)

    def getValue(self, key):
        return self.called(self.value.get(key))

    def containsKey(self, key):
        return self.called(key in self.value)

    def updateValue(self, key, value):
        self.called()
        self.value[key] = value

    def removeKey(self, key):
        self.called()
        self.value.pop(key, None)

    def iterator(self):
        return self.called(iter(list(self.value.items())))


class Clock:
    def __init__(self, mark=0):
        self.mark = mark

    def getCurrentWatermarkInMs(self):
        return self.mark

    getExpiryTimeInMs = getCurrentWatermarkInMs


def rows(first, n):
    return pd.DataFrame({"user_id": 1, "ts": pd.to_datetime([*range(first + n - 1, first - 1, -1)], unit="s"), "event_id": [*range(first + n - 1, first - 1, -1)], "vc": 2})


def started(processor):
    processor.key, processor.names = "user_id", {"ts": "at", "event_id": "id", "vc": "value"}
    processor.number, processor.cast, processor.columns = "bigint", int, ["user_id", *processor.fields]
    states = States()
    processor.init(states)
    return states


def given(processor, *frames):
    return [tuple(r) for out in processor.handleInputRows((1,), iter(frames), Clock()) for r in out.itertuples(index=False)]


def test_a_buffer_calls_its_states_once_per_micro_batch():
    p = processors.Buffered(10)
    states = started(p)
    assert len(given(p, rows(0, 60), rows(60, 45))) == 100
    out = given(p, rows(105, 8))
    assert out == [(1, 10, i, 2) for i in range(100, 110)]
    assert states.calls["state"] <= 8


def test_a_running_sum_calls_its_state_once_per_micro_batch():
    p = processors.RunningSum()
    states = started(p)
    assert given(p, rows(0, 100))[-1] == (1, 99, 200)
    assert given(p, rows(100, 100))[-1] == (1, 199, 400)
    assert states.calls["state"] <= 4


def test_kept_maps_and_lists_are_what_plain_ones_were():
    p = processors.ValueCounts()
    started(p)
    assert [x[-1] for x in given(p, rows(0, 3))] == [1, 2, 3]
    assert [x[-1] for x in given(p, rows(3, 2))] == [4, 5]
    p = processors.FollowedBy("kind", "a", "b", 60_000)
    states = started(p)
    frame = rows(0, 4).assign(kind=["b", "a", "a", "a"])
    assert sorted(given(p, frame)) == [(1, i, "completed") for i in range(3)]
    assert list(states.calls) and not given(p, rows(5, 1).assign(kind="b"))


def test_a_pattern_calls_its_states_once_per_micro_batch():
    from rillspark.operators.automata import SCHEMA, Pattern
    from rillspark.streaming.automata import PatternMatcher

    pattern = Pattern.begin("a", None).followed_by("b", None).within(1000)
    p, states = PatternMatcher(pattern, "user_id"), States()
    p.init(states)
    n = 200
    frame = lambda first: pd.DataFrame({"user_id": 1, "at": [x * 1_000_000 for x in range(first, first + n)], "fits": [1 + x % 2 for x in range(n)], "order 0": range(first, first + n), "when": 0, "payload": [str(x) for x in range(first, first + n)]})
    out = []
    for first in (0, n):
        list(p.handleInputRows((1,), iter([frame(first)]), Clock()))
        clock = Clock((first + n) * 1000)
        assert len(states.timers) == 1 and min(states.timers) <= clock.mark
        states.timers.discard(min(states.timers))
        out += [r for x in p.handleExpiredTimer((1,), clock, clock) for r in x.itertuples(index=False)]
    assert [r.payloads for r in out] == [[str(x), str(x + 1)] for x in range(0, 2 * n, 2)] and list(out[0]._fields[1:]) == [f.split()[0] for f in SCHEMA.split(", ")]
    assert sum(states.calls.values()) <= 20


def test_what_rules_decide_leaves_by_the_batch():
    n = 2 * changing.BATCH + 5
    p = changing.AboveThreshold(0.0)
    p.key, p.names, p.number, p.cast, p.columns = "shard", {"event_id": "id", "vc": "value"}, "bigint", int, ["shard", "id", "value", "held"]
    p.init(States())
    made = lambda first, n, rule: pd.DataFrame({"shard": 0, "at_us": range(first, first + n), "event_id": range(first, first + n), "vc": 9, "owner": None, "action": None, "is_rule": bool(rule), "rule": rule})
    frames = [made(n // 2, 1, '["8.0"]'), made(5, n, ""), made(3, 1, '["4.0"]')]
    out = list(p.handleInputRows((0,), iter(frames), Clock()))
    assert [len(x) for x in out] == [changing.BATCH, changing.BATCH, 5]
    every = pd.concat(out)
    assert list(every["id"]) == list(range(5, n + 5)) and list(every["held"]) == [4.0 if i <= n // 2 else 8.0 for i in every["id"]]
