"""States that stay in Python while a key's rows are handled: each is read once and written once per micro-batch.

Every call of a state goes to the JVM and back, so a call per row costs far more than the row's own logic. ``Kept`` stands
in for the handle; what it gives reads a state when it is first asked for, and ``flush`` writes what has changed.
"""

from __future__ import annotations

from collections.abc import Iterator

UNREAD, NAN = object(), float("nan")


class KeptValue:
    def __init__(self, state) -> None:
        self.state, self.value, self.dirty = state, UNREAD, False

    def get(self) -> tuple | None:
        if self.value is UNREAD:
            self.value = self.state.get()
        return self.value

    def exists(self) -> bool:
        return self.get() is not None

    def update(self, value: tuple | None) -> None:
        self.value, self.dirty = value, True

    def clear(self) -> None:
        self.update(None)

    def flush(self) -> None:
        if self.dirty:
            self.state.clear() if self.value is None else self.state.update(self.value)
        self.value, self.dirty = UNREAD, False


class KeptList:
    """``rows`` are all there are once they have been asked for or replaced; before that, ``more`` only come behind."""

    def __init__(self, state) -> None:
        self.state, self.rows, self.more, self.replaced = state, None, [], False

    def get(self) -> Iterator[tuple]:
        if self.rows is None:
            self.rows = [*self.state.get(), *self.more]
        return iter(list(self.rows))

    def exists(self) -> bool:
        return bool(self.rows if self.rows is not None else self.more or self.state.exists())

    def put(self, rows: list[tuple]) -> None:
        self.rows, self.more, self.replaced = list(rows), [], True

    def appendList(self, rows: list[tuple]) -> None:
        if self.rows is not None:
            self.rows += rows
        if not self.replaced:
            self.more += rows

    def appendValue(self, row: tuple) -> None:
        self.appendList([row])

    def clear(self) -> None:
        self.put([])

    def flush(self) -> None:
        if self.replaced:
            self.state.put(self.rows) if self.rows else self.state.clear()
        elif self.more:
            self.state.appendList(self.more)
        self.rows, self.more, self.replaced = None, [], False


class KeptMap:
    """Entries as far as they have been asked for, None where there is none; all, once ``iterator`` has been."""

    def __init__(self, state) -> None:
        self.state, self.entries, self.dirty, self.whole = state, {}, set(), False

    def at(self, key: tuple) -> tuple:
        return tuple(NAN if x != x else x for x in key)

    def getValue(self, key: tuple) -> tuple | None:
        at = self.at(key)
        if at not in self.entries and not self.whole:
            self.entries[at] = self.state.getValue(key) if self.state.containsKey(key) else None
        return self.entries.get(at)

    def containsKey(self, key: tuple) -> bool:
        return self.getValue(key) is not None

    def updateValue(self, key: tuple, value: tuple | None) -> None:
        self.entries[self.at(key)] = value
        self.dirty.add(self.at(key))

    def removeKey(self, key: tuple) -> None:
        self.updateValue(key, None)

    def iterator(self) -> Iterator[tuple[tuple, tuple]]:
        if not self.whole:
            for key, value in self.state.iterator():
                self.entries.setdefault(self.at(key), value)
            self.whole = True
        return iter([(k, v) for k, v in self.entries.items() if v is not None])

    def keys(self) -> Iterator[tuple]:
        return (k for k, _ in self.iterator())

    def values(self) -> Iterator[tuple]:
        return (v for _, v in self.iterator())

    def exists(self) -> bool:
        return next(self.iterator(), None) is not None

    def clear(self) -> None:
        for key in list(self.keys()):
            self.removeKey(key)

    def flush(self) -> None:
        for key in self.dirty:
            value = self.entries[key]
            self.state.removeKey(key) if value is None else self.state.updateValue(key, value)
        self.entries, self.dirty, self.whole = {}, set(), False


class Kept:
    """A handle whose states are kept until ``flush``. States that expire stay as they are: their clock runs per write."""

    def __init__(self, handle) -> None:
        self.handle, self.states = handle, []

    def kept(self, state):
        self.states.append(state)
        return state

    def getValueState(self, name, schema, ttlDurationMs=None):
        state = self.handle.getValueState(name, schema, ttlDurationMs)
        return state if ttlDurationMs else self.kept(KeptValue(state))

    def getListState(self, name, schema, ttlDurationMs=None):
        state = self.handle.getListState(name, schema, ttlDurationMs)
        return state if ttlDurationMs else self.kept(KeptList(state))

    def getMapState(self, name, key, value, ttlDurationMs=None):
        state = self.handle.getMapState(name, key, value, ttlDurationMs)
        return state if ttlDurationMs else self.kept(KeptMap(state))

    def __getattr__(self, name):
        return getattr(self.handle, name)

    def flush(self) -> None:
        for state in self.states:
            state.flush()
