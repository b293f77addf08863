"""Calls to the state of a stream: their number per key is what the time grows with."""

import pandas as pd

from seqaudit.streaming.stream import EarliestLabel


class State:
    """A value, a list and the timers of one key, counting the calls."""

    def __init__(self):
        self.calls, self.timers, self.held = 0, set(), {}

    def getValueState(self, name, _):  # noqa: N802
        return Cell(self, name, None)

    def getListState(self, name, _):  # noqa: N802
        return Cell(self, name, [])

    def registerTimer(self, at):  # noqa: N802
        self.calls += 1
        self.timers.add(at)


class Cell:
    def __init__(self, state, name, empty):
        self.state, self.name, self.empty = state, name, empty

    def exists(self):
        self.state.calls += 1
        return bool(self.state.held.get(self.name))

    def get(self):
        self.state.calls += 1
        held = self.state.held.get(self.name, self.empty)
        return iter(held) if isinstance(self.empty, list) else held

    def put(self, rows):
        self.state.calls += 1
        self.state.held[self.name] = rows

    update = put

    def appendList(self, rows):  # noqa: N802
        self.state.calls += 1
        self.state.held[self.name] = self.state.held.get(self.name, []) + rows

    def clear(self):
        self.state.calls += 1
        self.state.held.pop(self.name, None)


class Clock:
    def __init__(self, now):
        self.now = now

    def getCurrentWatermarkInMs(self):  # noqa: N802
        return self.now


def drive(batches, keep):
    """Rows (second, id, label) and watermarks (ms) in turn, as Spark calls the processor."""
    state, processor, out = State(), EarliestLabel(keep), []
    processor.init(state)
    for rows, mark in batches:
        if rows:
            table = pd.DataFrame(rows, columns=["at", "row_id", "target"])
            table["seen_at"] = pd.to_datetime(table["at"], unit="s")
            list(processor.handleInputRows(("k",), iter([table]), Clock(mark)))
        for at in sorted(t for t in state.timers if t <= mark):
            state.timers.discard(at)
            for found in processor.handleExpiredTimer(("k",), Clock(mark), None):
                out += [tuple(r) for r in found.itertuples(index=False)]
    return out, state


def test_a_key_of_one_passed_row_takes_few_calls():
    out, state = drive([([(10, 1, "a")], 0), ([], 10_000_000)], 60_000)
    assert out == [] and not state.timers and not state.held
    assert state.calls <= 6  # twelve before


def test_spans_that_stay_open_are_kept_and_closed():
    steps = [([(10, 1, "a"), (20, 2, "b")], 0), ([], 30_000), ([(40, 3, "a"), (90, 4, "b")], 30_000), ([], 60_000), ([(95, 5, "b")], 80_000), ([], 1_000_000)]
    out, state = drive(steps, 60_000)
    assert out == [("k", 2, "b", True), ("k", 3, "a", False), ("k", 5, "b", False)]
    assert not state.timers and not state.held
