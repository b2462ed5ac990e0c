"""The rules of batches, on the state machine itself; s01_arrived_batches runs them as streams."""

from __future__ import annotations

from pyspark.sql import Row

from tabgate.streaming.arrivals import DECIDED, FAILED, LATE, UNLISTED, UPLOADED, WAITING, BatchState


class Value:
    def __init__(self):
        self.value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


class Mapped(dict):
    def containsKey(self, key):
        return key in self

    def getValue(self, key):
        return self[key]

    def updateValue(self, key, value):
        self[key] = value


class Handle:
    def __init__(self):
        self.timers = []

    def getMapState(self, *_):
        return Mapped()

    def getValueState(self, *_):
        return Value()

    def registerTimer(self, at):
        self.timers.append(at)


class Clock:
    def getCurrentProcessingTimeInMs(self):
        return 1_000


def machine(deadline=None):
    state = BatchState(deadline)
    state.init(Handle())
    return state


def seen(name, epoch, issues=0, print_=None, expected=("a", "b"), reason=None):
    return Row(batch_id="B", file_name=name, expected=list(expected), reason=reason, n_lines=3, n_issues=issues,
               fingerprint=hash(name) if print_ is None else print_, epoch=epoch)


def told(state, *rows):
    return [(r.what, r.status, r.file_name, r.epoch, r.n_issues) for r in state.handleInputRows(("B",), iter(rows), Clock())]


def test_a_batch_waits_until_it_is_whole():
    state = machine()
    assert told(state, seen("a", 0)) == []
    assert told(state, seen("b", 3)) == [(DECIDED, UPLOADED, "a", 0, 0), (DECIDED, UPLOADED, "b", 3, 0)]


def test_one_bad_file_in_a_later_epoch_fails_all():
    state = machine()
    told(state, seen("a", 0))
    assert told(state, seen("b", 1, issues=4)) == [(DECIDED, FAILED, "a", 0, 4), (DECIDED, FAILED, "b", 1, 4)]


def test_a_file_sent_again_replaces_the_first_until_the_decision():
    state = machine()
    told(state, seen("a", 0, issues=2))
    assert told(state, seen("a", 1, print_=5), seen("b", 1)) == [(DECIDED, UPLOADED, "a", 1, 0), (DECIDED, UPLOADED, "b", 1, 0)]


def test_the_same_file_again_changes_nothing():
    state = machine()
    told(state, seen("a", 0), seen("a", 1))
    assert told(state, seen("b", 2))[0] == (DECIDED, UPLOADED, "a", 0, 0)
    assert told(state, seen("b", 2), seen("a", 7)) == []


def test_late_and_unlisted_files():
    state = machine()
    assert told(state, seen("x", 0)) == [(UNLISTED, WAITING, "x", 0, 0)]
    told(state, seen("a", 0), seen("b", 0))
    assert told(state, seen("a", 1, print_=9), seen("y", 1, issues=1)) == [
        (LATE, UPLOADED, "a", 1, 0), (UNLISTED, UPLOADED, "y", 1, 1)
    ]


def test_a_batch_that_cannot_be_processed_fails_at_once():
    state = machine()
    assert told(state, seen("a", 0, reason="no")) == [(DECIDED, FAILED, None, None, 0)]
    assert told(state, seen("b", 1)) == [(LATE, FAILED, "b", 1, 0)]


def test_the_deadline_fails_what_is_not_whole():
    state = machine(500)
    told(state, seen("a", 0))
    told(state, seen("a", 1))
    assert state.handle.timers == [1_500]
    (row,) = state.handleExpiredTimer(("B",), Clock(), None)
    assert (row.status, row.n_files, row.n_missing, row.reason) == (FAILED, 1, 1, "files are missing")
    assert told(state, seen("b", 2)) == [(LATE, FAILED, "b", 2, 0)]
    assert list(state.handleExpiredTimer(("B",), Clock(), None)) == []


def test_the_deadline_leaves_decided_batches_alone():
    state = machine(500)
    told(state, seen("a", 0), seen("b", 0))
    assert list(state.handleExpiredTimer(("B",), Clock(), None)) == []
