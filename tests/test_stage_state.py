"""The dates of an entity are completed by one call on one state."""

from datetime import date, datetime
from types import SimpleNamespace

import pandas as pd

from obsframe.streaming.sequential import Completion

DAY = 86_400_000


class Handle:
    """A state and its timers, with the number of writes."""

    def __init__(self):
        self.value, self.timers, self.writes = None, [], 0

    def getValueState(self, name, schema):
        return self

    exists = lambda self: self.value is not None
    get = lambda self: self.value
    listTimers = lambda self: iter(list(self.timers))
    deleteTimer = lambda self, at: self.timers.remove(at)
    registerTimer = lambda self, at: self.timers.append(at)

    def update(self, value):
        self.value, self.writes = value, self.writes + 1

    def clear(self):
        self.value = None


def events(*rows):
    return pd.DataFrame(rows, columns=["entity_id", "obs_date", "stage", "head", "pair_first", "pair_second", "tail", "event_time"])


def test_dates_share_one_state_and_are_forgotten_apart():
    first, second = date(1970, 1, 2), date(1970, 3, 2)
    one = lambda d, head: (1, d, 1, head, head[0], None, None, datetime(d.year, d.month, d.day, 2))
    two = lambda d, tail: (1, d, 2, None, None, "5", tail, datetime(d.year, d.month, d.day, 3))
    handle, completion, at = Handle(), Completion(30 * DAY), lambda ms: SimpleNamespace(getCurrentWatermarkInMs=lambda: ms)
    completion.init(handle)
    run = lambda rows, ms: [tuple(r) for out in completion.handleInputRows((1,), iter([rows]), at(ms)) for r in out.itertuples(index=False)]
    assert run(events(one(first, "111"), two(first, "999"), one(second, "222")), 0) == [(1, first, "111", "15", "999")]
    assert handle.writes == 1 and len(handle.timers) == 1
    assert run(events(two(first, "000"), two(first, "000")), 0) == []  # a completed date is final
    handle.timers.clear()
    list(completion.handleExpiredTimer((1,), at(32 * DAY), None))  # only the first date's time is up
    assert len(handle.value[0]) == 1 and len(handle.timers) == 1
    assert run(events(two(second, "777")), 32 * DAY) == [(1, second, "222", "25", "777")]
    handle.timers.clear()
    list(completion.handleExpiredTimer((1,), at(200 * DAY), None))
    assert handle.value is None and not handle.timers
