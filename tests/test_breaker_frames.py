"""The breaker's frames are small, whatever rows of a key come at once."""

import random

import pandas as pd

from quillmesh.streaming import breakers as T


class Value:
    def __init__(self):
        self.kept = None

    def exists(self):
        return self.kept is not None

    def get(self):
        return self.kept

    def update(self, kept):
        self.kept = kept


class Handle:
    def __init__(self):
        self.timers = []

    def registerTimer(self, at):
        self.timers.append(at)


def test_frames_are_bounded_and_in_order(monkeypatch):
    monkeypatch.setattr(T, "ROWS", 100, raising=False)
    draw = random.Random(5)
    rows = [(draw.randrange(400_000), i, draw.random() < 0.6) for i in range(1234)]
    b = T.Breaker(3, 1000, True)
    b.state, b.handle = Value(), Handle()
    given = (pd.DataFrame([("k", *r) for r in rows[at : at + 300]], columns=["key", "ms", "id", "failed"]) for at in range(0, len(rows), 300))
    frames = list(b.handleInputRows(("k",), given, None))
    assert [len(f) for f in frames] == [100] * 12 + [34]
    streak, until, want, timers = 0, 0, [], []
    for ms, i, failed in sorted(rows):
        if until > ms:
            state = "refused"
        elif failed:
            streak, state = streak + 1, "closed"
            if streak >= 3:
                until, state = ms + 1000, "open"
                timers.append(until)
        else:
            streak, until, state = 0, 0, "closed"
        want.append((i, ms, state, streak, until or None))
    got = [(int(r.id), int(r.ms), r.state, int(r.streak), None if pd.isna(r.until_ms) else int(r.until_ms)) for f in frames for r in f.itertuples()]
    assert got == want and b.handle.timers == timers and b.state.kept == (streak, until)
