"""Finding F15 of round 3: a shard's touches aren't held as rows, and what is given up comes in parts."""

import pandas as pd

from tracewell.streaming import recency


class State:
    exists = False

    def update(self, value):
        self.value = value


def test_what_is_given_up_comes_in_parts():
    n = 100_000
    rows = pd.DataFrame({"shard": 0, "series": [f"s{k % 7}" for k in range(n)], "at": range(n), "seq": range(n)}).sample(frac=1, random_state=1)
    state = State()
    out = list(recency._keeping(3, None)((0,), iter([rows[k : k + 1000] for k in range(0, n, 1000)]), state))
    assert max(map(len, out)) < 20_000
    got = pd.concat(out)
    assert list(got["last"]) == list(range(n - 3)) and list(got["given_up"]) == list(range(3, n))
    assert state.value == ([f"s{k % 7}" for k in range(n - 3, n)], [n - 3, n - 2, n - 1])
