"""Student's p-value against a numeric integral of the density."""

import math

import pytest

from tracewell.operators.series import student_p


def integral(t, df, steps=20_000):
    front = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(math.pi * df)
    f = [front * (1 + (t * i / steps) ** 2 / df) ** (-(df + 1) / 2) for i in range(steps + 1)]
    return 1 - 2 * t / (3 * steps) * (f[0] + f[-1] + 4 * sum(f[1:-1:2]) + 2 * sum(f[2:-1:2]))


@pytest.mark.parametrize("t", [0.0, 0.3, 1.0, 1.96, 2.5, 6.0])
@pytest.mark.parametrize("df", [1, 2.5, 7, 30, 188.4])
def test_student_p(t, df):
    assert student_p(t, df) == pytest.approx(integral(t, df), abs=1e-8)
    assert student_p(-t, df) == student_p(t, df)


def test_student_p_at_the_ends():
    assert student_p(float("nan"), 3) == 1.0 and student_p(float("inf"), 3) == 0.0 and student_p(1.0, 0) == 1.0
    assert student_p(2.7764451052, 4) == pytest.approx(0.05, abs=1e-9)
