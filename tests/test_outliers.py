import math
import time

import numpy as np
import pytest

from modelscout.functions.student import grubbs_rejects, t_tail
from modelscout.operators import outliers, profile, roles
from modelscout.operators.outliers import grubbs_outliers


def brute(values, alpha=0.01):
    x, out = list(values), []
    while len(x) >= 3:
        a = np.array(x)
        std = a.std(ddof=1)
        if std == 0:
            break
        lo, hi = a.argmin(), a.argmax()
        far = hi if abs(a[hi] - a.mean()) > abs(a[lo] - a.mean()) else lo
        if not grubbs_rejects(abs(a[far] - a.mean()) / std, len(x), alpha):
            break
        out.append(x.pop(far))
    return out


def removed(df, **kw):
    rows = grubbs_outliers(df, "x", **kw).orderBy("step").collect()
    return [r["value"] for r in rows for _ in range(r["copies"])]


@pytest.mark.parametrize("two_sided,df,t", [(0.05, 10, 2.228139), (0.05, 1, 12.706205), (0.01, 10, 3.169273), (0.05, 100, 1.983972)])
def test_tail_against_tables(two_sided, df, t):
    assert 2 * t_tail(t, df) == pytest.approx(two_sided, rel=1e-5)


def test_tail_is_smooth_where_the_formula_changes():
    assert t_tail(5, 100_000) == pytest.approx(t_tail(5, 100_001), rel=1e-6)


@pytest.mark.parametrize("t", [1, 6, 30])
@pytest.mark.parametrize("df", [1, 8, 1_000, 99_999, 150_000])
def test_tail_steps_by_the_recurrence_at_all_sizes(t, df):
    """I_x(a + 1, 1/2) = I_x(a, 1/2) - x^a (1 - x)^(1/2) / (a B(a, 1/2)), across 100,000 degrees of freedom too."""
    a, log_x = df / 2, -math.log1p(t * t / df)
    term = math.exp(math.lgamma(a + 0.5) - math.lgamma(a + 1) - math.lgamma(0.5) + a * log_x) * math.sqrt(-math.expm1(log_x))
    assert t_tail(t * math.sqrt((df + 2) / df), df + 2) == pytest.approx(t_tail(t, df) - term / 2, rel=1e-9, abs=0)


@pytest.mark.parametrize("n,critical", [(3, 1.155), (10, 2.482), (20, 3.001), (50, 3.483), (100, 3.754)])
def test_critical_values_against_tables(n, critical):
    assert not grubbs_rejects(critical - 0.002, n, 0.01) and grubbs_rejects(critical + 0.002, n, 0.01)


@pytest.mark.parametrize("n,ends", [(4, 2), (30, 3), (200, 3), (200, 1000)])
def test_equals_one_by_one_removal(make, n, ends):
    rng = np.random.default_rng(n)
    x = np.round(
        np.concatenate([rng.normal(0, 1, n), rng.choice([50.0, -70.0, 50.0], max(1, n // 10)), [5000.0 + i * i * 300 for i in range(n // 10)]]), 1
    )
    assert removed(make([(float(v),) for v in x], "x double"), ends=ends) == brute(x)


def test_groups_gaps_and_flat_columns(make):
    rows = [("flat", 5.0)] * 10 + [("pair", 1.0), ("pair", 100.0), (None, None)]
    rows += [("odd", float(v)) for v in (1, 2, 1, 2, 1, 2, 1, 2, 1000)] + [(None, float(v)) for v in (1, 2, 1, 2, 1, 2, 1, 2, -500)]
    rows += [("odd", float("nan"))]
    got = grubbs_outliers(make(rows, "g string, x double"), "x", by=["g"]).collect()
    assert {(r["g"], r["value"], r["copies"]) for r in got} == {("odd", 1000.0, 1), (None, -500.0, 1)}


def test_empty(make):
    assert removed(make([], "x double")) == []


def test_note_goes_to_columns_the_test_takes_from(make):
    rows = [(float(i % 7), float(i % 5) + (1000.0 if i == 3 else 0.0), float(i), 1.0) for i in range(60)]
    df = make(rows, "calm double, odd double, even double, flat double")
    summary = profile.profile(df)
    found = outliers.columns_with_outliers(summary)
    assert found == [c for c in df.columns if not outliers.grubbs_outliers(df, c).isEmpty()] == ["odd"]
    notes = {r["var_name"]: r["quality"] for r in roles.quality_report(summary, 60, found).collect()}
    assert notes == {"calm": "", "odd": "might be outliers", "even": "", "flat": ""}


def test_many_removals_take_linear_time():
    """A deep end of distinct values, all of which go."""
    n = 20_000
    values = np.concatenate([[-1.0], 1e9 * 1.001 ** np.arange(n), [math.nan]])
    rows = np.concatenate([np.ones(n + 1, int), [10**7]])
    means, spreads = np.where(np.isnan(values), 0.0, values), np.where(np.isnan(values), 1.0, 0.0)
    start = time.monotonic()
    taken, *_ = outliers._walk(values, rows, means, spreads, -1.0, 0.01)
    assert len(taken) > 10_000 and time.monotonic() - start < 20
