import math

import numpy as np
import pytest

from copperleaf.functions import stats as S
from copperleaf.operators import mixed


def test_normal():
    from statistics import NormalDist

    for p in (0.001, 0.2, 0.5, 0.975):
        assert math.isclose(S.normal_ppf(p), NormalDist().inv_cdf(p), abs_tol=1e-9)


def test_tables():
    assert [S.items_for_effect(d) for d in (0.3, 0.2)] == [87, 196]
    assert [round(S.auc_se(0.7, n), 3) for n in (164, 300, 542, 1000)] == [0.029, 0.021, 0.016, 0.012]
    assert [round(S.delta_auc_limit(0.7, n, 0.8), 3) for n in (164, 300, 542, 1000)] == [0.051, 0.038, 0.028, 0.021]
    assert [round(S.delta_auc_limit(0.7, n, 0.9), 3) for n in (164, 300, 542, 1000)] == [0.036, 0.027, 0.020, 0.015]
    for e, n in ((0, 170), (0.1, 287), (0.2, 541), (0.3, 1268)):
        assert abs(S.items_under_label_noise(0.7, 0.05, 0.8, e) - n) <= 1
    for pp, n in ((20, 196), (10, 785), (5, 3140)):
        assert abs(S.items_for_did(pp) - n) <= 1
    for n, row in ((50, (0.06, 0.11, 0.29)), (164, (0.10, 0.25, 0.73)), (800, (0.29, 0.81, 1.0))):
        assert tuple(round(S.did_power(n, pp), 2) for pp in (5, 10, 20)) == row
    for drop, row in ((0.25, (2.6, 4.0, -1.4)), (0.5, (5.6, 7.7, -2.2)), (0.75, (8.8, 11.2, -2.5)), (1.0, (12.3, 14.5, -2.2))):
        assert tuple(round(x, 1) for x in S.spurious_interaction(0.85, 0.35, drop)) == row
    assert math.isclose(S.implied_correlation(), 0.293089, abs_tol=1e-6)
    assert math.isclose(S.log_odds_bias(0.85, 0.35, 0.75), 0.023, abs_tol=5e-4)
    assert math.isclose(S.breakeven_auc(), 0.7936, abs_tol=1e-4)
    for auc, fall in ((0.52, 0.002), (0.6, 0.010), (0.7, 0.019), (0.85, 0.026), (0.95, 0.019)):
        assert abs(S.delta_auc_of_shift(auc, 0.1) - fall) <= 0.001


@pytest.mark.parametrize("true", [0.8, 0.0])
def test_mixed_model_recovers_the_interaction(true):
    errors = []
    for seed in (42, 7, 3):
        r = np.random.default_rng(seed)
        item, model, precision = (x.ravel() for x in np.meshgrid(np.arange(200), np.arange(3), [0, 1], indexing="ij"))
        contaminated = (item % 2).astype(float)
        u, v = r.normal(0, 1, 200), r.normal(0, 0.3, 3)
        eta = 0.4 - 0.5 * precision + 0.2 * contaminated + true * precision * contaminated + u[item] + v[model]
        correct = (r.random(len(eta)) < 1 / (1 + np.exp(-eta))).astype(float)
        errors.append(mixed.fit_glmm(item, model, precision.astype(float), contaminated, correct)["effects"]["precision:contaminated"] - true)
    assert all(abs(e) < 0.75 for e in errors) and abs(np.mean(errors)) < 0.5


def test_items_for_effects_beyond_the_first_bounds():
    assert math.isclose(S.items_for_did(0.01), S.items_for_did(10) * 1e6, rel_tol=1e-3) and S.items_for_did(0.01) > 1e7
    assert S.items_for_delta_auc(0.7, 1e-6, 0.8) > 1e9
    assert S.delta_auc_limit(0.7, S.items_for_delta_auc(0.7, 1e-6, 0.8), 0.8) <= 1e-6
    assert S.items_for_did(1e4) == 2 and S.items_for_delta_auc(0.7, 0.9, 0.99) == S.items_for_delta_auc(1.0, 0.1, 0.8) == 4
    assert S.auc_se(1 - 1e-16, 10**9) >= 0
