"""A fit that goes on from its epoch log."""

import os

import numpy as np
import pytest

import tessera.plans.factorize as plans
from helpers import to_dict
from tessera import CoupledModel, Factorization, fit
from test_factorize import tensor


def small_model(spark, p=1.0):
    rng = np.random.default_rng(11)
    x = rng.integers(1, 9, (4, 5))
    return CoupledModel({"X": tensor(spark, "ij", x, rng.random((4, 5)) < 0.7),
                         "A": tensor(spark, "ik", rng.random((4, 2)) + 0.1),
                         "B": tensor(spark, "kj", rng.random((2, 5)) + 0.1)},
                        [Factorization("X", ("A", "B"), p=p)], missing="masked")


def factors(res):
    return {n: to_dict(res.model.tensors[n]) for n in "AB"}


def same(a, b):
    assert a.keys() == b.keys()
    for n in a:
        assert a[n].keys() == b[n].keys()
        assert all(a[n][k] == pytest.approx(b[n][k], rel=1e-12) for k in a[n])


def test_two_and_two_epochs_equal_four(spark, tmp_path):
    whole = fit(small_model(spark), 4)
    log = str(tmp_path / "log")
    first = fit(small_model(spark), 2, log=log)
    assert first.objective == pytest.approx(whole.objective[:2], rel=1e-12)
    rest = fit(small_model(spark), 4, log=log)
    assert rest.objective == pytest.approx(whole.objective, rel=1e-12)
    assert [r["epoch"] for r in rest.history.orderBy("epoch").collect()] == [1, 2, 3, 4]
    same(factors(rest), factors(whole))
    # Two generations of factors at most, and nothing is run again.
    assert sorted(os.listdir(log)) == ["epochs", "factors-0", "factors-1"]
    again = fit(small_model(spark), 4, log=log)
    assert again.objective == pytest.approx(whole.objective, rel=1e-12)
    same(factors(again), factors(whole))


def test_fit_that_fails_inside_an_epoch_goes_on_from_the_last_whole_one(spark, tmp_path, monkeypatch):
    log, real, calls = str(tmp_path / "log"), plans.factor_update, []

    def failing(model, a, on_invalid):
        calls.append(a)
        if len(calls) == 4:  # epoch 2, after its first factor was written
            raise RuntimeError("lost")
        return real(model, a, on_invalid)

    monkeypatch.setattr(plans, "factor_update", failing)
    with pytest.raises(RuntimeError, match="lost"):
        fit(small_model(spark), 3, log=log)
    monkeypatch.setattr(plans, "factor_update", real)
    whole = fit(small_model(spark), 3)
    rest = fit(small_model(spark), 3, log=log)
    assert rest.objective == pytest.approx(whole.objective, rel=1e-12)
    same(factors(rest), factors(whole))


def test_log_of_another_model_is_refused(spark, tmp_path):
    log = str(tmp_path / "log")
    fit(small_model(spark), 1, monitor=False, log=log)
    with pytest.raises(ValueError, match="another model"):
        fit(small_model(spark, p=2.0), 2, log=log)
    more = fit(small_model(spark), 2, log=log)  # unmonitored epochs leave no history
    assert [r["epoch"] for r in more.history.collect()] == [2]
    with pytest.raises(ValueError, match="more than"):
        fit(small_model(spark), 1, log=log)
