"""Counts of values that the job which writes them takes."""

import uuid
from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from helpers import from_rows
from tessera import CoupledModel, Factorization, check, factor_update, fit, run_epoch, validate


@contextmanager
def jobs(spark):
    """The ids of the Spark jobs that the block starts."""
    sc, found, group = spark.sparkContext, [], uuid.uuid4().hex
    sc.setJobGroup(group, "counted")
    try:
        yield found
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        found.extend(sc.statusTracker().getJobIdsForGroup(group))


def _model(spark, p=1.0, huge=False):
    """With ``huge``, the sum of a row of X is out of the range of doubles."""
    js = range(1, 13 if huge else 4)
    x = from_rows(spark, ["i", "j"], [(i, j, 1e308 if huge else float(i + j)) for i in (1, 2) for j in js], {"i": 2, "j": len(js)})
    u = from_rows(spark, ["i", "k"], [(i, k, 0.5 * i + k) for i in (1, 2) for k in (1, 2)], {"i": 2, "k": 2})
    v = from_rows(spark, ["k", "j"], [(k, j, 1.0 if huge else 1.0 + k * j) for k in (1, 2) for j in js], {"k": 2, "j": len(js)})
    return CoupledModel({"X": x, "U": u, "V": v}, [Factorization("X", ("U", "V"), p=p)])


def test_a_checkpoint_counts_its_cells(spark):
    nan, inf = float("nan"), float("inf")
    t = from_rows(spark, ["i"], [(1, 1.0), (2, None), (3, nan), (4, inf), (5, -inf), (6, inf)]).checkpoint()
    want = {"cells": 6, "nulls": 1, "nans": 1, "infs": 3}
    with jobs(spark) as none:
        assert t.counts == want
        with pytest.raises(ValueError, match="6 cells, 1 NULL, 1 NaN, 3 infinite"):
            check(t)
        assert t.with_cards({"i": 6}).counts == want
    assert none == []
    assert validate(t).first().asDict() == want
    assert validate(t.with_df(t.df)).first().asDict() == want  # by an aggregate
    assert validate(t).schema.simpleString() == validate(t.with_df(t.df)).schema.simpleString()


def test_empty_tensors_are_counted(spark):
    t = from_rows(spark, ["i"], [])
    zeros = {"cells": 0, "nulls": 0, "nans": 0, "infs": 0}
    for empty in (t, t.with_df(t.df.where("false")), t.with_df(t.df.groupBy("i").agg(F.sum("value").alias("value")))):
        assert check(empty.checkpoint()) == zeros


def test_changed_cells_are_not_taken_for_the_counted_ones(spark):
    t = from_rows(spark, ["i"], [(1, 1.0), (2, float("nan"))]).checkpoint()
    assert t.restrict({"i": 1}).counts is None and check(t.restrict({"i": 1}))["cells"] == 1
    assert t.map_values(lambda v: v * 0).counts is None


def test_errors_of_an_update_name_the_counts(spark, tmp_path):
    with pytest.raises(ValueError, match=r"the update of U: 4 cells, 0 NULL, 0 NaN, 4 infinite"):
        run_epoch(_model(spark, huge=True))
    with pytest.raises(ValueError, match="the update of U: 4 cells"):
        fit(_model(spark, huge=True), 2, log=str(tmp_path / "log"))
    assert factor_update(_model(spark, huge=True), "U", "keep").checkpoint().counts["infs"] == 4
    with pytest.raises(ValueError, match="on_invalid"):
        run_epoch(_model(spark), on_invalid="ignore")


def test_a_fit_takes_no_job_for_its_checks(spark):
    """Reading the counts of a written factor, or of X for p = 2, starts no job."""
    model = run_epoch(_model(spark, p=2.0))
    assert {a: model.tensors[a].counts["cells"] for a in ("U", "V")} == {"U": 4, "V": 6}
    stored = model.with_tensors(X=model.tensors["X"].checkpoint())
    from tessera.plans.factorize import _check_finite_objective

    with jobs(spark) as none:
        _check_finite_objective(stored)
        for a in ("X", "U", "V"):
            check(stored.tensors[a], allow_inf=False)
    assert none == []
    with jobs(spark) as some:
        _check_finite_objective(model)
    assert len(some) > 0
