"""Property-based checks: random contractions against NumPy einsum."""

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from helpers import from_rows, to_dict
from tessera import T, contract, elementwise

LETTERS = "abcd"
DIMS = {"a": 2, "b": 3, "c": 2, "d": 3}


@st.composite
def specs(draw):
    n = draw(st.integers(1, 3))
    operands = []
    for _ in range(n):
        k = draw(st.integers(1, 3))
        operands.append("".join(draw(st.permutations(LETTERS))[:k]))
    used = sorted(set("".join(operands)))
    out = "".join(i for i in used if draw(st.booleans()))
    seed = draw(st.integers(0, 10_000))
    density = draw(st.sampled_from([1.0, 0.5]))
    return operands, out, seed, density


def tensor(spark, idx, rng, density):
    shape = [DIMS[i] for i in idx]
    arr = rng.uniform(0.5, 2.0, size=shape) * (rng.uniform(size=shape) < density)
    rows = [tuple(int(c) + 1 for c in pos) + (float(arr[pos]),)
            for pos in np.ndindex(*shape) if arr[pos] != 0]
    return from_rows(spark, list(idx), rows, {i: DIMS[i] for i in idx}), arr


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(specs())
def test_contract_equals_einsum(spark, spec):
    operands, out, seed, density = spec
    rng = np.random.default_rng(seed)
    ts, arrs = zip(*[tensor(spark, idx, rng, density) for idx in operands])
    want = np.einsum(",".join(operands) + "->" + out, *arrs)
    got = to_dict(contract(list(ts), list(out)))
    if not out:
        assert got.get((), 0.0) == pytest.approx(float(want), rel=1e-9, abs=1e-12)
        return
    for pos in np.ndindex(*want.shape):
        key = tuple(int(c) + 1 for c in pos)
        assert got.get(key, 0.0) == pytest.approx(float(want[pos]), rel=1e-9, abs=1e-12)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(0, 10_000), st.sampled_from(["+", "-", "*"]))
def test_elementwise_outer_fill_is_dense_arithmetic(spark, seed, op):
    rng = np.random.default_rng(seed)
    a, aa = tensor(spark, "ab", rng, 0.5)
    b, bb = tensor(spark, "ab", rng, 0.5)
    expr = {"+": T(a) + T(b), "-": T(a) - T(b), "*": T(a) * T(b)}[op]
    got = to_dict(elementwise(expr, how="outer", fill=0.0))
    want = {"+": aa + bb, "-": aa - bb, "*": aa * bb}[op]
    stored = (aa != 0) | (bb != 0)
    for pos in np.ndindex(*want.shape):
        key = tuple(int(c) + 1 for c in pos)
        if stored[pos]:
            assert got[key] == pytest.approx(float(want[pos]))
        else:
            assert key not in got
