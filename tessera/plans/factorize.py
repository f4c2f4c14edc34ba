"""Coupled tensor factorization by multiplicative updates.

Several observed tensors ``X_v`` are modelled as contractions of latent
factors, some of which are shared between observations:

    X̂_v = contract(Z_b for b in v  ->  indices of X_v)

and each factor is updated in turn (Gauss–Seidel order, first appearance)
with the β-divergence rule for power ``p_v`` and dispersion ``phi_v``:

    num_a = Σ_{v∋a} phi_v⁻¹ · contract(X_v ∘ X̂_v^(−p_v), Z_b (b∈v, b≠a) -> idx Z_a)
    den_a = Σ_{v∋a} phi_v⁻¹ · contract(X̂_v^(1−p_v),      Z_b (b∈v, b≠a) -> idx Z_a)
    Z_a  <- Z_a ∘ num_a / den_a

Scale notes (the plan never needs the full model grid when avoidable):

* ``X̂`` is only computed where ``X`` stores a cell for the numerator
  (and, with ``missing="masked"``, everywhere): the contraction starts
  from the support of ``X`` and joins the factors to it, so its cost is
  ``nnz(X) × rank`` rather than ``Π card``.
* With ``missing="zero"`` and ``p=1`` the denominator does not depend on
  ``X̂`` at all (``X̂⁰ = 1``): it is the other factors summed over their
  private indices, a tiny dense aggregate.  The objective's ``Σ X̂`` is the
  same kind of aggregate.  So the whole KL fit is linear in ``nnz(X)``.
* With ``missing="zero"`` and ``p=0`` the sums over the grid come from the
  factors' Gram matrices (see ``operators.gram``) where no index of ``X``
  belongs to two factors, so a Euclidean fit is linear in ``nnz(X)`` as well.
  Other powers need ``X̂`` on the full grid of ``X`` (``Π card`` cells).
* The sums over observations are one union + aggregate with the factor's
  own cells, so a factor update is a single shuffle on the factor's index.
* Each new factor is materialized with a reliable checkpoint, so plans do
  not grow across epochs and lost executors do not lose the state.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cell import beta_cell
from ..operators.blocks import BlockedTensor, blocked, blocked_gradient, worth_blocking
from ..operators.contract import broadcast_threshold, contract
from ..operators.divergence import beta_divergence
from ..operators.elementwise import guard
from ..operators.gram import gram_denominator, gram_total, separable
from ..operators.sampled import (
    rank_vector_model,
    sampled_contract,
    sampled_gradient,
    shuffles,
)
from ..operators.validate import check as check_values
from ..tensor import VALUE, Tensor
from .epochlog import EpochLog
from .lineage import checkpoint_dir

_Z, _NUM, _DEN, _CELL = "__z", "__num", "__den", "__cell"


@dataclass(frozen=True)
class Factorization:
    """``X_observed ≈ contract(latents)`` under the β-divergence of power ``p``."""

    observed: str
    latents: tuple[str, ...]
    p: float = 1.0
    phi: float = 1.0

    def __post_init__(self) -> None:
        object.__setattr__(self, "latents", tuple(self.latents))
        if self.phi <= 0:
            raise ValueError("phi must be positive")


@dataclass
class CoupledModel:
    """Named tensors plus the factorizations that tie them together.

    ``missing="zero"`` reads unstored cells of an observed tensor as zeros
    (then every observed index needs a cardinality); ``"masked"`` fits the
    stored cells only.  ``salt`` is passed to every contraction.
    """

    tensors: dict[str, Tensor]
    factorizations: list[Factorization]
    missing: str = "zero"
    salt: int | None = None
    cards: dict[str, int] = field(default_factory=dict)
    #: Blocked layouts of the observations, by the place of their factorization.
    layouts: dict[int, BlockedTensor] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.missing not in ("zero", "masked"):
            raise ValueError("missing must be 'zero' or 'masked'")
        for f in self.factorizations:
            for name in (f.observed, *f.latents):
                if name not in self.tensors:
                    raise KeyError(f"tensor {name!r} is not in the model")

    def latent_order(self) -> list[str]:
        order: list[str] = []
        for f in self.factorizations:
            for a in f.latents:
                if a not in order:
                    order.append(a)
        return order

    def containing(self, latent: str) -> list[Factorization]:
        return [f for f in self.factorizations if latent in f.latents]

    def card(self, index: str) -> int:
        if index in self.cards:
            return self.cards[index]
        for t in self.tensors.values():
            if index in t.cards:
                return t.cards[index]
        raise ValueError(f"no cardinality known for index {index!r}")

    def with_tensors(self, **updates: Tensor) -> CoupledModel:
        return replace(self, tensors={**self.tensors, **updates})


# --------------------------------------------------------------- pieces
def _over_model(xv: Column, hat: Column, p: float) -> Column:
    """``x · x̂^(−p)``, and 0 where the model is 0: there every product of the
    factors is 0, so whatever the term is multiplied with (0 · x/0) is 0 too."""
    return F.when(hat == 0, F.lit(0.0)).otherwise(guard(xv * F.pow(hat, F.lit(-float(p))), "raise", "X / X̂^p", finite=True))


def _model_power(hat: Column, p: float) -> Column:
    """``x̂^(1−p)``, by the same rule for p > 1."""
    power = F.pow(hat, F.lit(1.0 - float(p)))
    return F.when(hat == 0, F.lit(0.0)).otherwise(power) if p > 1 else power


def _observed_only(model: CoupledModel, f: Factorization) -> list[str]:
    """Indices of the observation that no factor carries."""
    latent_idx = {i for b in f.latents for i in model.tensors[b].indices}
    return [i for i in model.tensors[f.observed].indices if i not in latent_idx]


def predict(model: CoupledModel, f: Factorization, on: str = "full") -> Tensor:
    """``X̂`` of one factorization: on the full grid of ``X`` or on its support."""
    x = model.tensors[f.observed]
    zs = [model.tensors[b] for b in f.latents]
    if on == "support":
        return sampled_contract(x, zs, salt=model.salt)
    if on != "full":
        raise ValueError("on must be 'full' or 'support'")
    space = {i: model.card(i) for i in _observed_only(model, f)}
    return contract(zs, x.indices, index_space=space or None, salt=model.salt, order="given")


def q_numerator(model: CoupledModel, f: Factorization) -> Tensor:
    """``X ∘ X̂^(−p)`` on the support of ``X`` (zero wherever ``X`` is)."""
    x = model.tensors[f.observed]
    zs = [model.tensors[b] for b in f.latents]
    return sampled_contract(x, zs, lambda xv, hat: _over_model(xv, hat, f.p), salt=model.salt)


def q_denominator(model: CoupledModel, f: Factorization) -> Tensor:
    """``X̂^(1−p)``: on the support of ``X`` when masked, else on its full grid."""
    if model.missing == "masked":
        x = model.tensors[f.observed]
        zs = [model.tensors[b] for b in f.latents]
        return sampled_contract(x, zs, lambda xv, hat: _model_power(hat, f.p), salt=model.salt)
    return predict(model, f, on="full").map_values(lambda hat: _model_power(hat, f.p))


def _delta_indices(model: CoupledModel, f: Factorization, a: str, q: Sequence[str]) -> list[str]:
    others = {i for b in f.latents if b != a for i in model.tensors[b].indices}
    return [i for i in model.tensors[a].indices if i in others or i in q]


def delta(
    model: CoupledModel, f: Factorization, a: str, which: int = 1, reduce: bool = True
) -> Tensor:
    """The numerator (1) or denominator (2) contraction of ``Z_a`` for ``X_v``.

    The result is over the indices of ``Z_a`` that the observation or the
    other factors carry; it is constant along the rest.  The ``p=1``
    denominator on the full grid is over the indices ``Z_a`` shares with
    the other factors only (see ``_ones_denominator``).
    """
    others = [model.tensors[b] for b in f.latents if b != a]
    x = model.tensors[f.observed]
    if which == 1:
        q = q_numerator(model, f)
    elif which == 2:
        if model.missing == "zero" and f.p == 1.0:
            return _ones_denominator(model, f, a)
        if model.missing == "zero" and f.p == 0.0 and (split := _gram_model(model, f)):
            scale = float(math.prod(model.card(i) for i in _observed_only(model, f)))
            return gram_denominator(model.tensors[a], others, *split, scale=scale)
        q = q_denominator(model, f)
    else:
        raise ValueError("which must be 1 (numerator) or 2 (denominator)")
    out = _delta_indices(model, f, a, x.indices)
    return contract([q, *others], out, salt=model.salt, reduce=reduce, order="given")


def _gram_model(model: CoupledModel, f: Factorization) -> tuple[list[str], dict[str, int]] | None:
    """Rank indices and their cardinalities where the grid's sums split by factor."""
    zs = [model.tensors[b] for b in f.latents]
    rank = separable(model.tensors[f.observed], zs)
    if rank is None or len(set(f.latents)) < len(f.latents):
        return None
    return rank, {r: next(z.cards[r] for z in zs if r in z.cards) for r in rank}


def _ones_denominator(model: CoupledModel, f: Factorization, a: str) -> Tensor:
    """Denominator for ``p=1`` on the full grid: ``X̂⁰ = 1`` drops out.

    ``Σ_{grid} Π_{b≠a} Z_b`` is the other factors contracted to the indices
    they share with ``Z_a``, times the cardinality of every observed index
    no factor carries.
    """
    others = [model.tensors[b] for b in f.latents if b != a]
    za = model.tensors[a]
    scale = float(math.prod(model.card(i) for i in _observed_only(model, f)))
    shared = [i for i in za.indices if any(i in o.indices for o in others)]
    if others:
        t = contract(others, shared, salt=model.salt, order="given")
        return t if scale == 1.0 else t.map_values(lambda v: v * F.lit(scale))
    one = za.df.sparkSession.range(1).select(F.lit(scale).alias(VALUE))
    return Tensor(one, ())


def _expand(part: Tensor, za: Tensor) -> DataFrame:
    """Broadcast a part over the indices of ``Z_a`` it lacks."""
    if set(part.indices) == set(za.indices):
        return part.df.select(*za.indices, VALUE)
    keys = za.df.select(*za.indices)
    if part.indices:
        side = part.df.select(*part.indices, VALUE)
        bound = part.bound_bytes()
        if bound is not None and bound <= broadcast_threshold(side):
            side = F.broadcast(side)
        joined = keys.join(side, list(part.indices), "inner")
    else:
        joined = keys.crossJoin(F.broadcast(part.df.select(VALUE)))
    return joined.select(*za.indices, VALUE)


def _fused_parts(model: CoupledModel, f: Factorization, a: str, types, w) -> list[DataFrame] | None:
    """Numerator (and masked denominator) rows from one pass over ``X``.

    Only for rank-vector models (see ``operators.sampled``); ``None`` lets
    the caller use the general contractions.
    """
    x = model.tensors[f.observed]
    zs = [model.tensors[b] for b in f.latents]
    if rank_vector_model(x, zs) is None:
        return None
    za = model.tensors[a]
    idx = list(za.indices)
    none = F.lit(None).cast("double")
    p = float(f.p)
    outputs = {_NUM: lambda xv, hat: _over_model(xv, hat, p)}
    if model.missing == "masked":
        outputs[_DEN] = lambda xv, hat: _model_power(hat, p)
    target, layout = list(f.latents).index(a), model.layouts.get(model.factorizations.index(f))
    if layout is not None:
        rows = blocked_gradient(layout, x, zs, target, p, _DEN in outputs, [_NUM, _DEN])
    else:
        rows = sampled_gradient(x, zs, target, outputs, salt=model.salt)
    keys = [F.col(i).cast(types[i]).alias(i) for i in idx]
    den = F.col(_DEN) * w if _DEN in outputs else none
    pieces = [rows.select(*keys, none.alias(_Z), (F.col(_NUM) * w).alias(_NUM), den.alias(_DEN))]
    if _DEN not in outputs:
        part = _expand(delta(model, f, a, 2), za)
        pieces.append(part.select(*[F.col(i).cast(types[i]).alias(i) for i in idx], none.alias(_Z),
                                  none.alias(_NUM), (F.col(VALUE) * w).alias(_DEN)))
    return pieces


def factor_update(model: CoupledModel, a: str, on_invalid: str = "raise") -> Tensor:
    """``Z_a ∘ (Σ_v phi_v⁻¹ num_v) / (Σ_v phi_v⁻¹ den_v)`` as one aggregate.

    The factor's cells, all numerators and all denominators are unioned
    and grouped by the factor's indices once.  A cell with no denominator
    (no observation touches it, possible when masked) keeps its value.  A
    new value that is NULL, NaN or infinite raises unless ``on_invalid`` is
    ``"keep"``.
    """
    za = model.tensors[a]
    idx = list(za.indices)
    types = {f.name: f.dataType for f in za.df.schema.fields}
    none = F.lit(None).cast("double")
    pieces = [za.df.select(*idx, F.col(VALUE).alias(_Z), none.alias(_NUM), none.alias(_DEN))]
    for f in model.containing(a):
        w = F.lit(1.0 / f.phi)
        fused = _fused_parts(model, f, a, types, w)
        if fused is not None:
            pieces.extend(fused)
            continue
        # Parts over all of Z_a's indices stay unreduced: the aggregate
        # below sums them together with everything else.
        full = len(_delta_indices(model, f, a, model.tensors[f.observed].indices)) == len(idx)
        for which, name in ((1, _NUM), (2, _DEN)):
            part = _expand(delta(model, f, a, which, reduce=not full), za)
            cols = {_Z: none, _NUM: none, _DEN: none, name: F.col(VALUE) * w}
            keys = [F.col(i).cast(types[i]).alias(i) for i in idx]  # the factor's own types
            pieces.append(part.select(*keys, *[c.alias(n) for n, c in cols.items()]))
    union = pieces[0]
    for p in pieces[1:]:
        union = union.unionByName(p)
    # After a shuffled factor join, the key is one struct: the join's partitioning
    # does not satisfy it, so partial sums are exchanged before the final ones and
    # adaptive execution may split a hot key's join partition.
    split = any(shuffles(model.tensors[f.observed], [model.tensors[b] for b in f.latents]) for f in model.containing(a))
    keys = [F.struct(*idx).alias(_CELL)] if split else idx
    agg = union.groupBy(*keys).agg(
        F.sum(_Z).alias(_Z), F.sum(_NUM).alias(_NUM), F.sum(_DEN).alias(_DEN)
    )
    if split:
        agg = agg.select(f"{_CELL}.*", _Z, _NUM, _DEN)
    z, num, den = F.col(_Z), F.coalesce(F.col(_NUM), F.lit(0.0)), F.col(_DEN)
    new = F.when(den > 0, z * num / den).otherwise(z)
    new = guard(new, on_invalid, f"the update of {a}", finite=True)
    df = agg.filter(z.isNotNull()).select(*idx, new.alias(VALUE))
    return Tensor(df, za.indices, za.cards)


def alpha(model: CoupledModel, a: str, which: int = 1) -> Tensor:
    """``Σ_v phi_v⁻¹ delta_v``: numerator (1) or denominator (2) of the update
    of ``Z_a`` over all observations it takes part in, on its own cells."""
    za = model.tensors[a]
    idx = list(za.indices)
    types = {f.name: f.dataType for f in za.df.schema.fields}
    union = None
    for f in model.containing(a):
        part = _expand(delta(model, f, a, which), za)
        piece = part.select(*[F.col(i).cast(types[i]).alias(i) for i in idx],
                            (F.col(VALUE) / F.lit(float(f.phi))).alias(VALUE))
        union = piece if union is None else union.unionByName(piece)
    return Tensor(union.groupBy(*idx).agg(F.sum(VALUE).alias(VALUE)), za.indices, za.cards)


# ------------------------------------------------------------ objective
def factorization_divergence(model: CoupledModel, f: Factorization) -> DataFrame:
    """``D_v = Σ d_p(X_v | X̂_v)`` as a one-row DataFrame (``divergence``)."""
    x = model.tensors[f.observed]
    zs = [model.tensors[b] for b in f.latents]
    if model.missing == "masked":
        cells = sampled_contract(x, zs, lambda xv, hat: beta_cell(xv, hat, f.p), salt=model.salt)
        return cells.df.agg(F.sum(VALUE).alias("divergence"))
    if f.p == 0.0 and (split := _gram_model(model, f)):
        # Σ_support [½(x − x̂)² − ½x̂²] + ½ Σ_grid x̂².
        cells = sampled_contract(
            x, zs, lambda xv, hat: beta_cell(xv, hat, 0.0) - F.lit(0.5) * hat * hat, salt=model.salt)
        half = 0.5 * math.prod(model.card(i) for i in _observed_only(model, f))
        total = gram_total(zs, *split).select((F.col(VALUE) * F.lit(half)).alias("__s"))
        return cells.df.agg(F.sum(VALUE).alias("__s")).unionByName(total).agg(F.sum("__s").alias("divergence"))
    if f.p != 1.0:
        return beta_divergence(x, predict(model, f, on="full"), f.p, missing="zero")
    # p = 1: Σ_support [d(x|x̂) − x̂] + Σ_grid x̂, the last term from the
    # factors alone, so the full grid is never built.
    cells = sampled_contract(
        x, zs, lambda xv, hat: beta_cell(xv, hat, 1.0) - hat, salt=model.salt
    )
    on_support = cells.df.agg(F.sum(VALUE).alias("__s"))
    space = {i: model.card(i) for i in _observed_only(model, f)}
    total = contract(zs, [], index_space=space or None, order="given")
    both = on_support.unionByName(total.df.select(F.col(VALUE).alias("__s")))
    return both.agg(F.sum("__s").alias("divergence"))


def model_divergence(model: CoupledModel) -> DataFrame:
    """One row per factorization: ``(factorization, p, phi, divergence)``."""
    return _numbered_divergence(model).drop("n")


def _numbered_divergence(model: CoupledModel) -> DataFrame:
    """With the place ``n`` of the factorization: several may share an observation."""
    rows = None
    for n, f in enumerate(model.factorizations):
        d = factorization_divergence(model, f).select(
            F.lit(n).alias("n"),
            F.lit(f.observed).alias("factorization"),
            F.lit(float(f.p)).alias("p"),
            F.lit(float(f.phi)).alias("phi"),
            F.col("divergence"),
        )
        rows = d if rows is None else rows.unionByName(d)
    return rows


# ------------------------------------------------------------------ fit
@dataclass
class FitResult:
    model: CoupledModel
    history: DataFrame  # (epoch INT, factorization STRING, divergence DOUBLE)
    objective: list[float]


def run_epoch(model: CoupledModel, checkpoint: bool = True, on_invalid: str = "raise",
              check: bool = True, keep: Callable[[str, Tensor], Tensor] | None = None) -> CoupledModel:
    """Update every latent factor once, in order of first appearance.

    ``check`` refuses models whose objective is infinite (see ``fit``, which
    checks once for all its epochs).  ``keep(name, tensor)`` stores a new factor
    in place of a checkpoint.  A stored factor with a NULL, NaN or infinite value
    raises ``ValueError`` with their counts, unless ``on_invalid`` is ``"keep"``."""
    if on_invalid not in ("raise", "keep"):
        raise ValueError(f"on_invalid must be 'raise' or 'keep', not {on_invalid!r}")
    if check:
        _check_finite_objective(model)
    for a in model.latent_order():
        written = bool(keep) or checkpoint
        # Values are counted while they are written, so that an error can tell how many are wrong.
        new = factor_update(model, a, "keep" if written else on_invalid)
        if written:
            new = keep(a, new) if keep else new.checkpoint()
        if written and on_invalid == "raise":
            check_values(new, allow_inf=False, what=f"the update of {a}")
        model = model.with_tensors(**{a: new})
    return model


def materialize_observed(model: CoupledModel) -> CoupledModel:
    """Checkpoint each observed tensor once: it is read by every update.

    Observations whose factors are large, or of a high rank, are also written
    by block (see ``operators.blocks``), so that updates don't move them."""
    seen = {}
    for f in model.factorizations:
        t = model.tensors[f.observed]
        if f.observed not in seen and not t.materialized:
            seen[f.observed] = t.checkpoint()
    model = model.with_tensors(**seen)
    layouts = dict(model.layouts)
    for n, f in enumerate(model.factorizations):
        x, zs = model.tensors[f.observed], [model.tensors[b] for b in f.latents]
        if n not in layouts and worth_blocking(x, zs):
            checkpoint_dir(x.df.sparkSession)
            layouts[n] = blocked(x, zs)
    return replace(model, layouts=layouts)


def _check_finite_objective(model: CoupledModel) -> None:
    """With zeros for unstored cells, p ≥ 2 makes every unstored cell cost +∞."""
    if model.missing != "zero":
        return
    for f in model.factorizations:
        if f.p < 2.0:
            continue
        x = model.tensors[f.observed]
        numel = math.prod(model.card(i) for i in x.indices)
        if (x.counts["cells"] if x.counts else x.df.count()) < numel:
            raise ValueError(
                f"{f.observed}: with p={f.p} an unstored cell read as zero has infinite "
                "divergence; use missing='masked' or store every cell"
            )


def _settled(objective: list[float], tol: float | None) -> bool:
    if tol is None or len(objective) < 2:
        return False
    prev, j = objective[-2:]
    return prev - j <= tol * abs(prev)


def fit(
    model: CoupledModel,
    epochs: int,
    tol: float | None = None,
    checkpoint: bool = True,
    monitor: bool = True,
    on_invalid: str = "raise",
    log: str | None = None,
) -> FitResult:
    """Run ``epochs`` rounds of updates; record the divergence after each.

    The objective ``J = Σ_v phi_v⁻¹ D_v`` is computed from the factors
    after the whole epoch.  Multiplicative updates never increase it, so an
    increase beyond rounding is reported with a warning.  With ``tol``,
    the loop stops once the relative decrease of ``J`` falls below it.
    Only one row per factorization and epoch reaches the driver.

    ``log`` names a folder on shared storage (see ``EpochLog``) in which every
    epoch is recorded: a call with the folder of an earlier one, of the same
    model, goes on after its last complete epoch, up to ``epochs`` in all.  The
    folder holds the factors of two epochs at most.
    """
    spark = next(iter(model.tensors.values())).df.sparkSession
    rows: list[tuple[int, str, float]] = []
    objective: list[float] = []
    done, record = 0, None
    if log is not None:
        record = EpochLog(log, model)
        done, past = record.read()
        if done > epochs:
            raise ValueError(f"{log} holds {done} epochs, more than the {epochs} asked for")
        if done:
            model = record.load(model, done)
        for epoch in range(1, done + 1):
            divs = past.get(epoch, {})
            if divs:
                rows += [(epoch, f.observed, divs[n]) for n, f in enumerate(model.factorizations)]
                objective.append(sum(divs[n] / f.phi for n, f in enumerate(model.factorizations)))
        if _settled(objective, tol) or done == epochs:
            history = spark.createDataFrame(rows, "epoch INT, factorization STRING, divergence DOUBLE")
            return FitResult(model, history, objective)
    if checkpoint:
        model = materialize_observed(model)
    _check_finite_objective(model)
    for epoch in range(done + 1, epochs + 1):
        keep = partial(record.write, epoch) if record else None
        model = run_epoch(model, checkpoint, on_invalid, check=False, keep=keep)
        if not (monitor or tol):
            if record:
                record.close(epoch, {})
            continue
        divs = {r["n"]: float(r["divergence"]) for r in _numbered_divergence(model).collect()}
        j = 0.0
        for n, f in enumerate(model.factorizations):
            rows.append((epoch, f.observed, divs[n]))
            j += divs[n] / f.phi
        if objective and j > objective[-1] * (1 + 1e-9) + 1e-12:
            warnings.warn(f"objective rose from {objective[-1]} to {j} at epoch {epoch}")
        objective.append(j)
        if record:
            record.close(epoch, divs)
        if _settled(objective, tol):
            break
    history = spark.createDataFrame(rows, "epoch INT, factorization STRING, divergence DOUBLE")
    return FitResult(model, history, objective)

