"""The record of a fit's epochs, from which a later call goes on.

The folder holds ``factors-0`` and ``factors-1``, written in turn, so that the
factors of the last complete epoch are never touched while the next one is
being made, and ``epochs/<n>``, written last: an epoch without it did not take
place.  Everything is written by Spark jobs, as Parquet.
"""

from __future__ import annotations

import json
from dataclasses import replace

from pyspark.errors import AnalysisException
from pyspark.sql import Observation

from ..tensor import VALUE, Tensor, value_counts


class EpochLog:
    def __init__(self, path: str, model):
        self.path = path.rstrip("/")
        self.spark = next(iter(model.tensors.values())).df.sparkSession
        self.latents = model.latent_order()
        # What must agree for one fit to continue another.
        self.shape = json.dumps({
            "factorizations": [[f.observed, list(f.latents), float(f.p), float(f.phi)] for f in model.factorizations],
            "missing": model.missing,
            "factors": {a: [[i, model.tensors[a].cards.get(i)] for i in model.tensors[a].indices] for a in self.latents},
        }, sort_keys=True)

    def _factor(self, epoch: int, name: str) -> str:
        return f"{self.path}/factors-{epoch % 2}/{name}"

    def read(self) -> tuple[int, dict[int, dict[int, float]]]:
        """The last complete epoch (0: none), and divergences by epoch and
        factorization.  ``ValueError`` if the folder is another model's."""
        schema = "epoch INT, n INT, divergence DOUBLE, shape STRING"
        try:
            # A row per epoch and factorization.
            found = self.spark.read.schema(schema).option("recursiveFileLookup", True).parquet(f"{self.path}/epochs").collect()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return 0, {}
        divs: dict[int, dict[int, float]] = {}
        for r in found:
            if r["shape"] != self.shape:
                raise ValueError(f"{self.path} is the log of another model")
            of = divs.setdefault(r["epoch"], {})
            if r["divergence"] is not None:
                of[r["n"]] = r["divergence"]
        return max(divs, default=0), divs

    def load(self, model, epoch: int):
        """``model`` with the factors after ``epoch``."""
        return model.with_tensors(**{a: self._stored(epoch, a, model.tensors[a]) for a in self.latents})

    def write(self, epoch: int, name: str, t: Tensor) -> Tensor:
        """Store a new factor of ``epoch`` in place of that of two epochs before."""
        seen = Observation()
        t.cells().observe(seen, *value_counts()).write.mode("overwrite").parquet(self._factor(epoch, name))
        return replace(self._stored(epoch, name, t), counts=seen.get)

    def _stored(self, epoch: int, name: str, like: Tensor) -> Tensor:
        schema = like.df.select(*like.indices, VALUE).schema
        stored = self.spark.read.schema(schema).parquet(self._factor(epoch, name))
        return Tensor(stored, like.indices, like.cards, materialized=True)

    def close(self, epoch: int, divergences: dict[int, float]) -> None:
        """Record that ``epoch`` is complete; one file, so it is there or not."""
        rows = [(epoch, n, float(d), self.shape) for n, d in sorted(divergences.items())] or [(epoch, 0, None, self.shape)]
        (self.spark.createDataFrame(rows, "epoch INT, n INT, divergence DOUBLE, shape STRING").coalesce(1)
         .write.mode("overwrite").parquet(f"{self.path}/epochs/{epoch}"))
