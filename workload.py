"""Tensors over the driver tables, and the SQL that defines the same tensors.

Each tensor is built from the parquet tables with ``from_table`` (one row
per cell, duplicates summed).  Index ranges of the latent factors come from
the data (the largest stored coordinate), so every workload grows with the
tables.  The SQL side (for the DuckDB oracle) is written independently from
the definitions, as plain joins and aggregates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import Tensor, cardinalities, formula_tensor, from_table, tensors_from_table

RANK = 4  # number of latent components (index k)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _line_supp(spark, d):
    li = table(spark, d, "lineitem")
    su = table(spark, d, "supplier")
    return li.join(su, li.l_suppkey == su.s_suppkey, "inner")


def _line_supp_part(spark, d):
    pa = table(spark, d, "part")
    ls = _line_supp(spark, d)
    return ls.join(pa, ls.l_partkey == pa.p_partkey, "inner")


# ------------------------------------------------------------- tensors
def X1(spark, d) -> Tensor:
    """Quantity by supplier nation (1-based) and part size."""
    return from_table(_line_supp_part(spark, d),
                      {"i": F.col("s_nationkey") + 1, "j": "p_size"}, "l_quantity")


def Y1(spark, d) -> Tensor:
    """Number of line items by supplier nation and part size."""
    return from_table(_line_supp_part(spark, d),
                      {"i": F.col("s_nationkey") + 1, "j": "p_size"}, F.lit(1.0))


def W1(spark, d) -> Tensor:
    """Summed discount by supplier nation and part size."""
    return from_table(_line_supp_part(spark, d),
                      {"i": F.col("s_nationkey") + 1, "j": "p_size"}, "l_discount")


def quantity_count_discount(spark, d) -> dict[str, Tensor]:
    """X1, Y1 and W1 from one pass over the line items."""
    return tensors_from_table(_line_supp_part(spark, d), {"i": F.col("s_nationkey") + 1, "j": "p_size"},
                              {"X1": "l_quantity", "Y1": F.lit(1.0), "W1": "l_discount"})


def X2(spark, d) -> Tensor:
    """Quantity by supplier nation (1-based) and line number."""
    return from_table(_line_supp(spark, d),
                      {"i": F.col("s_nationkey") + 1, "r": "l_linenumber"}, "l_quantity")


def A(spark, d, returned: bool | None = None) -> Tensor:
    """Quantity by supplier nation and part key (sparse); of the returned or of all other line items."""
    ls = _line_supp(spark, d)
    if returned is not None:
        ls = ls.filter((F.coalesce("l_returnflag", F.lit("")) == "R") == returned)
    return from_table(ls, {"n": "s_nationkey", "part": "l_partkey"}, "l_quantity")


def D(spark, d) -> Tensor:
    """Quantity by supplier nation and part, both 1-based (sparse)."""
    return from_table(_line_supp(spark, d),
                      {"i": F.col("s_nationkey") + 1, "p": F.col("l_partkey") + 1}, "l_quantity")


def triangle(spark, d) -> list[Tensor]:
    """Quantities by (supplier, part) and (part, customer), line items by (supplier, customer)."""
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    lo = li.join(o, li.l_orderkey == o.o_orderkey, "inner")
    return [from_table(li, {"s": "l_suppkey", "p": "l_partkey"}, "l_quantity"),
            from_table(lo, {"p": "l_partkey", "c": "o_custkey"}, "l_quantity"),
            from_table(lo, {"s": "l_suppkey", "c": "o_custkey"}, F.lit(1.0))]


SQL_TRIANGLE = (
    "WITH lo AS (SELECT * FROM lineitem JOIN orders ON l_orderkey = o_orderkey), "
    "sp AS (SELECT l_suppkey AS s, l_partkey AS p, SUM(CAST(l_quantity AS DOUBLE)) AS value FROM lineitem "
    "WHERE l_suppkey IS NOT NULL AND l_partkey IS NOT NULL GROUP BY 1, 2), "
    "pc AS (SELECT l_partkey AS p, o_custkey AS c, SUM(CAST(l_quantity AS DOUBLE)) AS value FROM lo "
    "WHERE l_partkey IS NOT NULL AND o_custkey IS NOT NULL GROUP BY 1, 2), "
    "sc AS (SELECT l_suppkey AS s, o_custkey AS c, SUM(1.0) AS value FROM lo "
    "WHERE l_suppkey IS NOT NULL AND o_custkey IS NOT NULL GROUP BY 1, 2) ")


def B(spark, d) -> Tensor:
    """Retail price by part key and brand."""
    return from_table(table(spark, d, "part"), {"part": "p_partkey", "brand": "p_brand"},
                      "p_retailprice")


def R(spark, d) -> Tensor:
    """Nation-to-region membership (value 1)."""
    return from_table(table(spark, d, "nation"), {"n": "n_nationkey", "region": "n_regionkey"},
                      F.lit(1.0))


def E(spark, d) -> Tensor:
    """Summed event value by user and event type."""
    return from_table(table(spark, d, "events"), {"user": "user_id", "type": "event_type"},
                      "value")


def init_value(a, b):
    """Deterministic initial factor value for indices ``a, b``."""
    return ((a * 7 + b * 3) % 11 + 1) / F.lit(11.0)


def factor(spark, indices, cards) -> Tensor:
    return formula_tensor(spark, indices, cards, init_value)


def has_checkpoint_dir(spark: SparkSession) -> bool:
    """Whether the session names a folder for checkpoints that executors share."""
    sc = spark.sparkContext
    return bool(sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
                or sc.getConf().get("spark.checkpoint.dir"))


def observed(t: Tensor) -> tuple[Tensor, dict[str, int]]:
    """An observation and its index ranges.  It is checkpointed where the
    session names a folder; else it stays a plain plan that is run again."""
    if has_checkpoint_dir(t.df.sparkSession):
        t = t.checkpoint()
    cards = cardinalities(t)
    return t.with_cards(cards), cards


def x1_model_tensors(spark, d) -> dict[str, Tensor]:
    x1, cards = observed(X1(spark, d))
    return {
        "X1": x1,
        "Z1": factor(spark, ["i", "k"], {"i": cards["i"], "k": RANK}),
        "Z2": factor(spark, ["k", "j"], {"k": RANK, "j": cards["j"]}),
    }


def coupled_model_tensors(spark, d) -> dict[str, Tensor]:
    ts = x1_model_tensors(spark, d)
    ts["X2"], cards = observed(X2(spark, d))
    ts["Z3"] = factor(spark, ["k", "r"], {"k": RANK, "r": cards["r"]})
    return ts


def sparse_model_tensors(spark, d, rank: int = RANK) -> dict[str, Tensor]:
    x, cards = observed(D(spark, d))
    return {
        "D": x,
        "U": factor(spark, ["i", "k"], {"i": cards["i"], "k": rank}),
        "V": factor(spark, ["k", "p"], {"k": rank, "p": cards["p"]}),
    }


def absent_rows_tensors(spark, d, step: int = 7) -> dict[str, Tensor]:
    """The sparse model with every ``step``-th key of V not stored."""
    ts = sparse_model_tensors(spark, d)
    v = ts["V"]
    return {**ts, "V": v.with_df(v.df.where(F.col("p") % step != 0))}


def user_rows_tensors(spark, d) -> dict[str, Tensor]:
    """A model of one factor: X1(i, j) as the sum over k of Z(i, k)."""
    ts = x1_model_tensors(spark, d)
    return {"X1": ts["X1"], "Z1": ts["Z1"]}


def rounded(t: Tensor, digits: int) -> DataFrame:
    return t.df.select(*t.indices, F.round("value", digits).alias("value"))


# ------------------------------------------------------------------ SQL
_LS = "lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey"
_LSP = _LS + " JOIN part pa ON l.l_partkey = pa.p_partkey"


def _cells(index_exprs: dict[str, str], value: str, source: str, where: str = "") -> str:
    conds = [f"({e}) IS NOT NULL" for e in [*index_exprs.values(), value]]
    if where:
        conds.append(where)
    cols = ", ".join(f"{e} AS {n}" for n, e in index_exprs.items())
    keys = ", ".join(str(n + 1) for n in range(len(index_exprs)))
    return (f"SELECT {cols}, SUM(CAST({value} AS DOUBLE)) AS value FROM {source} "
            f"WHERE {' AND '.join(conds)} GROUP BY {keys}")


SQL_TENSORS: dict[str, tuple[list[str], str]] = {
    "X1": (["i", "j"], _cells({"i": "s.s_nationkey + 1", "j": "pa.p_size"}, "l.l_quantity", _LSP)),
    "Y1": (["i", "j"], _cells({"i": "s.s_nationkey + 1", "j": "pa.p_size"}, "1.0", _LSP)),
    "W1": (["i", "j"], _cells({"i": "s.s_nationkey + 1", "j": "pa.p_size"}, "l.l_discount", _LSP)),
    "X2": (["i", "r"], _cells({"i": "s.s_nationkey + 1", "r": "l.l_linenumber"}, "l.l_quantity", _LS)),
    "A": (["n", "part"], _cells({"n": "s.s_nationkey", "part": "l.l_partkey"}, "l.l_quantity", _LS)),
    "AR": (["n", "part"], _cells({"n": "s.s_nationkey", "part": "l.l_partkey"}, "l.l_quantity", _LS,
                                 "l.l_returnflag = 'R'")),
    "AN": (["n", "part"], _cells({"n": "s.s_nationkey", "part": "l.l_partkey"}, "l.l_quantity", _LS,
                                 "coalesce(l.l_returnflag, '') <> 'R'")),
    "D": (["i", "p"], _cells({"i": "s.s_nationkey + 1", "p": "l.l_partkey + 1"}, "l.l_quantity", _LS)),
    "B": (["part", "brand"], _cells({"part": "p_partkey", "brand": "p_brand"}, "p_retailprice", "part")),
    "R": (["n", "region"], _cells({"n": "n_nationkey", "region": "n_regionkey"}, "1.0", "nation")),
    "E": (["user", "type"], _cells({"user": "user_id", "type": "event_type"}, "value", "events")),
}


def sql_factor(name: str, a: str, b: str, card_a: str, card_b: str) -> str:
    """A dense initial factor over ``1..card_a`` × ``1..card_b``."""
    return (f"SELECT CAST(ga.x AS INTEGER) AS {a}, CAST(gb.x AS INTEGER) AS {b}, "
            f"((ga.x * 7 + gb.x * 3) % 11 + 1) / 11.0 AS value "
            f"FROM generate_series(1, {card_a}) ga(x) CROSS JOIN generate_series(1, {card_b}) gb(x)")


class SqlBuilder:
    """Accumulates named CTEs (tensors with known indices) into one query."""

    def __init__(self) -> None:
        self.ctes: list[tuple[str, str]] = []
        self.indices: dict[str, list[str]] = {}
        self._n = 0

    def add(self, name: str, indices: list[str], sql: str) -> str:
        self.ctes.append((name, sql))
        self.indices[name] = list(indices)
        return name

    def tensor(self, name: str) -> str:
        if name not in self.indices:
            idx, sql = SQL_TENSORS[name]
            self.add(name, idx, sql)
        return name

    def fresh(self, prefix: str) -> str:
        self._n += 1
        return f"{prefix}_{self._n}"

    def render(self, final: str) -> str:
        if not self.ctes:
            return final
        body = ",\n".join(f"{n} AS MATERIALIZED ({s})" for n, s in self.ctes)
        return f"WITH {body}\n{final}"

    # -- operators in SQL ------------------------------------------------
    def contract(self, inputs: list[str], out: list[str], scale: str | None = None,
                 prefix: str = "c") -> str:
        aliases = [f"t{n}" for n in range(len(inputs))]
        owner: dict[str, str] = {}
        from_sql = ""
        for a, name in zip(aliases, inputs):
            conds = [f"{a}.{i} = {owner[i]}.{i}" for i in self.indices[name] if i in owner]
            if not from_sql:
                from_sql = f"{name} {a}"
            elif conds:
                from_sql += f" JOIN {name} {a} ON " + " AND ".join(conds)
            else:
                from_sql += f" CROSS JOIN {name} {a}"
            for i in self.indices[name]:
                owner.setdefault(i, a)
        prod = " * ".join(f"{a}.value" for a in aliases)
        if scale:
            prod = f"({prod}) * {scale}"
        cols = "".join(f"{owner[i]}.{i} AS {i}, " for i in out)
        group = (" GROUP BY " + ", ".join(f"{owner[i]}.{i}" for i in out)) if out else ""
        return self.add(self.fresh(prefix), out,
                        f"SELECT {cols}SUM({prod}) AS value FROM {from_sql}{group}")

    def map(self, name: str, fn, prefix: str = "m") -> str:
        idx = self.indices[name]
        cols = "".join(f"{i}, " for i in idx)
        return self.add(self.fresh(prefix), idx, f"SELECT {cols}{fn('value')} AS value FROM {name}")

    def join2(self, left: str, right: str, fn, how: str = "JOIN", prefix: str = "e") -> str:
        idx = self.indices[left]
        if how == "JOIN":
            cols = ", ".join(f"a.{i}" for i in idx)
        else:
            cols = ", ".join(f"COALESCE(a.{i}, b.{i}) AS {i}" for i in idx)
        on = " AND ".join(f"a.{i} = b.{i}" for i in idx)
        return self.add(self.fresh(prefix), idx,
                        f"SELECT {cols}, {fn('a.value', 'b.value')} AS value "
                        f"FROM {left} a {how} {right} b ON {on}")

    def support(self, name: str) -> str:
        return self.map(name, lambda v: "1.0", prefix="s")

    def grid(self, indices: list[str], cards: dict[str, str]) -> str:
        """All coordinates of ``indices`` with value 1."""
        parts = [f"generate_series(1, {cards[i]}) g{n}(x)" for n, i in enumerate(indices)]
        cols = ", ".join(f"CAST(g{n}.x AS INTEGER) AS {i}" for n, i in enumerate(indices))
        return self.add(self.fresh("g"), indices,
                        f"SELECT {cols}, 1.0 AS value FROM {' CROSS JOIN '.join(parts)}")


def sql_beta(x: str, mu: str, p: float) -> str:
    """Per-cell β-divergence in SQL, with guarded logarithms."""
    if p != 0 and p != 1:
        rest = f"POWER({mu}, {2.0 - p}) / {2.0 - p}" if p < 2 else "'inf'::DOUBLE"
        body = sql_beta_positive(x, mu, p)
        return f"CASE WHEN {x} = 0 AND {mu} = 0 THEN 0.0 WHEN {x} = 0 THEN {rest} ELSE {body} END"
    return sql_beta_positive(x, mu, p)


def sql_beta_positive(x: str, mu: str, p: float) -> str:
    if p == 0:
        return f"0.5 * POWER({x} - {mu}, 2)"
    if p == 1:
        return (f"CASE WHEN {x} = 0 THEN {mu} WHEN {mu} <= 0 THEN 'inf'::DOUBLE "
                f"ELSE {x} * LN({x} / {mu}) - {x} + {mu} END")
    if p == 2:
        return (f"CASE WHEN {x} <= 0 OR {mu} <= 0 THEN 'inf'::DOUBLE "
                f"ELSE {x} / {mu} - LN({x} / {mu}) - 1 END")
    a, b = 1.0 - p, 2.0 - p
    return (f"POWER({x}, {b}) / {a * b} - {x} * POWER({mu}, {a}) / {a} "
            f"+ POWER({mu}, {b}) / {b}")


class SqlModel:
    """The multiplicative-update model written as a chain of SQL CTEs.

    Written from the update equations on the full grid (no shortcut), so
    it checks the shortcuts taken by the Spark plan.
    """

    def __init__(self, b: SqlBuilder, factorizations, latents: dict[str, str],
                 cards: dict[str, str], missing: str = "zero") -> None:
        self.b = b
        self.fs = factorizations  # list of (observed cte, [latent names], p, phi)
        self.cur = dict(latents)  # latent name -> current cte
        self.cards = cards
        self.missing = missing

    def order(self) -> list[str]:
        out: list[str] = []
        for _, lat, _, _ in self.fs:
            out += [a for a in lat if a not in out]
        return out

    def xhat(self, x: str, lat: list[str], on: str) -> str:
        zs = [self.cur[a] for a in lat]
        if on == "support":
            return self.b.contract([self.b.support(x), *zs], self.b.indices[x], prefix="xs")
        return self.b.contract(zs, self.b.indices[x], prefix="xf")

    def update(self, a: str) -> str:
        b = self.b
        za = self.cur[a]
        idx = b.indices[za]
        parts = []
        for x, lat, p, phi in self.fs:
            if a not in lat:
                continue
            others = [self.cur[o] for o in lat if o != a]
            xs = self.xhat(x, lat, "support")
            # Where the model is 0, so is every product of the factors: the terms count as 0.
            q1 = b.join2(x, xs, lambda u, v: f"CASE WHEN {v} = 0 THEN 0.0 ELSE {u} * POWER({v}, {-p}) END", prefix="q1")
            if self.missing == "zero":
                base = b.grid(b.indices[x], self.cards) if p == 1 else self.xhat(x, lat, "full")
            else:
                base = xs
            q2 = b.map(base, lambda v: f"CASE WHEN {v} = 0 AND {p} > 1 THEN 0.0 ELSE POWER({v}, {1.0 - p}) END", prefix="q2")
            out = [i for i in idx if i in b.indices[x] or any(i in b.indices[o] for o in others)]
            assert out == idx, "the oracle handles factors whose indices are all covered"
            num = b.contract([q1, *others], out, scale=f"{1.0 / phi}", prefix="num")
            den = b.contract([q2, *others], out, scale=f"{1.0 / phi}", prefix="den")
            parts.append((num, den))
        nums = " UNION ALL ".join(f"SELECT {', '.join(idx)}, value, 0.0 AS d FROM {n}" for n, _ in parts)
        dens = " UNION ALL ".join(f"SELECT {', '.join(idx)}, 0.0, value FROM {d}" for _, d in parts)
        keys = ", ".join(idx)
        agg = b.add(b.fresh("nd"), idx,
                    f"SELECT {keys}, SUM(value) AS value, SUM(d) AS d FROM ({nums} UNION ALL {dens}) "
                    f"GROUP BY {keys}")
        on = " AND ".join(f"z.{i} = g.{i}" for i in idx)
        cols = ", ".join(f"z.{i}" for i in idx)
        new = b.add(b.fresh(f"upd_{a}"), idx,
                    f"SELECT {cols}, CASE WHEN g.d > 0 THEN z.value * COALESCE(g.value, 0) / g.d "
                    f"ELSE z.value END AS value FROM {za} z LEFT JOIN {agg} g ON {on}")
        self.cur[a] = new
        return new

    def epoch(self) -> None:
        for a in self.order():
            self.update(a)

    def divergence_rows(self, epoch: int) -> str:
        b = self.b
        rows = []
        for x, lat, p, _ in self.fs:
            idx = b.indices[x]
            if self.missing == "zero":
                mu = self.xhat(x, lat, "full")
                on = " AND ".join(f"a.{i} = b.{i}" for i in idx)
                cell = sql_beta("COALESCE(a.value, 0.0)", "COALESCE(b.value, 0.0)", p)
                src = f"{x} a FULL JOIN {mu} b ON {on}"
            else:
                mu = self.xhat(x, lat, "support")
                on = " AND ".join(f"a.{i} = b.{i}" for i in idx)
                cell = sql_beta("a.value", "b.value", p)
                src = f"{x} a JOIN {mu} b ON {on}"
            rows.append(f"SELECT CAST({epoch} AS INTEGER) AS epoch, '{x}' AS factorization, "
                        f"ROUND(SUM({cell}), 2) AS divergence FROM {src}")
        return " UNION ALL ".join(rows)


def sql_model_x1(b: SqlBuilder) -> dict[str, str]:
    x1 = b.tensor("X1")
    b.add("card_x1", [], "SELECT MAX(i) AS ci, MAX(j) AS cj FROM X1")
    z1 = b.add("Z1", ["i", "k"], sql_factor("Z1", "i", "k", "(SELECT ci FROM card_x1)", str(RANK)))
    z2 = b.add("Z2", ["k", "j"], sql_factor("Z2", "k", "j", str(RANK), "(SELECT cj FROM card_x1)"))
    return {"X1": x1, "Z1": z1, "Z2": z2,
            "card_i": "(SELECT ci FROM card_x1)", "card_j": "(SELECT cj FROM card_x1)"}


def sql_model_coupled(b: SqlBuilder) -> dict[str, str]:
    m = sql_model_x1(b)
    m["X2"] = b.tensor("X2")
    b.add("card_x2", [], "SELECT MAX(i) AS ci, MAX(r) AS cr FROM X2")
    m["Z3"] = b.add("Z3", ["k", "r"], sql_factor("Z3", "k", "r", str(RANK), "(SELECT cr FROM card_x2)"))
    m["card_r"] = "(SELECT cr FROM card_x2)"
    return m


def sql_absent_rows(step: int = 7) -> str:
    """D and its model by the factors, V without every ``step``-th key."""
    b = SqlBuilder()
    sql_model_sparse(b)
    b.add("V0", ["k", "p"], f"SELECT * FROM V WHERE p % {step} <> 0")
    hat = b.contract(["U", "V0"], ["i", "p"])
    b.add("M", ["i", "p"], f"SELECT COALESCE(D.i, h.i) AS i, COALESCE(D.p, h.p) AS p, D.value AS x, "
                           f"COALESCE(h.value, 0.0) AS mu FROM D FULL JOIN {hat} h ON D.i = h.i AND D.p = h.p")
    return b.render("")


def sql_model_sparse(b: SqlBuilder, rank: int = RANK) -> dict[str, str]:
    d = b.tensor("D")
    b.add("card_d", [], "SELECT MAX(i) AS ci, MAX(p) AS cp FROM D")
    u = b.add("U", ["i", "k"], sql_factor("U", "i", "k", "(SELECT ci FROM card_d)", str(rank)))
    v = b.add("V", ["k", "p"], sql_factor("V", "k", "p", str(rank), "(SELECT cp FROM card_d)"))
    return {"D": d, "U": u, "V": v,
            "card_i": "(SELECT ci FROM card_d)", "card_p": "(SELECT cp FROM card_d)"}
