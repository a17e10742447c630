"""Query registry, and the reading of the driver tables in the roles the operators expect.

A query is a function of :class:`Tables`; its oracle is SQL over the same tables.  Double columns named in ``dbl`` are
rounded on both sides (``name`` to 9 places, ``name:d`` to d), since sums of doubles depend on their order.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridpanel.plans.skew import dense_index
from gridpanel.session import deal_by_size


class Tables:
    """The driver tables of one scale factor, and derived roles."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    lineitem = property(lambda s: s.read("lineitem"))
    orders = property(lambda s: s.read("orders"))
    customer = property(lambda s: s.read("customer"))
    part = property(lambda s: s.read("part"))
    supplier = property(lambda s: s.read("supplier"))
    nation = property(lambda s: s.read("nation"))
    region = property(lambda s: s.read("region"))
    events = property(lambda s: s.read("events"))
    embeddings = property(lambda s: s.read("embeddings"))

    # ---- land cover --------------------------------------------------------------------------------------------

    @cached_property
    def cells(self) -> DataFrame:
        """One row per land-cover record: cell, code, class, area, year, supplier."""
        li = self.lineitem.select(
            F.col("l_orderkey").alias("cell"), F.col("l_partkey").alias("code"), F.col("l_suppkey").alias("supp"),
            F.col("l_quantity").alias("area"), F.year("l_shipdate").alias("year"), F.col("l_extendedprice").alias("price"),
            F.col("l_discount").alias("discount"),
        )
        mapping = self.part.select(F.col("p_partkey").alias("code"), F.col("p_type").alias("class"), F.col("p_brand").alias("brand"))
        return li.join(mapping, "code")

    @cached_property
    def lu(self) -> DataFrame:
        return self.cells.groupBy("cell", "class").agg(F.sum("area").alias("area"))

    @cached_property
    def geo(self) -> DataFrame:
        n = self.nation.join(self.region, F.col("n_regionkey") == F.col("r_regionkey"))
        s = self.supplier.join(n, F.col("s_nationkey") == F.col("n_nationkey"))
        return s.select(
            F.col("s_suppkey").alias("supp"), F.col("n_name").alias("grp"), F.col("r_name").alias("region"), F.col("s_acctbal").alias("acctbal")
        )

    @cached_property
    def panel(self) -> DataFrame:
        """Land cover by (grp, region, year, class)."""
        base = self.cells.groupBy("supp", "year", "class").agg(F.sum("area").alias("area"))
        return base.join(self.geo, "supp").groupBy("grp", "region", "year", "class").agg(F.sum("area").alias("area"))

    @cached_property
    def lattice(self) -> DataFrame:
        """Land cover on a lattice that grows with the tables: (slice, ix, iy, class, area)."""
        pos = self.cells.select(
            F.col("year").alias("slice"), F.floor(F.col("code") / 20).alias("ix"), (F.col("cell") % 40).alias("iy"), "class", "area"
        )
        return pos.groupBy("slice", "ix", "iy", "class").agg(F.sum("area").alias("area"))

    # ---- draws -------------------------------------------------------------------------------------------------

    @cached_property
    def draws(self) -> DataFrame:
        """Draw table: param (0..63), cov, class, grp, chain, iter (1..n per chain), value."""
        vec = dense_index(
            self.embeddings.select(F.col("label").alias("chain"), "vec_id", "embedding"), ["chain"], "vec_id", "iter"
        )
        long = vec.select("chain", "iter", F.posexplode("embedding").alias("param", "v"))
        p = F.col("param")
        return long.select(
            "param",
            F.concat(F.lit("x"), F.floor(p / 16).cast("string")).alias("cov"),
            F.concat(F.lit("c"), (F.floor(p / 4) % 4).cast("string")).alias("class"),
            F.concat(F.lit("g"), (p % 4).cast("string")).alias("grp"),
            "chain", "iter", F.col("v").cast("double").alias("value"),
        )

    @cached_property
    def pooled(self) -> DataFrame:
        """Pooled draws: mean over groups per (cov, class, chain, iter)."""
        return self.draws.groupBy("cov", "class", "chain", "iter").agg(F.avg("value").alias("value"))

    # ---- design rows -------------------------------------------------------------------------------------------

    @cached_property
    def design(self) -> DataFrame:
        """Design rows from orders: row, grp (g4 is not fitted), x0 = 1, x1..x3, year."""
        o = self.orders
        return o.select(
            F.col("o_orderkey").alias("row"),
            F.concat(F.lit("g"), (F.col("o_custkey") % 5).cast("string")).alias("grp"),
            F.lit(1.0).alias("x0"),
            (F.col("o_totalprice") / 1e5).alias("x1"),
            F.substring("o_orderpriority", 1, 1).cast("double").alias("x2"),
            (F.dayofmonth("o_orderdate") / F.lit(31.0)).alias("x3"),
            F.year("o_orderdate").alias("year"),
            F.col("o_custkey").alias("cust"),
        )

    @cached_property
    def fits(self) -> DataFrame:
        """Observed and predicted class shares per order (three classes, zeros included): row, grp, class, obs, pred."""
        classes = ("A", "N", "R")
        pick = lambda c: F.sum(F.when(F.col("l_returnflag") == c, F.col("l_quantity")))
        qty = self.lineitem.groupBy(F.col("l_orderkey").alias("row")).agg(F.sum("l_quantity").alias("qt"), *[F.coalesce(pick(c), F.lit(0.0)).alias(f"q_{c}") for c in classes])
        cust = self.customer.select(F.col("c_custkey").alias("cust"), F.col("c_nationkey").cast("string").alias("grp")).where(F.col("grp").isNotNull())
        # a row per order until the end: customers first, so that all that follows is dealt by order once
        wide = self.design.select("row", "x1", "x2", "cust").join(cust, "cust").join(qty, "row")
        base = wide.groupBy("grp").agg(*[F.sum(f"q_{c}").alias(f"g_{c}") for c in classes])
        tilt = {"A": 0.05 * F.col("x1"), "N": -0.02 * F.col("x2"), "R": F.lit(0.0)}
        scored = wide.join(base, "grp").withColumns({f"e_{c}": F.col(f"g_{c}") * F.exp(tilt[c]) for c in classes})
        parts = [F.sum(f"e_{c}").over(Window.partitionBy("row")) for c in classes]  # an order may come more than once
        scored = scored.withColumns({f"s_{c}": s for c, s in zip(classes, parts, strict=True)})
        total = sum((F.coalesce(F.col(f"s_{c}"), F.lit(0.0)) for c in classes), F.lit(0.0))
        cells = F.array(*[F.struct(F.lit(c).alias("class"), F.col(f"q_{c}").alias("q"), F.col(f"e_{c}").alias("e")) for c in classes])
        long = scored.withColumn("se", F.when(F.coalesce(*[F.col(f"s_{c}") for c in classes]).isNotNull(), total)).withColumn("_c", F.explode(cells))
        return long.select("row", "grp", "_c.class", (F.col("_c.q") / F.col("qt")).alias("obs"), (F.col("_c.e") / F.col("se")).alias("pred"), "qt", "x1", "x2")


CTES = {
    "cells": """SELECT l_orderkey AS cell, l_partkey AS code, l_suppkey AS supp, l_quantity AS area,
        CAST(year(l_shipdate) AS INTEGER) AS year, l_extendedprice AS price, l_discount AS discount, p_type AS class, p_brand AS brand
        FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "lu": "SELECT l_orderkey AS cell, p_type AS class, sum(l_quantity) AS area FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2",
    "geo": """SELECT s_suppkey AS supp, n_name AS grp, r_name AS region, s_acctbal AS acctbal FROM supplier
        JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "panel": "SELECT grp, region, year, class, sum(area) AS area FROM cells JOIN geo USING (supp) GROUP BY 1, 2, 3, 4",
    "lattice": """SELECT year AS slice, code // 20 AS ix, cell % 40 AS iy, class, sum(area) AS area FROM cells GROUP BY 1, 2, 3, 4""",
    "draws": """SELECT CAST(param AS INTEGER) AS param, 'x' || (param // 16) AS cov, 'c' || ((param // 4) % 4) AS class, 'g' || (param % 4) AS grp,
        chain, iter, value FROM (SELECT label AS chain, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS iter,
        unnest(range(64)) AS param, CAST(unnest(embedding) AS DOUBLE) AS value FROM embeddings)""",
    "pooled": "SELECT cov, class, chain, iter, avg(value) AS value FROM draws GROUP BY 1, 2, 3, 4",
    "design": """SELECT o_orderkey AS "row", 'g' || (o_custkey % 5) AS grp, 1.0::DOUBLE AS x0, o_totalprice / 1e5 AS x1,
        CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) AS x2, day(o_orderdate) / 31.0::DOUBLE AS x3,
        CAST(year(o_orderdate) AS INTEGER) AS year, o_custkey AS cust FROM orders""",
    "qty": 'SELECT l_orderkey AS "row", l_returnflag AS class, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2',
    "rowtot": """SELECT d."row", CAST(c_nationkey AS VARCHAR) AS grp, x1, x2, qt FROM (SELECT "row", sum(q) AS qt FROM qty GROUP BY 1) t
        JOIN design d USING ("row") JOIN customer ON c_custkey = cust""",
    "fitgrid": """SELECT r."row", grp, x1, x2, qt, k.class, coalesce(q, 0.0) AS q FROM rowtot r CROSS JOIN (VALUES ('A'), ('N'), ('R')) k(class)
        LEFT JOIN qty ON qty."row" = r."row" AND qty.class = k.class""",
    "fitexp": """SELECT *, gq * exp(CASE class WHEN 'A' THEN 0.05 * x1 WHEN 'N' THEN -0.02 * x2 ELSE 0.0 END) AS e FROM fitgrid
        JOIN (SELECT grp, class, sum(q) AS gq FROM fitgrid GROUP BY 1, 2) USING (grp, class)""",
    "fits": """SELECT "row", grp, class, q / qt AS obs, e / sum(e) OVER (PARTITION BY "row") AS pred, qt, x1, x2 FROM fitexp""",
}
NEEDS = {
    "panel": ["cells", "geo"], "lattice": ["cells"], "pooled": ["draws"], "rowtot": ["qty", "design"], "fitgrid": ["rowtot", "qty"],
    "fitexp": ["fitgrid"], "fits": ["fitexp"],
}


def sql_with(names: str, body: str) -> str:
    """Prefix ``body`` with the role CTEs it uses, in dependency order."""
    order: list[str] = []

    def add(name: str) -> None:
        for dep in NEEDS.get(name, []):
            add(dep)
        if name not in order:
            order.append(name)

    for name in names.split():
        add(name)
    ctes = ", ".join(f"{n} AS ({CTES[n]})" for n in order)
    if not ctes:
        return body
    body = body.strip()
    return f"WITH {ctes}, {body[5:]}" if body[:5].upper() == "WITH " else f"WITH {ctes} {body}"


def _digits(spec: str) -> dict[str, int]:
    out = {}
    for item in spec.split():
        name, _, d = item.partition(":")
        out[name] = int(d or 9)
    return out


def nudge(digits: int) -> float:
    """Shift far below the rounding step: exact ties (5 in the next place) would else fall either way."""
    return 3.7 * 10.0 ** -(digits + 3)


@dataclass(frozen=True)
class Query:
    fn: Callable[[Tables], DataFrame]
    sql: str | None
    dbl: dict[str, int]

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        deal_by_size(spark, sf_dir)
        df = self.fn(Tables(spark, sf_dir))
        return df.withColumns({c: F.round(F.col(c) + nudge(d), d) for c, d in self.dbl.items()}) if self.dbl else df

    def oracle(self) -> str | None:
        if self.sql is None or not self.dbl:
            return self.sql
        cols = ", ".join(f'round("{c}" + {nudge(d)!r}, {d}) + 0.0 AS "{c}"' for c, d in self.dbl.items())
        return f"SELECT * REPLACE ({cols}) FROM ({self.sql})"


REGISTRY: dict[str, Query] = {}


def query(name: str, roles: str = "", sql: str | None = None, dbl: str = ""):
    """Register a query with its oracle (``roles`` names the CTEs the SQL uses)."""
    def wrap(fn):
        if name in REGISTRY:
            raise ValueError(f"query {name} registered twice")
        REGISTRY[name] = Query(fn, sql_with(roles, sql) if sql else None, _digits(dbl))
        return fn

    return wrap
