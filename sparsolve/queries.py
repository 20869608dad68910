"""A query for each part of the engine, with the SQL that gives the same rows.

Solves have a solution that is known beforehand, so the SQL is its formula; `ok` says that the solution is within 1e-6 of it.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import graph
from .operators import linalg as la
from .plans.session import PC, SolverSession, Tier, gather, scatter, solve_many
from .plans.space import FrameSpace, LocalSpace
from .precond import amg
from .precond.simple import AdditiveSchwarz, ApproximateInverse, BlockJacobi, Chebyshev, Sor, Sweeps, ilu0_reference, ilut_reference
from .solvers import krylov
from .solvers.direct import DirectLU, DirectQR, solve_batch
from .solvers.options import NormType, Orthogonalization
from .sources import ingest, systems
from .types import Convergence, Matrix, SolveResult, SparsolveError, Vector

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _tables(text: str) -> str:
    return text.replace("{", "").replace("}", "")


TRADE, PARTS, MOVES = map(_tables, (systems.TRADE, systems.PARTS, systems.MOVES))


def checked(x: Vector, n: int | None = None) -> DataFrame:
    """(i, x, ok): the solution, rounded, and whether it is near i % 7 + 1."""
    return x.dense().select("i", F.round("v").cast("long").alias("x"), (F.abs(F.col("v") - (F.col("i") % 7 + 1)) < 1e-6).alias("ok"))


def known(table: str, key: str) -> str:
    return f"select cast({key} as bigint) i, cast({key} % 7 + 1 as bigint) x, true ok from {table}"


CUSTOMERS, NATIONS, SUPPLIERS = known("customer", "c_custkey"), known("nation", "n_nationkey"), known("supplier", "s_suppkey")


def solved(a: Matrix, kind: str, pc=None, tier: Tier | str = Tier.FRAME, **options) -> DataFrame:
    own = {k: options.pop(k) for k in ("restart", "max_iters", "tol", "absolute") if k in options}
    got = SolverSession(kind, pc, tier=tier, options=options, **own).solve(a, systems.right_side(a))
    return checked(got.x)


# --- ingest and primitives


@query("select cast(i as bigint) i, cast(j as bigint) j, v from (select unnest(range(6)) p) t, lateral (select p % 3 i, p // 3 j, cast(p + 1 as double) v) u")
def dense_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.from_dense(spark, 3, 2, [1, 2, 3, 4, 5, 6]).df


@query("select cast(i as bigint) i, cast(j as bigint) j, v from (values (0, 0, 1.0::double), (0, 1, 2.0), (1, 1, 3.0), (1, 2, 4.0)) t(i, j, v)")
def csr_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.from_csr(spark, 2, 3, [0, 2, 4], [0, 1, 1, 2], [1, 2, 3, 4]).df


@query(f"select i, cast(count(*) as bigint) n, cast(min(j) as bigint) first_col, cast(sum(j * v) as bigint) weighted from ({PARTS}) group by i")
def csr_row_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = la.csr_rows(systems.parts_by_suppliers(spark, sf_dir))
    weighted = F.aggregate(F.zip_with("cols", "vals", lambda j, v: j * v), F.lit(0.0), lambda a, b: a + b)
    return rows.select("i", F.size("cols").cast("long").alias("n"), F.col("cols")[0].alias("first_col"), weighted.cast("long").alias("weighted"))


@query(f"select p_partkey i, cast(coalesce(sum(v * (j % 7 + 1)), 0) as bigint) y from part left join ({PARTS}) on i = p_partkey group by p_partkey")
def matvec(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = systems.parts_by_suppliers(spark, sf_dir)
    return la.matvec(a, systems.truth(spark, a.ncols)).df.select("i", F.col("v").cast("long").alias("y"))


@query(f"select s_suppkey i, cast(coalesce(sum(v * (i % 7 + 1)), 0) as bigint) y from supplier left join ({PARTS}) on j = s_suppkey group by s_suppkey")
def matvec_t(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = systems.parts_by_suppliers(spark, sf_dir)
    return la.matvec_t(a, systems.truth(spark, a.nrows)).df.select("i", F.col("v").cast("long").alias("y"))


@query(f"select p_partkey i, cast(p_partkey - coalesce(sum(v), 0) as bigint) r from part left join ({PARTS}) on i = p_partkey group by p_partkey")
def residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = systems.parts_by_suppliers(spark, sf_dir)
    ones, b = Vector(spark.range(a.ncols).selectExpr("id i", "1D v"), a.ncols), Vector(spark.range(a.nrows).selectExpr("id i", "cast(id as double) v"), a.nrows)
    return la.residual(a, ones, b).df.select("i", F.col("v").cast("long").alias("r"))


@query("select cast(sum(c_custkey * (c_custkey % 7 + 1)) as bigint) xy, cast(sum((c_custkey % 7 + 1) * (c_custkey % 7 + 1)) as bigint) yy from customer")
def dot_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = systems.customers(spark, sf_dir)
    x, y = Vector(spark.range(n).selectExpr("id i", "cast(id as double) v"), n), systems.truth(spark, n)
    return spark.createDataFrame([(int(la.dot(x, y)), round(la.norm(y) ** 2))], "xy long, yy long")


@query("select c_custkey i, cast(c_custkey + 3 * (c_custkey % 7 + 1) as bigint) v from customer")
def axpy(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = systems.customers(spark, sf_dir)
    x = Vector(spark.range(n).selectExpr("id i", "cast(id as double) v"), n)
    return la.axpy(3.0, systems.truth(spark, n), x).df.select("i", F.col("v").cast("long").alias("v"))


@query(f"select cast(i // 2 as bigint) i, cast(j // 2 as bigint) j, cast(v as bigint) v from ({TRADE}) where i % 2 = 0 and j % 2 = 0 and v <> 0")
def submatrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = spark.range(0, 25, 2).selectExpr("id i", "id div 2 pos")
    return la.submatrix(systems.trade(spark, sf_dir), index, 13).df.select("i", "j", F.col("v").cast("long").alias("v"))


@query(f"select cast(i as bigint) i, cast(v as bigint) v from ({TRADE}) where i = j")
def diagonal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return la.diagonal(systems.trade(spark, sf_dir)).df.select("i", F.col("v").cast("long").alias("v"))


@query(f"select j i, i j, cast(v as bigint) v from ({PARTS})")
def transpose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return la.transpose(systems.parts_by_suppliers(spark, sf_dir)).df.select("i", "j", F.col("v").cast("long").alias("v"))


@query(f"select cast(a.i as bigint) i, cast(b.j as bigint) j, cast(sum(a.v * b.v) as bigint) v from ({TRADE}) a join ({TRADE}) b on a.j = b.i group by 1, 2")
def matmul(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = systems.trade(spark, sf_dir)
    return la.matmul(a, a).df.select("i", "j", F.col("v").cast("long").alias("v"))


@query(f"select a.j i, b.j, cast(sum(a.v * b.v) as bigint) v from ({PARTS}) a join ({PARTS}) b on a.i = b.i group by 1, 2")
def gram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return la.gram(systems.parts_by_suppliers(spark, sf_dir)).df.select("i", "j", F.col("v").cast("long").alias("v"))


@query(f"select cast(coalesce(sum(v), 0) as bigint) v from ({TRADE}) where i = 3 and j = 4")
def element_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(int(la.element(systems.trade(spark, sf_dir), 3, 4)),)], "v long")


@query(f"select cast(max(i) + 1 as bigint) nrows, cast(max(j) + 1 as bigint) ncols from ({PARTS})")
def shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([la.shape(systems.parts_by_suppliers(spark, sf_dir).df)], "nrows long, ncols long")


@query("select n_nationkey::bigint i, n_nationkey::bigint j, 1.0::double v from nation")
def identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.identity(spark, systems.table(spark, sf_dir, "nation").count()).df


@query(f"select cast(i as bigint) i, cast(count(*) as bigint) n, cast(min(j) as bigint) lo, cast(max(j) as bigint) hi from ({TRADE}) group by i")
def row_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    return la.row_pattern(systems.trade(spark, sf_dir)).select("i", F.size("cols").cast("long").alias("n"), F.array_min("cols").alias("lo"), F.array_max("cols").alias("hi"))


@query(f"select cast(i as bigint) i, cast(j as bigint) j, cast(v as bigint) v from ({MOVES})")
def event_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return systems.moves(spark, sf_dir).df.select("i", "j", F.col("v").cast("long").alias("v"))


@query("select c_custkey i, cast(c_custkey % 7 + 1 as bigint) v from customer")
def scatter_gather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dealt out by ranges and brought back in order."""
    n = systems.customers(spark, sf_dir)
    dealt = Vector(scatter(systems.truth(spark, n).df, 4), n)
    return spark.createDataFrame([(k, int(v)) for k, v in enumerate(gather(dealt))], "i long, v long")


@query("select cast(sum(c_custkey % 7 + 1) as bigint) total from customer")
def all_reduce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sum over all workers: partial sums, then one."""
    n = systems.customers(spark, sf_dir)
    return scatter(systems.truth(spark, n).df, 4).agg(F.sum("v").cast("long").alias("total"))


# --- Krylov methods


@query(CUSTOMERS)
def cg_matrix_free(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The operator is a function of DataFrames: 4 x_i less both neighbours, by a union and a sum."""
    a = systems.chain(spark, sf_dir)
    s = FrameSpace(spark, a.nrows)
    s.add_operator("A", lambda x: x.selectExpr("inline(array(struct(i, 4 * v v), struct(i - 1 i, -v v), struct(i + 1 i, -v v)))").groupBy("i").agg(F.sum("v").alias("v")))
    s.load(b=systems.right_side(a), x=Vector(spark.range(0).selectExpr("id i", "0D v"), a.nrows))
    krylov.cg(s, Convergence(1e-10, 100))
    s.cut()
    return checked(s.vector("x"))


@query(CUSTOMERS)
def cg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return solved(systems.chain(spark, sf_dir), "cg")


@query(CUSTOMERS)
def cg_single_reduction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return solved(systems.chain(spark, sf_dir), "cg", single_reduction=True)


@query("select true on_edge, false converged")
def cg_trust_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = systems.trade(spark, sf_dir)
    got = SolverSession("cg", tier="broadcast", options={"radius": 5.0}).solve(a, systems.right_side(a))
    return got.x.df.agg((F.abs(F.sqrt(F.sum(F.col("v") ** 2)) - 5) < 1e-9).alias("on_edge")).withColumn("converged", F.lit(got.stats.converged))


@query("select true low_enough, true early")
def cg_objective(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = systems.chain(spark, sf_dir)
    b = systems.right_side(a)
    x = systems.truth(spark, a.nrows)
    target = -0.45 * la.dot(x, b)  # the least is -x'b / 2
    got = SolverSession("cg", tier="broadcast", options={"objective": target}).solve(a, b)
    reached = 0.5 * la.dot(got.x, la.matvec(a, got.x)) - la.dot(got.x, b)
    return spark.createDataFrame([(reached <= target, got.stats.iterations < 15)], "low_enough boolean, early boolean")


@query(CUSTOMERS)
def pcg_jacobi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return solved(systems.chain(spark, sf_dir), "pcg", PC.make("jacobi"))


@query("select * from (values ('natural', true), ('preconditioned', true), ('unpreconditioned', true)) t(norm, ok)")
def pcg_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, out = systems.trade(spark, sf_dir), []
    for norm in (NormType.NATURAL, NormType.PRECONDITIONED, NormType.UNPRECONDITIONED):
        got = SolverSession("pcg", PC.make("jacobi"), tol=1e-12, tier="local", options={"norm": norm}).solve(a, systems.right_side(a))
        out.append(checked(got.x).agg(F.min("ok").alias("ok")).select(F.lit(norm.value).alias("norm"), "ok"))
    return out[0].union(out[1]).union(out[2])


@query(CUSTOMERS)
def gmres_none(spark: SparkSession, sf_dir: str) -> DataFrame:
    return solved(systems.chain(spark, sf_dir, "nonsymmetric"), "gmres", restart=20)


@query(CUSTOMERS)
def gmres_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    return solved(systems.chain(spark, sf_dir, "nonsymmetric"), "gmres_left", PC.make("jacobi"), Tier.BROADCAST)


@query(CUSTOMERS)
def gmres_right(spark: SparkSession, sf_dir: str) -> DataFrame:
    return solved(systems.chain(spark, sf_dir, "nonsymmetric"), "gmres_right", PC.make("jacobi"), Tier.BROADCAST)


@query(CUSTOMERS)
def fgmres(spark: SparkSession, sf_dir: str) -> DataFrame:
    return solved(systems.chain(spark, sf_dir, "nonsymmetric"), "fgmres", PC.make("chebyshev", steps=2, low=0.5, high=3.5), Tier.BROADCAST)


@query(CUSTOMERS)
def pca_gmres(spark: SparkSession, sf_dir: str) -> DataFrame:
    return solved(systems.chain(spark, sf_dir), "pca_gmres", tier=Tier.BROADCAST, block=8)


@query(CUSTOMERS)
def bicgstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return solved(systems.chain(spark, sf_dir, "nonsymmetric"), "bicgstab")


@query(CUSTOMERS)
def cgs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return solved(systems.chain(spark, sf_dir, "nonsymmetric"), "cgs", tier=Tier.BROADCAST)


@query(CUSTOMERS)
def qmr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return solved(systems.chain(spark, sf_dir, "nonsymmetric"), "qmr", tier=Tier.BROADCAST)


@query(CUSTOMERS)
def tfqmr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return solved(systems.chain(spark, sf_dir, "nonsymmetric"), "tfqmr", tier=Tier.BROADCAST)


@query(CUSTOMERS)
def minres(spark: SparkSession, sf_dir: str) -> DataFrame:
    return solved(systems.chain(spark, sf_dir, "indefinite"), "minres")


@query(SUPPLIERS)
def cgnr_lsq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return solved(systems.parts_by_suppliers(spark, sf_dir), "cgnr", tier=Tier.BROADCAST, tol=1e-12)


@query(f"with w as (select p_partkey i, sum(v * (j % 3 + 1)) x from part join ({PARTS}) on i = p_partkey group by 1) select i, cast(x as bigint) x, true ok from w")
def cgne_minnorm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The solution of least norm of A' x = b is A w for the w that is known."""
    a = systems.parts_by_suppliers(spark, sf_dir)
    w = Vector(spark.range(a.ncols).selectExpr("id i", "cast(id % 3 + 1 as double) v"), a.ncols)
    x = la.matvec(a, w)
    got = SolverSession("cgne", tol=1e-13, tier="broadcast").solve(la.transpose(a), la.matvec_t(a, x))
    both = got.x.df.join(x.df.select("i", F.col("v").alias("t")), "i").join(a.df.select("i").distinct(), "i")
    return both.select("i", F.round("v").cast("long").alias("x"), (F.abs(F.col("v") - F.col("t")) < 1e-3).alias("ok"))


@query("select * from (values (0, true), (1, true), (2, true)) t(i, ok)")
def page_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three right sides of a nonsymmetric system from event moves, checked by their residuals."""
    a, out = systems.page_rank_like(spark, sf_dir), []
    for k in range(3):
        b = Vector(spark.range(a.nrows).selectExpr("id i", f"cast(id + {k} as double) v"), a.nrows)
        got = SolverSession("bicgstab", tier="local", tol=1e-11).solve(a, b)
        out.append((k, la.norm(la.residual(a, got.x, b)) < 1e-9))
    return spark.createDataFrame(out, "i int, ok boolean")


# --- direct solvers


@query("select c_nationkey::bigint system_id, i, case when i = 0 then c_nationkey % 5 + 1 else 2 end::bigint x, true ok from (select distinct c_nationkey from customer), (values (0::bigint), (1::bigint)) t(i)")
def lu_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = solve_batch(*systems.nation_batch(spark, sf_dir))
    return got.select("system_id", "i", F.round("x").cast("long").alias("x"), (F.abs(F.col("x") - F.round("x")) < 1e-6).alias("ok"))


@query(ORACLES["lu_batch"])
def krylov_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = solve_many(*systems.nation_batch(spark, sf_dir), kind="gmres_right", pc=PC.make("ilu0"))
    return got.select("system_id", "i", F.round("x").cast("long").alias("x"), (F.abs(F.col("x") - F.round("x")) < 1e-6).alias("ok"))


@query(f"select i, x * k x, ok, k::integer k from ({NATIONS}) t, (values (1), (2)) u(k)")
def lu_cached(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, lu = systems.trade(spark, sf_dir), DirectLU()
    b = systems.right_side(a)
    first = checked(lu.solve(a, b).x).withColumn("k", F.lit(1))
    twice = lu.solve_cached(Vector(b.df.selectExpr("i", "2 * v v"), b.n)).x
    second = twice.df.selectExpr("i", "cast(round(v) as bigint) x", "abs(v - 2 * (i % 7 + 1)) < 1e-6 ok").withColumn("k", F.lit(2))
    return first.unionByName(second)


@query("select i::bigint i, i % 7 + 1 x, true ok from range(200) t(i)")
def lu_dense_200(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense, n = 200: sin(200 j + i), which alone has rank 2, with 200 added on the diagonal."""
    cells = spark.range(200 * 200).selectExpr("id % 200 i", "id div 200 j", "sin(cast(id div 200 * 200 + id % 200 as double)) + if(id % 200 = id div 200, 200, 0) v")
    a = Matrix(cells, 200, 200)
    return checked(DirectLU().solve(a, systems.right_side(a)).x)


@query(SUPPLIERS)
def qr_lsq(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = systems.parts_by_suppliers(spark, sf_dir)
    return checked(DirectQR().tall(a, systems.right_side(a)).x)


@query("select round(regr_intercept(o_totalprice, k), 4) intercept, round(regr_slope(o_totalprice, k), 6) slope from (select o_totalprice, o_custkey % 10 k from orders)")
def qr_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = systems.table(spark, sf_dir, "orders").selectExpr("o_orderkey i", "o_custkey % 10 k", "o_totalprice y")
    n = o.agg(F.max("i")).first()[0] + 1
    a = Matrix(o.selectExpr("i", "inline(array(struct(0L j, 1D v), struct(1L j, cast(k as double) v)))"), n, 2)
    x = {r["i"]: r["v"] for r in DirectQR().tall(a, Vector(o.selectExpr("i", "y v"), n)).x.df.collect()}
    return spark.createDataFrame([(x[0], x[1])], "intercept double, slope double").select(F.round("intercept", 4).alias("intercept"), F.round("slope", 6).alias("slope"))


# --- preconditioners


@query(f"select cast(i as bigint) i, cast(1e9 / v as bigint) z from ({TRADE}) where i = j")
def pc_jacobi(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = systems.trade(spark, sf_dir)
    return PC.make("jacobi").setup(a).inverse.df.selectExpr("i", "cast(round(1e9D * v) as bigint) z")


@query(f"select cast(i as bigint) i, cast(j as bigint) j, cast(v as bigint) v from (select *, row_number() over (partition by i order by abs(v) desc, j) k from ({TRADE}) where abs(v) >= 20) where k <= 4")
def pc_ilut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ilut_reference(systems.trade(spark, sf_dir), 4, 20.0).select("i", "j", F.col("v").cast("long").alias("v"))


@query(f"with a as ({TRADE}) select case when a.j < a.i then 'L' else 'U' end part, cast(a.i as bigint) i, cast(a.j as bigint) j, cast(round(1e6 * case when a.j < a.i then a.v::double / d.v else a.v end) as bigint) v from a join a d on d.i = a.j and d.j = a.j")
def pc_ilu0_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ilu0_reference(systems.trade(spark, sf_dir)).selectExpr("part", "i", "j", "cast(round(1e6D * v) as bigint) v")


def _local(a: Matrix, pc, r: Vector) -> DataFrame:
    s = LocalSpace(a.nrows)
    s.add_matrix("A", a)
    s.load(r=r)
    pc.setup(a).apply(s, "r", "z")
    return Vector.local(a.spark, s.v["z"]).df


@query("""
    with recursive y(i, v) as (
        select 0::bigint, (1.0::double + 1.0) / 4
        union all
        select i + 1, (1.0 + v + case when i + 1 < n - 1 then 1.0 else 0.0 end) / 4 from y, (select count(*) n from customer) where i + 1 < n
    ) select i, cast(round(1e6 * v) as bigint) z from y""")
def pc_sor_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = systems.chain(spark, sf_dir)
    ones = Vector(spark.range(a.nrows).selectExpr("id i", "1D v"), a.nrows)
    return _local(a, Sor(kind=Sweeps.FORWARD, mode="reference"), ones).selectExpr("i", "cast(round(1e6D * v) as bigint) z")


@query("select c_custkey i, cast(round(1e6 * case when c_custkey = n - 1 and n % 2 = 1 then 1.0 / 4 else 1.0 / 3 end) as bigint) z from customer, (select count(*) n from customer)")
def pc_block_jacobi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2 x 2 blocks of (4, -1; -1, 4), of a vector of ones: a third each."""
    a = systems.chain(spark, sf_dir)
    ones = Vector(spark.range(a.nrows).selectExpr("id i", "1D v"), a.nrows)
    return la.matvec(BlockJacobi(size=2).setup(a).inverse, ones).df.selectExpr("i", "cast(round(1e6D * v) as bigint) z")


@query("""
    with b as (select c_custkey block, c_custkey i from customer union all select c_custkey, c_custkey + 1 from customer where c_custkey + 1 < (select count(*) from customer)),
    s as (select block, count(*) n from b group by block)
    select i, cast(round(1e6 * sum(case when n = 2 then 1.0 / 3 else 1.0 / 4 end)) as bigint) z from b join s using (block) group by i""")
def pc_asm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping pairs {i, i + 1}, whose contributions add up."""
    a = systems.chain(spark, sf_dir)
    own = spark.range(a.nrows).selectExpr("id block", "inline(array(struct(id i), struct(id + 1 i)))").where(f"i < {a.nrows}")
    ones = Vector(spark.range(a.nrows).selectExpr("id i", "1D v"), a.nrows)
    return la.matvec(AdditiveSchwarz(own).setup(a).inverse, ones).df.selectExpr("i", "cast(round(1e6D * v) as bigint) z")


@query(f"select cast(j as bigint) j, cast(round(1e9 * sum(case when i = j then v end)::double / sum(v::double * v)) as bigint) m from ({TRADE}) group by j")
def pc_spai_diag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a diagonal pattern: a_jj over the sum of squares of column j."""
    a = systems.trade(spark, sf_dir)
    pattern = spark.range(a.nrows).selectExpr("id i", "id j")
    return ApproximateInverse(pattern).setup(a).inverse.df.selectExpr("j", "cast(round(1e9D * v) as bigint) m")


@query("""
    with n as (select count(*) n from customer), v0 as (select c_custkey i, 1.0::double v from customer),
    v1 as (select i, (4 * v - case when i > 0 then 1 else 0 end - case when i < n - 1 then 1 else 0 end - 4 * v) / 2 v from v0, n),
    v2 as (select a.i, 2 * (4 * a.v - coalesce(b.v, 0) - coalesce(c.v, 0) - 4 * a.v) / 2 - 1 v from v1 a left join v1 b on b.i = a.i - 1 left join v1 c on c.i = a.i + 1)
    select i, cast(round(1e6 * v / 7) as bigint) z from v2""")
def pc_chebyshev(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two steps of the residual polynomial on [2, 6]: T_2((A - 4) / 2) r / T_2(-2)."""
    a = systems.chain(spark, sf_dir)
    s = FrameSpace(spark, a.nrows)
    s.add_matrix("A", a)
    s.load(r=Vector(spark.range(a.nrows).selectExpr("id i", "1D v"), a.nrows))
    Chebyshev(2, 2.0, 6.0, "reference").apply(s, "r", "z")
    return s.vector("z").df.selectExpr("i", "cast(round(1e6D * v) as bigint) z")


def _with_pc(kind: str, pc: str, system: str = "spd", tier: str = "broadcast", **options) -> Query:
    return lambda spark, sf_dir: solved(systems.chain(spark, sf_dir, system), kind, PC.make(pc, **options), tier)


for _name, _f in {
    "pcg_block_jacobi": _with_pc("pcg", "block_jacobi", size=8), "pcg_sor": _with_pc("pcg", "sor", omega=1.2), "gmres_ilu0": _with_pc("gmres_right", "ilu0", "nonsymmetric"),
    "gmres_ilup": _with_pc("gmres_left", "ilup", "nonsymmetric", fill=1), "gmres_ilut": _with_pc("gmres_right", "ilut", "nonsymmetric", fill=4, drop=1e-4), "pcg_chebyshev": _with_pc("pcg", "chebyshev", steps=3, low=2.0, high=6.0),
    "pcg_asm": _with_pc("pcg", "asm", size=16, overlap=1), "gmres_spai": _with_pc("gmres_right", "spai", "nonsymmetric"), "pcg_multicolor": _with_pc("pcg", "multicolor"),
    "pcg_sor_frame": _with_pc("pcg", "blockwise", tier="frame", inner=PC.make("sor", omega=1.2)), "gmres_ilu0_frame": _with_pc("gmres_right", "blockwise", "nonsymmetric", "frame", inner=PC.make("ilu0")),
    "gmres_ilup_frame": _with_pc("gmres_right", "blockwise", "nonsymmetric", "frame", inner=PC.make("ilup", fill=1)), "gmres_ilut_frame": _with_pc("gmres_right", "blockwise", "nonsymmetric", "frame", inner=PC.make("ilut", fill=4, drop=1e-4)),
}.items():
    QUERIES[_name], ORACLES[_name] = _f, CUSTOMERS


# --- multigrid


@query(f"with a as ({TRADE}) select cast(i as bigint) i, cast(round(1e9 * max(case when i <> j then abs(v) end)::double / max(case when i = j then abs(v) end)) as bigint) v from a group by i")
def amg_anisotropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return amg.anisotropy(systems.trade(spark, sf_dir)).selectExpr("i", "cast(round(1e9D * v) as bigint) v")


@query(f"with a as ({TRADE}), r as (select i, max(case when i <> j then abs(v) end)::double / max(case when i = j then abs(v) end) v from a group by i) select cast(round(1e9 * 0.1 * (1 + greatest(avg(v), 0.5))) as bigint) t from r")
def amg_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(round(1e9 * amg.adaptive_threshold(systems.trade(spark, sf_dir), 0.1)),)], "t long")


@query(f"with a as ({TRADE}), d as (select i, abs(v) d from a where i = j) select cast(a.i as bigint) i, cast(a.j as bigint) j, cast(round(1e9 * abs(v) / sqrt(x.d * y.d)) as bigint) v from a join d x on x.i = a.i join d y on y.i = a.j where a.i <> a.j and abs(v) / sqrt(x.d * y.d) > 0.05")
def amg_strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    return amg.strength(systems.trade(spark, sf_dir), 0.05).df.selectExpr("i", "j", "cast(round(1e9D * v) as bigint) v")


@query("select c_custkey i, c_custkey // 2 agg from customer")
def amg_pairwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On a chain, the first of equal neighbours that is free is the next one."""
    return amg.pairwise(amg.strength(systems.chain(spark, sf_dir), 0.1))


@query("select c_custkey i, c_custkey // 4 agg from customer")
def amg_double_pairwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return amg.double_pairwise(amg.strength(systems.chain(spark, sf_dir), 0.1))[0]


@query("with recursive g(i) as (select 0::bigint union all select i + 1 from g where i + 1 < (select count(*) from customer)) select i, i // 2 agg from g")
def amg_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return amg.greedy(amg.strength(systems.chain(spark, sf_dir), 0.1))


@query("with e as (select c_custkey i, c_custkey + 1 j from customer where c_custkey + 1 < (select count(*) from customer) union all select c_custkey + 1, c_custkey from customer where c_custkey + 1 < (select count(*) from customer)) select i // 2 i, j // 2 j, cast(round(1e6 * sum(0.25)) as bigint) v from e where i // 2 <> j // 2 group by 1, 2")
def amg_coarse_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = systems.customers(spark, sf_dir)
    agg = spark.range(n).selectExpr("id i", "id div 2 agg")
    return amg.coarse_graph(amg.strength(systems.chain(spark, sf_dir), 0.1), agg, (n + 1) // 2).df.selectExpr("i", "j", "cast(round(1e6D * v) as bigint) v")


_FOURS = "select n_nationkey i, n_nationkey // 4 j, 1 v from nation"


@query(f"select i::bigint i, j::bigint j, v::double v from ({_FOURS})")
def amg_prolongation(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = systems.table(spark, sf_dir, "nation").count()
    return amg.prolongation(spark.range(n).selectExpr("id i", "id div 4 agg"), n, (n + 3) // 4).df


@query(f"with p as ({_FOURS}), a as (select * from ({TRADE}) where j < 7) select cast(coalesce(p.i, a.i) as bigint) i, cast(coalesce(p.j, a.j) as bigint) j, cast(round(2 * (coalesce(p.v, 0) - 0.5 * coalesce(a.v, 0))) as bigint) v2 from p full join a on p.i = a.i and p.j = a.j")
def amg_prolong_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reference's form: entry by entry."""
    p = Matrix(amg_prolongation(spark, sf_dir), 25, 7)
    return amg.smooth_interpolation(p, systems.trade(spark, sf_dir), 0.5, "reference").df.selectExpr("i", "j", "cast(round(2 * v) as bigint) v2")


@query(f"with a as ({TRADE}), s as (select i, sqrt(sum(v::double * v)) s from a group by i) select cast(a.i as bigint) i, cast(a.j as bigint) j, cast(round(1e9 * v / s) as bigint) v from a join s on s.i = a.i")
def amg_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return amg.minimize_energy(systems.trade(spark, sf_dir)).df.selectExpr("i", "j", "cast(round(1e9D * v) as bigint) v")


@query(f"select cast(i // 4 as bigint) i, cast(j // 4 as bigint) j, cast(sum(v) as bigint) v from ({TRADE}) group by 1, 2")
def amg_galerkin(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Matrix(amg_prolongation(spark, sf_dir), 25, 7)
    return amg.galerkin(la.transpose(p), systems.trade(spark, sf_dir), p).df.select("i", "j", F.col("v").cast("long").alias("v"))


@query("select c_custkey i, c_custkey z from customer where false")
def amg_smoother_fixed_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sweeping from the solution changes nothing: the rows that moved, none."""
    a = systems.chain(spark, sf_dir)
    s = FrameSpace(spark, a.nrows)
    s.add_matrix("A", a)
    s.add_matrix("D", Matrix(a.df.where("i = j").selectExpr("i", "j", "1D / v v"), a.nrows, a.nrows))
    s.load(z=systems.truth(spark, a.nrows), r=systems.right_side(a))
    amg.smoother(s, "", "r", "z", 2 / 3)
    return s.vector("z").df.where("abs(v - (i % 7 + 1)) > 1e-9").selectExpr("i", "cast(round(1e6D * v) as bigint) z")


@query(CUSTOMERS)
def amg_pcg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return solved(systems.chain(spark, sf_dir, "laplace"), "pcg", PC.make("amg"), Tier.LOCAL, tol=1e-12)


# --- graphs


_CHAIN = "with recursive n as (select count(*) n from customer), e as (select c_custkey src, c_custkey + 1 dst from customer, n where c_custkey + 1 < n union all select c_custkey + 1, c_custkey from customer, n where c_custkey + 1 < n)"


@query(f"with m as ({MOVES}) select distinct i::bigint src, j::bigint dst from (select i, j from m union all select j, i from m) where i <> j")
def adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.adjacency(systems.moves(spark, sf_dir))


@query(f"{_CHAIN} select src, dst from e union select a.src, b.dst from e a join e b on a.dst = b.src union select c_custkey, c_custkey from customer")
def distance2(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = systems.chain(spark, sf_dir)
    return graph.distance2(graph.adjacency(a), a.nrows)


@query("select c_custkey i, c_custkey % 3 color from customer")
def coloring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy by index: a chain takes three colours in turn."""
    return graph.color_graph(systems.chain(spark, sf_dir))


@query("select 0::bigint conflicts")
def coloring_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = systems.trade(spark, sf_dir)
    near, c = graph.distance2(graph.adjacency(a), a.nrows), graph.color_graph(a)
    both = near.where("src <> dst").join(c.selectExpr("i src", "color"), "src").join(c.selectExpr("i dst", "color other"), "dst")
    return both.agg(F.count(F.when(F.col("color") == F.col("other"), 1)).alias("conflicts"))


@query("select c_custkey % 3 color, count(*) n, min(c_custkey) lo, max(c_custkey) hi from customer group by 1")
def color_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = graph.blocks_from_colors(graph.color_graph(systems.chain(spark, sf_dir)))
    return b.select("color", F.size("members").cast("long").alias("n"), F.array_min("members").alias("lo"), F.array_max("members").alias("hi"))


# --- sessions


@query("select * from (values (1, false, false), (2, true, true), (3, true, true), (9, true, false)) t(iteration, stop, converged)")
def convergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = Convergence(1e-2, 9)
    rows = [(k, rule.check(r, 10.0, k)) for k, r in ((1, 1.0), (2, 0.1), (3, 0.0), (9, 5.0))]
    return spark.createDataFrame([(k, stop, s.converged) for k, (stop, s) in rows], "iteration int, stop boolean, converged boolean")


@query("select * from (values ('cg', true, true, true), ('gmres', true, true, true), ('minres', true, true, true)) t(kind, from_start, reaches_goal, stats_agree)")
def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a history holds: from iteration 0, one row an iteration, down to the goal, as the statistics say."""
    a, out = systems.trade(spark, sf_dir), []
    b = systems.right_side(a)
    for kind in ("cg", "gmres", "minres"):
        got = SolverSession(kind, tier="local", tol=1e-8).solve(a, b)
        rows = got.history_df(spark).orderBy("iter").collect()
        out.append((kind, [r["iter"] for r in rows] == list(range(got.stats.iterations + 1)), rows[-1]["residual"] <= 1e-8 * rows[0]["residual"], rows[-1]["iter"] == got.stats.iterations))
    return spark.createDataFrame(out, "kind string, from_start boolean, reaches_goal boolean, stats_agree boolean")


@query("select * from (values ('FactorError'), ('IndefiniteMatrix'), ('NotFactored'), ('ShapeError'), ('Unsupported'), ('ZeroPivot')) t(error)")
def errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each error where it is due: on the trade network, its negative, and a matrix without a diagonal."""
    a = systems.trade(spark, sf_dir)
    b, none = systems.right_side(a), Matrix(a.df.where("i <> j"), a.nrows, a.ncols)
    negative = Matrix(a.df.selectExpr("i", "j", "-v v"), a.nrows, a.ncols)
    tries = (
        lambda: DirectLU().solve(Matrix(a.df.where("i < 5"), a.nrows, a.ncols), b), lambda: SolverSession("cg", tier="local").solve(negative, b), lambda: DirectLU().solve_cached(b),
        lambda: SolverSession("cg").solve(a, Vector(b.df, b.n + 1)), lambda: SolverSession("cg", PC.make("jacobi"), tier="local").solve(a, b), lambda: SolverSession("gmres_right", PC.make("sor"), tier="local").solve(none, b),
    )
    out = []
    for f in tries:
        try:
            f()
        except SparsolveError as e:
            out.append((type(e).__name__,))
    return spark.createDataFrame(out, "error string")


@query(CUSTOMERS)
def fgmres_modified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Another preconditioner at every other step, and modified Gram-Schmidt."""
    a = systems.chain(spark, sf_dir, "nonsymmetric")
    smooth = PC.make("chebyshev", steps=2, low=0.5, high=3.5).setup(a)
    plain = PC.make("jacobi").setup(a)
    change = {"modify": lambda k, pc: smooth if k % 2 else plain, "orthogonalization": Orthogonalization.MODIFIED}
    return checked(SolverSession("fgmres", plain, tier="broadcast", options=change).solve(a, systems.right_side(a)).x)


@query(NATIONS)
def options_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A preconditioner from string options, with a monitor that sees every iteration."""
    a, seen = systems.trade(spark, sf_dir), []
    got = SolverSession("pcg", PC.from_options({"pc_type": "sor", "omega": "1.1"}), tol=1e-12, tier="local", monitor=lambda k, r: seen.append(k)).solve(a, systems.right_side(a))
    return checked(got.x).withColumn("ok", F.col("ok") & F.lit(seen == list(range(got.stats.iterations + 1))))


def trade_solution(spark: SparkSession, sf_dir: str) -> SolveResult:
    a = systems.trade(spark, sf_dir)
    return SolverSession("pcg", PC.make("jacobi"), tol=1e-12, tier=Tier.FRAME).solve(a, systems.right_side(a))


@query(f"select n_name, x, ok from ({NATIONS}) join nation on n_nationkey = i")
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations' balances in the trade network, by name."""
    names = systems.table(spark, sf_dir, "nation").selectExpr("n_name", "cast(n_nationkey as bigint) i")
    return checked(trade_solution(spark, sf_dir).x).join(names, "i").select("n_name", "x", "ok")


@query("select true same")
def tiers_agree(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = systems.trade(spark, sf_dir)
    b = systems.right_side(a)
    got = [np.array([r["v"] for r in SolverSession("gmres", tol=1e-12, tier=t).solve(a, b).x.dense().orderBy("i").collect()]) for t in (Tier.LOCAL, Tier.BROADCAST)]
    return spark.createDataFrame([(bool(np.abs(got[0] - got[1]).max() < 1e-6),)], "same boolean")
