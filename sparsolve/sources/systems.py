"""Linear systems from tables, by SQL that Spark and other engines read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.linalg import matvec
from ..types import Matrix, Vector
from .ingest import tridiagonal

TRADE = """
    with w as (
        select c_nationkey i, s_nationkey j, count(*) v from {lineitem} join {orders} on l_orderkey = o_orderkey
        join {customer} on o_custkey = c_custkey join {supplier} on l_suppkey = s_suppkey group by c_nationkey, s_nationkey
    ), s as (select i, j, v from w where i <> j union all select j, i, v from w where i <> j),
    o as (select i, j, sum(v) v from s group by i, j),
    d as (select i, sum(v) v from o group by i)
    select i, j, -v v from o union all select n_nationkey i, n_nationkey j, 1 + coalesce(v, 0) v from {nation} left join d on n_nationkey = i"""
PARTS = "select l_partkey i, l_suppkey j, sum(l_quantity) v from {lineitem} group by l_partkey, l_suppkey"
MOVES = """
    with e as (select dense_rank() over (order by event_type) - 1 k, user_id, ts, event_id from {events}),
    m as (select k i, lead(k) over (partition by user_id order by ts, event_id) j from e)
    select i, j, count(*) v from m where j is not null group by i, j"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sql(spark: SparkSession, sf_dir: str, text: str, *names: str) -> DataFrame:
    return spark.sql(text, **{n: table(spark, sf_dir, n) for n in names})


def trade(spark: SparkSession, sf_dir: str) -> Matrix:
    """Nations by line items traded: a symmetric positive definite graph Laplacian plus the identity."""
    return Matrix.of(_sql(spark, sf_dir, TRADE, "lineitem", "orders", "customer", "supplier", "nation"), table(spark, sf_dir, "nation").count())


def customers(spark: SparkSession, sf_dir: str) -> int:
    return table(spark, sf_dir, "customer").count()


def chain(spark: SparkSession, sf_dir: str, kind: str = "spd") -> Matrix:
    """Tridiagonal over the customers: spd (-1, 4, -1), laplace (-1, 2, -1), nonsymmetric (-1, 2, 0.5), indefinite (-1, +-4, -1)."""
    lower, diagonal, upper = {"spd": (-1.0, 4.0, -1.0), "laplace": (-1.0, 2.0, -1.0), "nonsymmetric": (-1.0, 2.0, 0.5), "indefinite": (-1.0, "if(i % 2 = 0, 4D, -4D)", -1.0)}[kind]
    return tridiagonal(spark, customers(spark, sf_dir), lower, diagonal, upper)


def parts_by_suppliers(spark: SparkSession, sf_dir: str) -> Matrix:
    """Quantities: tall, of full column rank."""
    return Matrix.of(_sql(spark, sf_dir, PARTS, "lineitem"), table(spark, sf_dir, "part").count(), table(spark, sf_dir, "supplier").count())


def moves(spark: SparkSession, sf_dir: str) -> Matrix:
    """How often an event type follows another, per user in the order of time."""
    return Matrix.of(_sql(spark, sf_dir, MOVES, "events"), table(spark, sf_dir, "events").select("event_type").distinct().count())


def page_rank_like(spark: SparkSession, sf_dir: str) -> Matrix:
    """I - 0.85 P', P the moves' rows scaled to sum 1: nonsymmetric."""
    m = moves(spark, sf_dir)
    total = m.df.groupBy("i").agg(F.sum("v").alias("t"))
    p = m.df.join(total, "i").selectExpr("j i", "i j", "-0.85D * v / t v")
    both = p.unionByName(spark.range(m.nrows).selectExpr("id i", "id j", "1D v"))
    return Matrix(both.groupBy("i", "j").agg(F.sum("v").alias("v")), m.nrows, m.ncols)


def embedding_gram(spark: SparkSession, sf_dir: str) -> Matrix:
    """E'E + I of the embeddings: small, dense, positive definite."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("j", "v"))
    width = table(spark, sf_dir, "embeddings").agg(F.max(F.size("embedding"))).first()[0]
    left, right = e.selectExpr("vec_id", "j i", "cast(v as double) a"), e.selectExpr("vec_id", "j", "cast(v as double) b")
    cells = left.join(right, "vec_id").groupBy("i", "j").agg(F.sum(F.col("a") * F.col("b")).alias("v"))
    return Matrix(cells.select(F.col("i").cast("long"), F.col("j").cast("long"), (F.col("v") + F.when(F.col("i") == F.col("j"), 1.0).otherwise(0.0)).alias("v")), width, width)


def nation_batch(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A 2 x 2 system per nation, with the solution (system_id % 5 + 1, 2): from counts and key sums of its customers."""
    c = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").cast("long").alias("system_id")).agg(F.count("*").alias("n"), F.sum(F.col("c_custkey") % 10).alias("s"), F.sum((F.col("c_custkey") % 10) ** 2).alias("q"))
    c = c.selectExpr("system_id", "cast(n as double) n", "cast(s as double) s", "q + 1D q", "cast(system_id % 5 + 1 as double) x")
    a = c.selectExpr("system_id", "inline(array(struct(0L i, 0L j, n v), struct(0L i, 1L j, s v), struct(1L i, 0L j, s v), struct(1L i, 1L j, q v)))")
    b = c.selectExpr("system_id", "inline(array(struct(0L i, n * x + 2 * s v), struct(1L i, s * x + 2 * q v)))")
    return a, b


def truth(spark: SparkSession, n: int) -> Vector:
    """1, 2, ... 7, 1, 2, ..."""
    return Vector(spark.range(n).selectExpr("id i", "cast(id % 7 + 1 as double) v"), n)


def right_side(a: Matrix) -> Vector:
    return matvec(a, truth(a.spark, a.ncols))
