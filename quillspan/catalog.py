"""The registered queries of the engine, each with the SQL that yields the same rows in another engine."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions import activations as act
from .functions import kernels
from .functions import vectors as vec
from .functions.rng import SeedPath, component, laplace, log_uniform, mixture_noise, normalize_weights, uniform, uniform_sql
from .operators import audit, coverage, extra_trees, gates, generate, graphs, metrics, postprocess, reshape
from .plans.config import Config
from .plans.sampling import FAMILY_LOGITS, Layout, family_probabilities, plan_rows, sample_layout, sample_plan
from .sources import lineage, packed
from .streaming.coverage import windowed_coverage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r(x: Column | str, places: int = 6) -> Column:
    return F.round(F.col(x) if isinstance(x, str) else x, places)


NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as a corpus of eight datasets."""
    cols = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber", "l_returnflag", "l_linestatus"]
    return table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 8).alias("ds"), *cols)


CORPUS = "(SELECT l_suppkey % 8 AS ds, * FROM lineitem)"
LONG = f"(UNPIVOT (SELECT ds, l_quantity, l_extendedprice, l_discount, l_tax FROM {CORPUS}) ON l_quantity, l_extendedprice, l_discount, l_tax INTO NAME feature VALUE value)"


DIMS = 64


def x64(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as (vec_id, label, x) in doubles."""
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"))


X = "(SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings)"


# ---- transforms


@query(f"""
WITH q AS (SELECT ds, feature, quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.99) AS hi FROM {LONG} GROUP BY ds, feature),
c AS (SELECT ds, feature, least(greatest(value, lo), hi) AS v FROM {LONG} JOIN q USING (ds, feature)),
s AS (SELECT ds, feature, avg(v) AS m, greatest(stddev_pop(v), 1e-6) AS s FROM c GROUP BY ds, feature)
SELECT ds, feature, count(*) AS n, round(min((v - m) / s), 5) AS z_min, round(max((v - m) / s), 5) AS z_max, round(avg(((v - m) / s) * ((v - m) / s)), 5) AS z_sq,
  round(avg(((v - m) / s) * ((v - m) / s) * ((v - m) / s)), 5) AS z_cube FROM c JOIN s USING (ds, feature) GROUP BY ds, feature""")
def clip_standardize(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = postprocess.clip_standardize(corpus(spark, sf_dir), NUMERIC, ["ds"])
    v = F.col("value")
    return postprocess.unpivot(z, ["ds"], NUMERIC).groupBy("ds", "feature").agg(F.count("*").alias("n"), r(F.min(v), 5).alias("z_min"), r(F.max(v), 5).alias("z_max"), r(F.avg(v * v), 5).alias("z_sq"), r(F.avg(v * v * v), 5).alias("z_cube"))


@query("""
WITH q AS (SELECT quantile_cont(o_totalprice, 0.01) AS lo, quantile_cont(o_totalprice, 0.99) AS hi FROM orders),
c AS (SELECT o_orderkey, least(greatest(o_totalprice, lo), hi) AS v FROM orders, q), s AS (SELECT avg(v) AS m, greatest(stddev_pop(v), 1e-6) AS s FROM c)
SELECT o_orderkey, round((v - m) / s, 6) AS z FROM c, s""")
def regression_target_standardize(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = postprocess.clip_standardize(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice"])
    return z.select("o_orderkey", r("o_totalprice").alias("z"))


@query("""
WITH c AS (SELECT event_id, event_type, CASE WHEN v IS NULL OR isnan(v) THEN 0.0 ELSE greatest(-1e6, least(1e6, v)) END AS v
  FROM (SELECT event_id, event_type, CASE event_id % 50 WHEN 0 THEN 'NaN'::DOUBLE WHEN 1 THEN 'Infinity'::DOUBLE WHEN 2 THEN NULL ELSE value END AS v FROM events)),
s AS (SELECT event_type, avg(v) AS m, greatest(stddev_samp(v), 1e-6) AS s FROM c GROUP BY event_type)
SELECT event_id, round((v - m) / s, 5) AS z FROM c JOIN s USING (event_type)""")
def sanitize_standardize(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 50
    v = F.when(k == 0, float("nan")).when(k == 1, float("inf")).when(k == 2, None).otherwise(F.col("value"))
    e = table(spark, sf_dir, "events").select("event_id", "event_type", v.alias("v"))
    return postprocess.sanitize_standardize(e, ["v"], ["event_type"]).select("event_id", r("v", 5).alias("z"))


@query(f"""SELECT ds, feature, round(stddev_pop(value), 6) AS sd, stddev_pop(value) > 1e-12 AS keep FROM
 (UNPIVOT (SELECT ds, l_quantity, l_tax, 7.0::DOUBLE AS fixed FROM {CORPUS}) ON l_quantity, l_tax, fixed INTO NAME feature VALUE value) GROUP BY ds, feature""")
def constant_column_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = corpus(spark, sf_dir).withColumn("fixed", F.lit(7.0))
    return postprocess.constant_columns(c, ["l_quantity", "l_tax", "fixed"], ["ds"]).withColumn("sd", r("sd"))


@query(f"""WITH k AS (SELECT DISTINCT ds, l_returnflag, dense_rank() OVER (PARTITION BY ds ORDER BY l_returnflag) - 1 AS code FROM {CORPUS})
SELECT ds, l_returnflag, code::INTEGER AS code, count(*) AS n FROM {CORPUS} JOIN k USING (ds, l_returnflag) GROUP BY ALL""")
def label_densify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return postprocess.densify_labels(corpus(spark, sf_dir), "l_returnflag", ["ds"]).groupBy("ds", "l_returnflag", F.col("code").cast("int").alias("code")).agg(F.count("*").alias("n"))


@query(f"""WITH k AS (SELECT label, row_number() OVER (ORDER BY {uniform_sql(11, "labels", "label")}, label) - 1 AS code FROM (SELECT DISTINCT label FROM embeddings))
SELECT vec_id, code::INTEGER AS code FROM embeddings JOIN k USING (label)""")
def label_permute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return postprocess.densify_labels(table(spark, sf_dir, "embeddings"), "label", seed=11).select("vec_id", F.col("code").cast("int").alias("code"))


_SPLIT = f"""
c AS (SELECT label, count(*) AS n, CASE WHEN count(*) > 1 THEN greatest(1, least(count(*) - 1, floor(count(*) * 0.7))) ELSE floor(count(*) * 0.7) END::BIGINT AS base, count(*) * 0.7::DOUBLE - floor(count(*) * 0.7::DOUBLE) AS rest FROM embeddings GROUP BY label),
d AS (SELECT *, floor(sum(n) OVER () * 0.7::DOUBLE) - sum(base) OVER () AS deficit, row_number() OVER (ORDER BY rest DESC, label) AS place FROM c),
t AS (SELECT label, base + CASE WHEN place <= deficit AND base < greatest(n - 1, 1) THEN 1 ELSE 0 END AS take FROM d),
s AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY {uniform_sql(5, "split", "vec_id")}, vec_id) <= take AS is_train FROM embeddings JOIN t USING (label))"""


@query(f"WITH {_SPLIT} SELECT vec_id, label, is_train FROM s")
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return postprocess.stratified_split(table(spark, sf_dir, "embeddings").select("vec_id", "label"), "label", 0.7, 5, "vec_id")


@query(f"WITH {_SPLIT} SELECT g, bool_and(a) AND bool_and(b) AND count(*) > 1 AS valid FROM (SELECT label % 3 AS g, label, bool_or(is_train) AS a, bool_or(NOT is_train) AS b FROM s GROUP BY ALL) GROUP BY g")
def split_class_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = postprocess.stratified_split(table(spark, sf_dir, "embeddings").select("vec_id", "label"), "label", 0.7, 5, "vec_id")
    return postprocess.split_classes_match(s.withColumn("g", F.col("label") % 3), "label", "is_train", ["g"])


@query(f"SELECT o_orderkey, {uniform_sql(42, 'mcar/o_totalprice', 'o_orderkey')} < 0.2 AS missing FROM orders")
def mcar_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return postprocess.mcar(table(spark, sf_dir, "orders"), ["o_totalprice"], 0.2, 42, "o_orderkey").select("o_orderkey", F.isnan("o_totalprice").alias("missing"))


@query("WITH s AS (SELECT avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS s FROM orders) SELECT o_orderkey, round(1.5 * (o_totalprice - m) / s, 6) AS logit, round(1 / (1 + exp(-1.5 * (o_totalprice - m) / s)), 6) AS p FROM orders, s")
def mnar_logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = postprocess.mnar_logits(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", 1.5)
    return out.select("o_orderkey", r("logit").alias("logit"), r("p").alias("p"))


@query(f"""SELECT g, count(*) AS n_cells, sum(m)::BIGINT AS n_missing, round(sum(m) / count(*), 6) AS realized,
CASE WHEN abs(sum(m) / count(*) - 0.2) >= 0.05 THEN 'fail' WHEN abs(sum(m) / count(*) - 0.2) >= 0.03 THEN 'warn' ELSE 'pass' END AS status
FROM (SELECT o_orderpriority AS g, CASE WHEN {uniform_sql(42, "mcar/o_totalprice", "o_orderkey")} < 0.2 THEN 1 ELSE 0 END AS m FROM orders) GROUP BY g""")
def missingness_guardrail(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = postprocess.mcar(table(spark, sf_dir, "orders"), ["o_totalprice"], 0.2, 42, "o_orderkey")
    out = gates.missingness_guardrail(o.select(F.col("o_orderpriority").alias("g"), F.col("o_totalprice").alias("value")), 0.2, ["g"])
    return out.select("g", "n_cells", F.col("n_missing").cast("long").alias("n_missing"), r("realized").alias("realized"), "status")


# ---- activations

_Z = "(SELECT c_custkey, c_acctbal / 1000.0 AS x FROM customer)"
_SIG = "(1 / (1 + exp(-x)))"
_RELU = "greatest(x, 0.0)"
_ACT_SQL = {
    "tanh": "tanh(x)", "leaky_relu": "CASE WHEN x > 0 THEN x ELSE 0.01 * x END", "elu": "CASE WHEN x > 0 THEN x ELSE exp(x) - 1 END", "identity": "x", "silu": f"x * {_SIG}", "swiglu": f"x * x * {_SIG}",
    "relu": _RELU, "relu_sq": f"{_RELU} * {_RELU}", "softplus": "CASE WHEN x > 20 THEN x ELSE ln(1 + exp(least(x, 20.0))) END", "sign": "sign(x)::DOUBLE", "gauss": "exp(-x * x)", "exp": "exp(least(x, 20.0))", "sin": "sin(x)",
    "square": "x * x", "abs": "abs(x)", "logsigmoid": "least(x, 0.0) - ln(1 + exp(-abs(x)))", "logabs": "ln(greatest(abs(x), 1e-6))", "sigmoid": _SIG, "round": "round_even(x, 0)", "mod1": "x - floor(x)",
    "selu": "1.0507009873554805 * CASE WHEN x > 0 THEN x ELSE 1.6732632423543772 * (exp(x) - 1) END", "relu6": f"least({_RELU}, 6.0)", "hardtanh": "least(greatest(x, -1.0), 1.0)", "indicator_01": "CASE WHEN x >= 0 AND x <= 1 THEN 1.0 ELSE 0.0 END::DOUBLE",
}


@query("SELECT c_custkey, " + ", ".join(f"round({s}, 5) AS {n}_" for n, s in _ACT_SQL.items()) + f" FROM {_Z}")
def activations_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("c_acctbal") / 1000.0
    return table(spark, sf_dir, "customer").select("c_custkey", *[r(f(x).cast("double"), 5).alias(f"{n}_") for n, f in act.SCALAR.items()])


@query(f"SELECT c_custkey, round(pow({_RELU}, 0.7), 5) AS relu_pow, round(sign(x) * pow(abs(x), 0.7), 5) AS signed_pow, round(pow(abs(x) + 0.001, -0.7), 4) AS inv_pow, round(pow(x, 3), 5) AS poly FROM {_Z}")
def activations_parametric(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("c_acctbal") / 1000.0
    p = act.PARAMETRIC
    return table(spark, sf_dir, "customer").select("c_custkey", r(p["relu_pow"](x, 0.7), 5).alias("relu_pow"), r(p["signed_pow"](x, 0.7), 5).alias("signed_pow"), r(p["inv_pow"](x, 0.7), 4).alias("inv_pow"), r(p["poly"](x, 3.0), 5).alias("poly"))


@query(f"""WITH e AS (SELECT vec_id, x, unnest(x) AS v, unnest(range(0, {DIMS})) AS i FROM {X}),
w AS (SELECT vec_id, i, round(exp(v - max(v) OVER p) / sum(exp(v - m)) OVER p, 6) AS softmax, row_number() OVER (PARTITION BY vec_id ORDER BY v, i) AS rank, row_number() OVER (PARTITION BY vec_id ORDER BY v DESC, i) AS down
  FROM (SELECT *, max(v) OVER (PARTITION BY vec_id) AS m FROM e) WINDOW p AS (PARTITION BY vec_id))
SELECT a.vec_id, a.i::INTEGER AS i, a.softmax, CASE WHEN a.down = 1 THEN 1.0 ELSE 0.0 END::DOUBLE AS onehot, b.i::INTEGER AS argsort, a.rank::INTEGER AS rank FROM w a JOIN w b ON a.vec_id = b.vec_id AND b.rank = a.i + 1""")
def activations_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("x")
    z = F.arrays_zip(act.softmax(x).alias("softmax"), act.onehot_argmax(x).alias("onehot"), act.argsort(x).alias("argsort"), act.rank(x).alias("rank"))
    out = x64(spark, sf_dir).select("vec_id", F.posexplode(z).alias("i", "z"))
    return out.select("vec_id", "i", r("z.softmax").alias("softmax"), F.col("z.onehot").alias("onehot"), F.col("z.argsort").cast("int").alias("argsort"), F.col("z.rank").cast("int").alias("rank"))


# ---- draws

_MIX = {"gaussian": 0.5, "laplace": 0.3, "student_t": 0.2}
_U = "greatest(1e-7, least(1 - 1e-7, u))"


@query(f"SELECT o_orderkey, round(CASE WHEN {_U} < 0.5 THEN ln(2 * {_U}) ELSE -ln(2 * (1 - {_U})) END, 6) AS noise FROM (SELECT o_orderkey, {uniform_sql(3, 'laplace', 'o_orderkey')} AS u FROM orders)")
def noise_laplace_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", r(laplace(uniform(3, "laplace", "o_orderkey"))).alias("noise"))


@query(f"SELECT family, count(*) AS n FROM (SELECT CASE WHEN u < 0.5 THEN 'gaussian' WHEN u < 0.8 THEN 'laplace' ELSE 'student_t' END AS family FROM (SELECT {uniform_sql(3, 'mixture', 'o_orderkey')} AS u FROM orders)) GROUP BY family")
def mixture_component(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy(component(uniform(3, "mixture", "o_orderkey"), _MIX).alias("family")).agg(F.count("*").alias("n"))


@query(f"SELECT o_orderkey, round(exp(ln(0.1) + u * (ln(10.0) - ln(0.1))), 6) AS v FROM (SELECT o_orderkey, {uniform_sql(3, 'logu', 'o_orderkey')} AS u FROM orders)")
def log_uniform_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", r(log_uniform(uniform(3, "logu", "o_orderkey"), 0.1, 10.0)).alias("v"))


@query(f"SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY {uniform_sql(9, 'permutation', 'o_orderkey')}, o_orderkey) - 1 AS position FROM orders")
def keyed_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = postprocess.keyed_permutation(table(spark, sf_dir, "orders"), 9, "o_orderkey", group=["o_orderpriority"])
    return p.select("o_orderkey", F.col("position").cast("long").alias("position"))


@query(f"SELECT event_id FROM events ORDER BY {uniform_sql(1, 'reservoir', 'event_id')}, event_id LIMIT 100")
def reservoir_bottom_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return postprocess.bottom_k_sample(table(spark, sf_dir, "events").select("event_id"), 100, 1, "event_id").select("event_id")


# ---- mechanism functions

_W = [round(((7 * i) % 11 - 5) / 5, 3) for i in range(DIMS)]
_CENTERS = [[round((((i + 1) * (j + 3)) % 7 - 3) / 10, 3) for j in range(DIMS)] for i in range(5)]
_SIGMA = [1.0, 1.1, 0.9, 1.2, 0.8]
_QM = [[round(((i * j + i + 2 * j) % 5 - 2) / 4, 3) for j in range(DIMS)] for i in range(DIMS)]


def _list(v: list) -> str:
    return "[" + ", ".join(f"{x}::DOUBLE" for x in v) + "]"


_DOT = f"list_dot_product(x, {_list(_W)})"
_CS = "(" + " UNION ALL ".join(f"SELECT {i} AS c, {_list(c)} AS y, {s}::DOUBLE AS s" for i, (c, s) in enumerate(zip(_CENTERS, _SIGMA, strict=True))) + ")"
_LP = "list_sum(list_transform(list_zip(x, y), lambda z: pow(abs(z[1] - z[2]), {p})))"


@query(f"SELECT vec_id, round({_DOT}, 5) AS y FROM {X}")
def linear_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return x64(spark, sf_dir).select("vec_id", r(vec.linear(F.col("x"), _W), 5).alias("y"))


@query("SELECT vec_id, round(" + " + ".join(f"x[{i + 1}] * list_dot_product(x, {_list(row)})" for i, row in enumerate(_QM)) + f", 5) AS y FROM {X}")
def quadratic_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    return x64(spark, sf_dir).select("vec_id", r(vec.quadratic(F.col("x"), _QM), 5).alias("y"))


_G = f"(1 / (1 + exp(-({_DOT} + 0.3) * 2.0)))"


@query(f"SELECT vec_id, round({_G} * sin({_DOT}) + (1 - {_G}) * {_DOT} * {_DOT}, 5) AS y FROM {X}")
def piecewise_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("d")
    return x64(spark, sf_dir).withColumn("d", vec.linear(F.col("x"), _W)).select("vec_id", r(vec.gate(d, F.sin(d), d * d, 2.0, 0.3), 5).alias("y"))


@query(f"SELECT vec_id, round(tanh({_DOT}) * x[1], 6) AS y FROM {X}")
def product_fn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return x64(spark, sf_dir).select("vec_id", r(F.tanh(vec.linear(F.col("x"), _W)) * F.col("x")[0]).alias("y"))


@query(f"SELECT vec_id, c, round(pow({_LP.format(p=1.5)}, 1 / 1.5), 5) AS d FROM {X}, {_CS}")
def lp_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = [F.struct(F.lit(i).alias("c"), F.pow(vec.lp_power(F.col("x"), F.array(*map(F.lit, c)), 1.5), F.lit(1 / 1.5)).alias("d")) for i, c in enumerate(_CENTERS)]
    return x64(spark, sf_dir).select("vec_id", F.explode(F.array(*d)).alias("e")).select("vec_id", "e.c", r("e.d", 5).alias("d"))


@query(f"SELECT vec_id, arg_min(c, (d, c))::INTEGER AS center FROM (SELECT vec_id, c, {_LP.format(p=2)} AS d FROM {X}, {_CS}) GROUP BY vec_id")
def nearest_center(spark: SparkSession, sf_dir: str) -> DataFrame:
    return x64(spark, sf_dir).select("vec_id", vec.nearest(F.col("x"), _CENTERS).alias("center"))


@query(f"""WITH e AS (SELECT vec_id, c, exp(-0.5 * ln(2 * pi() * s * s) - pow(pow({_LP.format(p=2)}, 0.5) / s, 1.5)) AS w FROM {X}, {_CS})
SELECT vec_id, c::INTEGER AS c, round(w / sum(w) OVER (PARTITION BY vec_id), 6) AS share FROM e""")
def em_soft_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = vec.soft_assignment(F.col("x"), _CENTERS, _SIGMA, 2.0, 1.5)
    return x64(spark, sf_dir).select("vec_id", F.posexplode(s).alias("c", "share")).withColumn("share", r("share"))


@query(f"SELECT (CASE WHEN x[1] > 0 THEN 1 ELSE 0 END + CASE WHEN x[3] > 0.05 THEN 2 ELSE 0 END + CASE WHEN x[5] > -0.05 THEN 4 ELSE 0 END)::INTEGER AS leaf, count(*) AS n FROM {X} GROUP BY leaf")
def odt_leaf_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("x")
    return x64(spark, sf_dir).groupBy(vec.leaf_index([x[0], x[2], x[4]], [0.0, 0.05, -0.05]).alias("leaf")).agg(F.count("*").alias("n"))


@query("WITH b AS (SELECT min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part) SELECT p_partkey, round(1 - pow(1 - pow((p_retailprice - lo) / greatest(hi - lo, 1e-6), 0.7), 2.5), 6) AS warped FROM part, b")
def kumaraswamy_warp(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    b = p.agg(F.min("p_retailprice").alias("lo"), F.max("p_retailprice").alias("hi"))
    u = (F.col("p_retailprice") - F.col("lo")) / F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-6))
    return p.crossJoin(F.broadcast(b)).select("p_partkey", r(vec.kumaraswamy(u, 0.7, 2.5)).alias("warped"))  # one row


@query(f"""SELECT label, i::INTEGER AS i, round(sum(v), 4) AS total, round(product(1 + v / 10), 5) AS product, round(max(v), 6) AS top, round(max(m) + ln(sum(exp(v - m))), 5) AS lse
FROM (SELECT *, max(v) OVER (PARTITION BY label, i) AS m FROM (SELECT label, unnest(x) AS v, unnest(range({DIMS})) AS i FROM {X})) GROUP BY label, i""")
def parent_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = reshape.aggregate_parents(x64(spark, sf_dir), ["label"], "x", scale=10.0)
    return out.select("label", "i", r("total", 4).alias("total"), r("product", 5).alias("product"), r("top").alias("top"), r("lse", 5).alias("lse"))


# ---- profiles


@query(f"""WITH c AS (SELECT ds, l_returnflag, count(*) AS n FROM {CORPUS} GROUP BY ALL), p AS (SELECT *, n / sum(n) OVER (PARTITION BY ds) AS p FROM c)
SELECT ds, count(*) AS n_classes, round(sum(-p * ln(p)), 6) AS entropy, round(max(n) / min(n), 6) AS imbalance, sum(n)::BIGINT AS n_rows FROM p GROUP BY ds""")
def class_imbalance(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.class_structure(corpus(spark, sf_dir), "l_returnflag", ["ds"])
    return out.withColumns({"entropy": r("entropy"), "imbalance": r("imbalance")})


@query("SELECT g, count(*) AS n, count(DISTINCT label) AS n_classes, min(label) AS lo, max(label) AS hi, max(label) - min(label) + 1 = count(DISTINCT label) AS contiguous FROM (SELECT vec_id % 7 AS g, label FROM embeddings) GROUP BY g")
def class_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.label_range(table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 7).alias("g"), "label"), "label", ["g"])


@query(f"SELECT ds, feature, cardinality FROM (UNPIVOT (SELECT ds, count(DISTINCT l_linenumber) AS l_linenumber, count(DISTINCT l_returnflag) AS l_returnflag, count(DISTINCT l_linestatus) AS l_linestatus FROM {CORPUS} GROUP BY ds) ON l_linenumber, l_returnflag, l_linestatus INTO NAME feature VALUE cardinality)")
def categorical_cardinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.categorical_cardinality(corpus(spark, sf_dir), ["l_linenumber", "l_returnflag", "l_linestatus"], ["ds"])


def _corr_sql(source: str) -> str:
    pairs = [(a, b) for i, a in enumerate(NUMERIC) for b in NUMERIC[i + 1 :]]
    rs = ", ".join(f"abs(corr({a}, {b})) AS r{k}" for k, (a, b) in enumerate(pairs))
    each = ", ".join(f"r{k}" for k in range(len(pairs)))
    return f"SELECT ds, round(list_avg([{each}]), 5) AS mean_abs, round(list_max([{each}]), 5) AS max_abs FROM (SELECT ds, {rs} FROM {source} GROUP BY ds)"


@query(_corr_sql(CORPUS))
def pearson_abs_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.abs_summary(metrics.pearson_pairs(corpus(spark, sf_dir), NUMERIC, ["ds"]), ["ds"])
    return out.select("ds", r("mean_abs", 5).alias("mean_abs"), r("max_abs", 5).alias("max_abs"))


_RANKS = "(SELECT ds, " + ", ".join(f"rank() OVER (PARTITION BY ds ORDER BY {v}) + (count(*) OVER (PARTITION BY ds, {v}) - 1) / 2 AS {v}" for v in NUMERIC) + f" FROM {CORPUS})"


@query(_corr_sql(_RANKS))
def spearman_abs_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = metrics.average_ranks(corpus(spark, sf_dir).select("ds", *NUMERIC), NUMERIC, ["ds"])
    out = metrics.abs_summary(metrics.pearson_pairs(ranks, NUMERIC, ["ds"]), ["ds"])
    return out.select("ds", r("mean_abs", 5).alias("mean_abs"), r("max_abs", 5).alias("max_abs"))


@query("SELECT event_id, rank() OVER (PARTITION BY event_type ORDER BY round(value, 0)) + (count(*) OVER (PARTITION BY event_type, round(value, 0)) - 1) / 2 AS rank FROM events")
def average_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "event_type", F.round("value", 0).alias("rank"))
    return metrics.average_ranks(e, ["rank"], ["event_type"]).select("event_id", "rank")


@query("""SELECT g, CASE WHEN max(abs(y - round_even(y, 0))) <= 1e-8 AND count(DISTINCT y) <= greatest(10, floor(sqrt(count(*))) + 1) THEN 'classification' ELSE 'regression' END AS task
FROM (SELECT 'flag' AS g, l_linenumber::DOUBLE AS y FROM lineitem UNION ALL SELECT 'price', l_extendedprice FROM lineitem) GROUP BY g""")
def infer_task(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")
    both = l.select(F.lit("flag").alias("g"), F.col("l_linenumber").cast("double").alias("y")).union(l.select(F.lit("price"), "l_extendedprice"))
    return metrics.infer_task(both, "y", ["g"])


# ---- coverage and gates

_METRICS = f"(SELECT ds, feature AS metric, avg(value) AS value FROM {LONG} GROUP BY ALL)"
_ROWS = f"(SELECT feature AS metric, value FROM {LONG})"


def metric_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = postprocess.unpivot(corpus(spark, sf_dir), ["ds"], NUMERIC, "metric")
    return long.groupBy("ds", "metric").agg(F.avg("value").alias("value"))


_SUMMARY = "count(value) AS count, count(*) - count(value) AS missing, avg(value) AS mean, stddev_pop(value) AS std, min(value) AS min, max(value) AS max, quantile_cont(value, 0.05) AS p05, quantile_cont(value, 0.25) AS p25, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.75) AS p75, quantile_cont(value, 0.95) AS p95"
_STATS = ["mean", "std", "min", "max", "p05", "p25", "p50", "p75", "p95"]


@query(f"SELECT metric, count, missing, {', '.join(f'round({s}, 4) AS {s}' for s in _STATS)} FROM (SELECT metric, {_SUMMARY} FROM {_ROWS} GROUP BY metric)")
def coverage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = postprocess.unpivot(corpus(spark, sf_dir), ["ds"], NUMERIC, "metric")
    return coverage.coverage_summary(rows).withColumns({s: r(s, 4) for s in _STATS})


def _hist_sql(bins: int, source: str, edges: str) -> str:
    return f"""e AS ({edges}), g AS (SELECT metric, lo, hi, unnest(range(0, {bins}))::INTEGER AS bin FROM e),
k AS (SELECT metric, least(floor((value - lo) / ((hi - lo) / {bins})), {bins - 1})::INTEGER AS bin, count(*) AS count FROM {source} JOIN e USING (metric) WHERE value BETWEEN lo AND hi GROUP BY ALL)"""


_EDGES = f"SELECT metric, CASE WHEN min(value) = max(value) THEN min(value) - 0.5 ELSE min(value) END AS lo, CASE WHEN min(value) = max(value) THEN max(value) + 0.5 ELSE max(value) END AS hi FROM {_ROWS} GROUP BY metric"


@query(f"WITH {_hist_sql(12, _ROWS, _EDGES)} SELECT metric, bin, round(lo + bin * (hi - lo) / 12, 4) AS lo, round(lo + (bin + 1) * (hi - lo) / 12, 4) AS hi, coalesce(count, 0)::BIGINT AS count FROM g LEFT JOIN k USING (metric, bin)")
def coverage_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = postprocess.unpivot(corpus(spark, sf_dir), ["ds"], NUMERIC, "metric")
    return coverage.histogram(rows, 12).withColumns({"lo": r("lo", 4), "hi": r("hi", 4)})


_BANDS = {"l_quantity": (10.0, 40.0), "l_extendedprice": (0.0, 60000.0)}
_BAND_EDGES = " UNION ALL ".join(f"SELECT '{m}' AS metric, {a}::DOUBLE AS lo, {b}::DOUBLE AS hi" for m, (a, b) in _BANDS.items())


@query(f"""WITH {_hist_sql(8, _ROWS, _BAND_EDGES)}, h AS (SELECT metric, bin, coalesce(count, 0)::BIGINT AS count FROM g LEFT JOIN k USING (metric, bin))
SELECT metric, bin, count, (sum(count) OVER (PARTITION BY metric))::BIGINT AS in_band, round((sum(count) OVER (PARTITION BY metric)) / 8, 4) AS expected, count < 0.9 * (sum(count) OVER (PARTITION BY metric)) / 8 AS under FROM h""")
def underrepresented_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = postprocess.unpivot(corpus(spark, sf_dir), ["ds"], NUMERIC, "metric")
    return coverage.underrepresented_bins(rows, 8, _BANDS, 0.9).withColumn("expected", r("expected", 4))


@query("SELECT n_classes, round(least(0.95, greatest(0.95 - CASE WHEN n_classes <= 8 THEN 0 WHEN n_classes <= 16 THEN 0.05 WHEN n_classes <= 24 THEN 0.10 ELSE 0.15 END, 0.80))::DOUBLE, 6) AS threshold FROM (SELECT n_nationkey + 2 AS n_classes FROM nation)")
def threshold_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 2).alias("n_classes"))
    return n.select("n_classes", r(gates.effective_threshold(F.lit(0.95), F.col("n_classes"))).alias("threshold"))


_RATE = "(SELECT l_linestatus AS preset, l_returnflag AS metric, avg(l_extendedprice) AS value FROM lineitem WHERE l_suppkey % 2 = {k} GROUP BY ALL)"


@query(f"""WITH x AS (SELECT c.preset, c.metric, c.value AS current, b.value * 1.15 AS baseline FROM {_RATE.format(k=0)} c JOIN {_RATE.format(k=1)} b USING (preset, metric)),
d AS (SELECT *, greatest(0.0, 100 * (baseline - current) / abs(baseline)) AS p FROM x)
SELECT preset, metric, round(current, 4) AS current, round(baseline, 4) AS baseline, round(p, 4) AS degradation_pct, CASE WHEN p >= 20 THEN 'fail' WHEN p >= 10 THEN 'warn' ELSE 'pass' END AS severity FROM d""")
def regression_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 2).alias("k"), F.col("l_linestatus").alias("preset"), F.col("l_returnflag").alias("metric"), "l_extendedprice")
    per = l.groupBy("k", "preset", "metric").agg(F.avg("l_extendedprice").alias("value"))
    out = gates.regression_gate(per.where("k = 0"), per.where("k = 1").withColumn("value", F.col("value") * 1.15))
    return out.select("preset", "metric", *[r(c, 4).alias(c) for c in ("current", "baseline", "degradation_pct")], "severity")


def _summaries(k: int) -> str:
    return f"(SELECT metric, avg(value) AS mean, quantile_cont(value, 0.25) AS p25, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.75) AS p75 FROM {_METRICS} WHERE ds % 2 = {k} GROUP BY metric)"


_SHIFTS = f"SELECT b.metric, 100 * (0.6 * abs(v.mean - b.mean) + 0.4 * abs(v.p50 - b.p50)) / greatest(abs(b.mean), b.p75 - b.p25, 1e-6) AS shift_pct FROM {_summaries(0)} b JOIN {_summaries(1)} v USING (metric)"


@query(f"SELECT metric, round(shift_pct, 5) AS shift_pct FROM ({_SHIFTS})")
def diversity_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = metric_rows(spark, sf_dir)
    sides = [coverage.coverage_summary(m.where(F.col("ds") % 2 == k)) for k in (0, 1)]
    return coverage.diversity_shift(*sides).withColumn("shift_pct", r("shift_pct", 5))


@query(f"SELECT round(median(shift_pct), 5) AS composite, CASE WHEN median(shift_pct) >= 5 THEN 'fail' WHEN median(shift_pct) >= 0.5 THEN 'warn' ELSE 'pass' END AS status FROM ({_SHIFTS})")
def diversity_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = metric_rows(spark, sf_dir)
    sides = [coverage.coverage_summary(m.where(F.col("ds") % 2 == k)) for k in (0, 1)]
    return coverage.diversity_status(coverage.diversity_shift(*sides), 0.5, 5).withColumn("composite", r("composite", 5))


@query("SELECT event_type, round(avg(value * 1000), 4) AS mean_ms, round(quantile_cont(value * 1000, 0.95), 4) AS p95_ms, round(min(value * 1000), 4) AS min_ms, round(max(value * 1000), 4) AS max_ms FROM events GROUP BY event_type")
def latency_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = gates.latency_summary(table(spark, sf_dir, "events"), "value", ["event_type"])
    return out.select("event_type", *[r(c, 4).alias(c) for c in ("mean_ms", "p95_ms", "min_ms", "max_ms")])


@query("SELECT CASE WHEN l_quantity < 5 THEN 'too_small' WHEN l_discount > 0.09 THEN 'discount' WHEN l_tax = 0 THEN 'untaxed' ELSE 'accepted' END AS reason, count(*) AS n FROM lineitem GROUP BY reason")
def manifest_reason_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    checks = [("too_small", F.col("l_quantity") < 5), ("discount", F.col("l_discount") > 0.09), ("untaxed", F.col("l_tax") == 0)]
    return gates.reason_counts(table(spark, sf_dir, "lineitem"), checks)


@query("SELECT l_returnflag AS g, count(*) AS datasets, sum(l_linenumber)::BIGINT AS attempts, (sum(l_linenumber) - count(*))::BIGINT AS retries, round((sum(l_linenumber) - count(*)) / sum(l_linenumber), 6) AS retry_rate FROM lineitem GROUP BY g")
def attempt_pressure(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("g"), F.col("l_linenumber").cast("long").alias("attempts"))
    return gates.attempt_pressure(runs, ["g"]).withColumn("retry_rate", r("retry_rate"))


@query("SELECT c_nationkey, c_custkey AS best, c_acctbal FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC NULLS LAST, c_custkey) AS n FROM customer) WHERE n = 1")
def best_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.best_candidate(table(spark, sf_dir, "customer"), ["c_nationkey"], "c_acctbal", "c_custkey")


@query("""WITH h AS (SELECT o_orderstatus, md5(concat_ws('|', o_orderkey::VARCHAR, o_custkey::VARCHAR, coalesce(o_orderpriority, '~'))) AS h FROM orders)
SELECT o_orderstatus, count(*) AS n, md5(concat_ws('|', sum(('0x' || substr(h, 1, 8))::BIGINT)::VARCHAR, sum(('0x' || substr(h, 9, 8))::BIGINT)::VARCHAR)) AS digest FROM h GROUP BY o_orderstatus""")
def reproducibility_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.digest(table(spark, sf_dir, "orders"), ["o_orderkey", "o_custkey", "o_orderpriority"], ["o_orderstatus"])


@query("""SELECT axis, round(avg(v) FILTER (variant = 'control'), 5) AS control, round(avg(v) FILTER (variant = 'shifted'), 5) AS shifted, count(v) FILTER (variant = 'shifted') AS n,
CASE WHEN count(v) FILTER (variant = 'shifted') < 5 THEN 'insufficient' WHEN avg(v) FILTER (variant = 'shifted') > avg(v) FILTER (variant = 'control') THEN 'pass' ELSE 'fail' END AS status
FROM (UNPIVOT (SELECT CASE WHEN p_size > 25 THEN 'shifted' ELSE 'control' END AS variant, p_size::DOUBLE AS p_size, p_retailprice FROM part) ON p_size, p_retailprice INTO NAME axis VALUE v) GROUP BY axis""")
def shift_guardrail(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.when(F.col("p_size") > 25, "shifted").otherwise("control").alias("variant"), F.col("p_size").cast("double").alias("p_size"), "p_retailprice")
    out = gates.shift_guardrail(p, ["p_size", "p_retailprice"])
    return out.withColumns({"control": r("control", 5), "shifted": r("shifted", 5)})


# ---- graphs and plans

_EDGE = f"(SELECT a.n_nationkey AS src, b.n_nationkey AS dst FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey WHERE {uniform_sql(17, 'edge', 'a.n_nationkey', 'b.n_nationkey')} < 0.25)"


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.bernoulli_edges(table(spark, sf_dir, "nation"), "n_nationkey", 0.25, 17)


@query(f"SELECT src, dst FROM {_EDGE}")
def dag_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, sf_dir)


def _cauchy_sql(path: str, *key: str) -> str:
    return f"tan(pi() * ({uniform_sql(19, path, *key)} - 0.5))"


@query(f"""WITH n AS (SELECT n_regionkey AS g, n_nationkey AS k FROM nation),
e AS (SELECT a.g, a.k AS src, b.k AS dst, {_cauchy_sql("graph", "a.g")} + {_cauchy_sql("from", "a.g", "a.k")} + {_cauchy_sql("to", "a.g", "b.k")} + 0.7 AS z, {uniform_sql(19, "edge", "a.g", "a.k", "b.k")} AS u
  FROM n a JOIN n b ON a.g = b.g AND a.k < b.k)
SELECT g, src, dst FROM e WHERE u < 1 / (1 + exp(-greatest(-60.0, least(60.0, z))))""")
def dag_cauchy_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("g"), F.col("n_nationkey").alias("k"))
    return graphs.cauchy_edges(nodes, "k", ["g"], 0.7, 19)


@query(f"SELECT count(*) AS n_edges, round(count(*) / 300, 6) AS density FROM {_EDGE}")
def dag_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.density(_edges(spark, sf_dir), 25).withColumn("density", r("density"))


@query(f"WITH RECURSIVE p AS (SELECT n_nationkey AS node, 1 AS depth FROM nation UNION SELECT e.dst, p.depth + 1 FROM p JOIN {_EDGE} e ON e.src = p.node) SELECT node, max(depth)::INTEGER AS depth FROM p GROUP BY node")
def dag_longest_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.depths(_edges(spark, sf_dir), table(spark, sf_dir, "nation"), "n_nationkey")


_LOGITS = " UNION ALL ".join(f"SELECT '{f}' AS family, {x} AS l" for f, x in FAMILY_LOGITS.items() if f != "piecewise")


@query(f"WITH t AS ({_LOGITS}), w AS (SELECT family, exp(0.5 * (l - avg(l) OVER ())) AS w FROM t) SELECT family, round(w / sum(w) OVER (), 6) AS p FROM w")
def family_probabilities_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(f, float(p)) for f, p in family_probabilities(0.5).items()]
    return spark.createDataFrame(rows, "family string, p double").withColumn("p", r("p"))


# ---- packed storage


@query("SELECT o_orderkey // 128 AS shard, count(*) AS n, min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM orders GROUP BY shard")
def shard_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy(packed.shard_of(F.col("o_orderkey"), 128).alias("shard")).agg(F.count("*").alias("n"), F.min("o_orderkey").alias("lo"), F.max("o_orderkey").alias("hi"))


@query("SELECT o_orderkey, (coalesce(sum(length(o_orderpriority)) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS \"offset\" FROM orders")
def byte_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumn("size", F.length("o_orderpriority"))
    return packed.byte_offsets(o, "size", ["o_orderstatus"], ["o_orderkey"]).select("o_orderkey", "offset")


@query("SELECT g, count(*) AS n, min(i) = 0 AND max(i) = count(*) - 1 AND count(DISTINCT i) = count(*) AS contiguous FROM (SELECT conv_id % 5 AS g, conv_id, turn AS i FROM conversations UNION ALL SELECT 100 + vec_id % 2, vec_id, vec_id // 2 FROM embeddings) GROUP BY g")
def contiguity_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select((F.col("conv_id") % 5).alias("g"), F.col("turn").alias("i"))
    e = table(spark, sf_dir, "embeddings").select((100 + F.col("vec_id") % 2).alias("g"), F.floor(F.col("vec_id") / 2).alias("i"))
    return packed.contiguity(c.union(e), ["g"], "i")


@query("SELECT in_left, in_right, count(*) AS n FROM (SELECT o_orderkey IS NOT NULL AS in_left, l_orderkey IS NOT NULL AS in_right FROM orders FULL JOIN (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_quantity > 10) ON o_orderkey = l_orderkey) GROUP BY ALL")
def merge_join_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"))
    l = table(spark, sf_dir, "lineitem").where("l_quantity > 10").select(F.col("l_orderkey").alias("key"))
    return packed.merge_coverage(o, l, "key").groupBy("in_left", "in_right").agg(F.count("*").alias("n"))


@query("SELECT l_returnflag, count(*) AS n, round(sum(l_extendedprice), 2) AS total FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY l_returnflag")
def curated_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, sf_dir, "lineitem").join(ok, "l_orderkey", "left_semi").groupBy("l_returnflag").agg(F.count("*").alias("n"), r(F.sum("l_extendedprice"), 2).alias("total"))


@query("SELECT vec_id, len(embedding)::INTEGER AS width, round(embedding[1]::DOUBLE, 6) AS first, round(embedding[64]::DOUBLE, 6) AS last FROM embeddings")
def packed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("x")
    again = packed.pack_cells(packed.unpack_cells(x64(spark, sf_dir).select("vec_id", "x"), ["vec_id"]), ["vec_id"])
    return again.select("vec_id", F.size(x).alias("width"), r(x[0]).alias("first"), r(x[63]).alias("last"))


# ---- streams


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type AS metric, count(value) AS count, round(avg(value), 5) AS mean, round(stddev_pop(value), 5) AS std, round(min(value), 5) AS min, round(max(value), 5) AS max FROM events GROUP BY ALL")
def windowed_event_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = windowed_coverage(table(spark, sf_dir, "events"), "ts", "event_type", "value")
    return out.withColumns({c: r(c, 5) for c in ("mean", "std", "min", "max")})


# ---- set operations, reshapes, ordered groups


@query("SELECT split, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM (SELECT 'train' AS split, o_totalprice FROM orders WHERE o_orderkey % 4 > 0 UNION ALL SELECT 'test', o_totalprice FROM orders WHERE o_orderkey % 4 = 0) GROUP BY split")
def union_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    both = reshape.union_splits(o.where("o_orderkey % 4 > 0"), o.where("o_orderkey % 4 = 0"))
    return both.groupBy("split").agg(F.count("*").alias("n"), r(F.sum("o_totalprice"), 2).alias("total"))


@query(f"WITH {_SPLIT} SELECT vec_id, is_train, round(x[1], 6) AS first, round(list_sum(x), 5) AS total FROM s JOIN {X} USING (vec_id)")
def split_gather(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = postprocess.stratified_split(table(spark, sf_dir, "embeddings").select("vec_id", "label"), "label", 0.7, 5, "vec_id").drop("label")
    return reshape.gather(x64(spark, sf_dir), where, "vec_id").select("vec_id", "is_train", r(F.col("x")[0]).alias("first"), r(F.aggregate("x", F.lit(0.0), lambda a, b: a + b), 5).alias("total"))


@query(f"SELECT vec_id, len(x || y)::INTEGER AS width, round(list_sum(x || y), 5) AS total FROM {X} JOIN (SELECT o_orderkey AS vec_id, [o_totalprice / 1000] AS y FROM orders) USING (vec_id)")
def parent_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("vec_id"), F.array(F.col("o_totalprice") / 1000).alias("x"))
    x = F.col("x")
    return reshape.concat_parents([x64(spark, sf_dir), o], "vec_id", "x").select("vec_id", F.size(x).alias("width"), r(F.aggregate(x, F.lit(0.0), lambda a, b: a + b), 5).alias("total"))


@query("SELECT user_id, array_to_string(list_sort(list_filter(['click', 'purchase', 'view'], lambda k: NOT list_contains(ks, k))), ',') AS missing, array_to_string(list_sort(list_filter(ks, lambda k: NOT list_contains(['click', 'purchase', 'view', 'signup'], k))), ',') AS unknown FROM (SELECT user_id, list(DISTINCT event_type) AS ks FROM events GROUP BY user_id)")
def key_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("ks"))  # types are few
    missing, unknown = reshape.key_differences(F.col("ks"), ["click", "purchase", "view"], ["signup"])
    return seen.select("user_id", F.array_join(missing, ",").alias("missing"), F.array_join(unknown, ",").alias("unknown"))


@query("SELECT threshold FROM (SELECT round(l_discount, 2) AS threshold FROM lineitem UNION SELECT 0.95 UNION SELECT round(l_tax, 2) FROM lineitem)")
def threshold_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")
    own = [l.select(F.round(c, 2).alias("threshold")) for c in ("l_discount", "l_tax")]
    return reshape.union_distinct([*own, spark.range(1).select(F.lit(0.95).alias("threshold"))])


@query("SELECT p_partkey, p_size::DOUBLE AS size, round(p_retailprice, 4) AS price, NULL::DOUBLE AS beyond FROM part")
def stack_unstack(spark: SparkSession, sf_dir: str) -> DataFrame:
    stacked = reshape.stack(table(spark, sf_dir, "part"), ["p_partkey"], ["p_size", "p_retailprice"])
    return reshape.unstack(stacked, ["p_partkey"], "x", ["size", "price", "beyond"]).withColumn("price", r("price", 4))


@query("SELECT l_returnflag, (l_returnflag = 'A')::INTEGER::DOUBLE AS a, (l_returnflag = 'N')::INTEGER::DOUBLE AS n, (l_returnflag = 'R')::INTEGER::DOUBLE AS r, count(*) AS rows FROM lineitem GROUP BY ALL")
def one_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem").withColumn("x", reshape.one_hot(F.col("l_returnflag"), ["A", "N", "R"]))
    return l.groupBy("l_returnflag", *[F.col("x")[i].alias(c) for i, c in enumerate("anr")]).agg(F.count("*").alias("rows"))


@query("""WITH s AS (SELECT *, event_type IS DISTINCT FROM lag(event_type) OVER w OR row_number() OVER w = 1 AS starts FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, starts, (sum(starts::INTEGER) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))::BIGINT AS run FROM s""")
def group_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshape.group_starts(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_type").select("event_id", "starts", "run")


_MAP = [5, 0, 3, 7]


@query(f"SELECT vec_id, {', '.join(f'round(x[{i + 1}], 6) AS f{k}' for k, i in enumerate(_MAP))} FROM {X}")
def feature_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = reshape.project_features("x", _MAP)
    return x64(spark, sf_dir).select("vec_id", *[r(x[k]).alias(f"f{k}") for k in range(len(_MAP))])


@query("SELECT o_custkey, count(*) AS n FROM orders WHERE o_custkey IN (SELECT DISTINCT o_custkey FROM orders ORDER BY o_custkey LIMIT 20) GROUP BY o_custkey")
def first_datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshape.first_datasets(table(spark, sf_dir, "orders").select("o_custkey"), 20, "o_custkey").groupBy("o_custkey").agg(F.count("*").alias("n"))


@query("SELECT event_id, CASE WHEN event_id % 5 < 2 THEN NULL ELSE value END AS value FROM events")
def finite_coercion(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 5
    odd = F.when(k == 0, float("nan")).when(k == 1, float("-inf")).otherwise(F.col("value"))
    return table(spark, sf_dir, "events").select("event_id", act.finite_or_null(odd).alias("value"))


# ---- draws and activations

_Q_ACT = f"exp(ln(10::DOUBLE) * {uniform_sql(23, 'stretch', 'g')})"


@query(f"""WITH c AS (SELECT c_custkey, c_nationkey AS g, c_acctbal AS v FROM customer),
s AS (SELECT g, avg(v) AS m, greatest(stddev_pop(v), 1e-6) AS s, arg_min(v, ({uniform_sql(23, 'shift', 'c_custkey')}, c_custkey)) AS b FROM c GROUP BY g),
y AS (SELECT c_custkey, g, tanh({_Q_ACT} * (v - b) / s) AS y FROM c JOIN s USING (g)), t AS (SELECT g, avg(y) AS m, greatest(stddev_pop(y), 1e-6) AS s FROM y GROUP BY g)
SELECT c_custkey, round((y - m) / s, 5) AS y FROM y JOIN t USING (g)""")
def random_activation(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("g"), F.col("c_acctbal").alias("y"))
    return postprocess.random_activation(c, "y", act.SCALAR["tanh"], 23, "c_custkey", group=["g"]).select("c_custkey", r("y", 5).alias("y"))


def _normal_sql(path: str) -> str:
    return f"sqrt(-2 * ln(greatest({uniform_sql(29, path + '/r', 'o_orderkey')}, pow(2::DOUBLE, -33)))) * cos(2 * pi() * {uniform_sql(29, path + '/t', 'o_orderkey')})"


_U_FAM, _U_LAP = uniform_sql(29, "noise/family", "o_orderkey"), f"greatest(1e-7, least(1 - 1e-7, {uniform_sql(29, 'noise/laplace', 'o_orderkey')}))"
_CHI = " + ".join(f"pow({_normal_sql(f'noise/student/{i}')}, 2)" for i in range(3))


@query(f"""SELECT o_orderkey, round(CASE WHEN {_U_FAM} < 0.5 THEN {_normal_sql('noise/normal')} WHEN {_U_FAM} < 0.75 THEN CASE WHEN {_U_LAP} < 0.5 THEN ln(2 * {_U_LAP}) ELSE -ln(2 * (1 - {_U_LAP})) END
ELSE {_normal_sql('noise/student')} / sqrt(({_CHI}) / 3) END, 5) AS noise FROM orders""")
def mixture_noise_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    noise = mixture_noise(29, "noise", {"gaussian": 2, "laplace": 1, "student_t": 1}, 3, "o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", r(noise, 5).alias("noise"))


@query(f"SELECT ds, CASE WHEN {uniform_sql(31, 'noise family', 'ds')} < 0.6 THEN 'gaussian' ELSE 'laplace' END AS family, count(*) AS n FROM {CORPUS} GROUP BY ds")
def dataset_noise_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = corpus(spark, sf_dir).groupBy("ds").agg(F.count("*").alias("n"))
    return per.withColumn("family", component(uniform(31, "noise family", "ds"), {"gaussian": 3, "laplace": 2}))


@query("SELECT name, round(w / sum(w) OVER (), 9) AS share FROM (VALUES ('a', 2.0::DOUBLE), ('b', 0), ('c', 6), ('d', -1), ('e', 0.5)) t(name, w) WHERE w > 0")
def normalized_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = list(normalize_weights({"a": 2, "b": 0, "c": 6, "d": -1, "e": 0.5}).items())
    return spark.createDataFrame(rows, "name string, share double").withColumn("share", r("share", 9))


@query(f"""WITH e AS (SELECT vec_id, unnest(list_transform(x, lambda v: exp(v - list_max(x)))) AS w, unnest(range({DIMS})) AS i FROM {X}),
c AS (SELECT vec_id, sum(w) OVER (PARTITION BY vec_id ORDER BY i) / sum(w) OVER (PARTITION BY vec_id) AS upto FROM e)
SELECT vec_id, least({DIMS - 1}, count(*) FILTER (upto <= {uniform_sql(37, 'softmax label', 'vec_id')}))::INTEGER AS code FROM c GROUP BY vec_id""")
def softmax_converter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return x64(spark, sf_dir).select("vec_id", vec.sampled_label(F.col("x"), uniform(37, "softmax label", "vec_id")).alias("code"))


# ---- guardrails over metadata


_META = """(SELECT event_type AS g, event_id % 13 > 0 AS present, CASE event_id % 17 WHEN 0 THEN NULL WHEN 1 THEN 'laplace' ELSE ' Mixture' END AS fr, CASE event_id % 19 WHEN 0 THEN 'cauchy' ELSE 'gaussian' END AS fs,
CASE WHEN event_id % 23 = 0 THEN -1.0 ELSE 0.5 END AS scale, CASE WHEN event_id % 29 = 0 THEN 2.0 ELSE 5.0 END AS df, CASE WHEN event_id % 31 = 0 THEN 0.9 ELSE 0.5 END AS w FROM events)"""
_WHY = "CASE WHEN fr IS NULL THEN 'family_requested_type' WHEN lower(trim(fr)) <> 'mixture' THEN 'family_requested_mismatch' WHEN scale <= 0 THEN 'base_scale_value' WHEN df <= 2 THEN 'student_t_df_value' WHEN fs = 'cauchy' THEN 'family_sampled_invalid_for_mixture' WHEN w > 0.5 THEN 'mixture_weights_total_not_one' END"


def noise_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as noise metadata, some of it absent or wrong."""
    k = lambda m: F.col("event_id") % m
    weights = F.create_map(F.lit("gaussian"), F.when(k(31) == 0, 0.9).otherwise(0.5), F.lit("laplace"), F.lit(0.5))
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("g"), (k(13) > 0).alias("present"), F.when(k(17) == 0, None).when(k(17) == 1, "laplace").otherwise(" Mixture").alias("family_requested"), F.when(k(19) == 0, "cauchy").otherwise("gaussian").alias("family_sampled"),
        F.lit("dataset_level").alias("sampling_strategy"), F.when(k(23) == 0, -1.0).otherwise(0.5).alias("base_scale"), F.when(k(29) == 0, 2.0).otherwise(5.0).alias("student_t_df"), weights.alias("mixture_weights"),
    )


@query(f"""SELECT g, n, n_present, n_valid, round(n_present / n, 6) AS coverage, round(n_valid / n, 6) AS validity, CASE WHEN n_valid = n THEN 'pass' ELSE 'fail' END AS status
FROM (SELECT g, count(*) AS n, count(*) FILTER (present) AS n_present, count(*) FILTER (present AND ({_WHY}) IS NULL) AS n_valid FROM {_META} GROUP BY g)""")
def noise_guardrail(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = gates.noise_guardrail(noise_meta(spark, sf_dir), "mixture", ["g"])
    return out.withColumns({"coverage": r("coverage"), "validity": r("validity")})


@query(f"SELECT {_WHY} AS reason, count(*) AS n FROM {_META} WHERE present AND ({_WHY}) IS NOT NULL GROUP BY reason")
def noise_reason_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    why = noise_meta(spark, sf_dir).where("present").select(gates.noise_reason("mixture").alias("reason"))
    return why.where("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("n"))


@query("""WITH t AS (SELECT o_orderpriority AS g, o_orderkey % 2 = 0 AS ours, o_totalprice AS v, o_orderstatus <> 'P' OR o_orderpriority <> '1-URGENT' AS has FROM orders),
m AS (SELECT g, count(*) FILTER (ours) AS sample, count(*) FILTER (ours AND has) / nullif(count(*) FILTER (ours), 0) AS coverage, coalesce(median(v) FILTER (NOT ours), 0) AS baseline, coalesce(median(v) FILTER (ours), 0) AS current FROM t GROUP BY g),
d AS (SELECT *, greatest(0.0, 100 * (baseline - current) / nullif(baseline, 0)) AS p FROM m)
SELECT g, sample, round(coverage, 6) AS coverage, round(baseline, 4) AS baseline, round(current, 4) AS current, round(p, 4) AS degradation_pct,
CASE WHEN coverage < 1 THEN 'fail' WHEN sample >= 30 AND p >= 2 THEN 'fail' WHEN sample >= 30 AND p >= 1 THEN 'warn' ELSE 'pass' END AS status FROM d""")
def lineage_guardrail(spark: SparkSession, sf_dir: str) -> DataFrame:
    has = (F.col("o_orderstatus") != "P") | (F.col("o_orderpriority") != "1-URGENT")
    kind = F.when(F.col("o_orderkey") % 2 == 0, "lineage").otherwise("baseline")
    trials = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("g"), kind.alias("kind"), F.col("o_totalprice").alias("per_minute"), has.alias("has_lineage"))
    out = gates.lineage_guardrail(trials, ["g"], 30, 1, 2)
    return out.withColumns({"coverage": r("coverage")} | {c: r(c, 4) for c in ("baseline", "current", "degradation_pct")})


@query("SELECT c_nationkey, arg_max(cells, (coalesce(rate, '-Infinity'::DOUBLE), -cells)) AS best, max(rate) AS rate FROM (SELECT c_nationkey, c_custkey % 7 AS cells, CASE WHEN c_custkey % 11 > 0 THEN round(c_acctbal / 1000, 0) END AS rate FROM customer) GROUP BY c_nationkey")
def target_cells_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_nationkey", (F.col("c_custkey") % 7).alias("cells"), F.when(F.col("c_custkey") % 11 > 0, F.round(F.col("c_acctbal") / 1000, 0)).alias("rate"))
    return gates.sweep_best(c, ["c_nationkey"], "cells", "rate")


@query(f"""WITH x AS (SELECT c.preset, c.metric, c.value AS current, b.value * 1.15 AS baseline FROM {_RATE.format(k=0)} c JOIN {_RATE.format(k=1)} b USING (preset, metric)),
d AS (SELECT preset, metric, greatest(0.0, 100 * (baseline - current) / abs(baseline)) AS p FROM x), s AS (SELECT *, CASE WHEN p >= 14 THEN 'fail' WHEN p >= 12 THEN 'warn' ELSE 'pass' END AS severity FROM d)
SELECT preset, metric, severity, row_number() OVER (ORDER BY CASE severity WHEN 'fail' THEN 0 WHEN 'warn' THEN 1 ELSE 2 END, p DESC, preset, metric)::INTEGER AS place FROM s""")
def issue_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 2).alias("k"), F.col("l_linestatus").alias("preset"), F.col("l_returnflag").alias("metric"), "l_extendedprice")
    per = l.groupBy("k", "preset", "metric").agg(F.avg("l_extendedprice").alias("value"))
    issues = gates.regression_gate(per.where("k = 0"), per.where("k = 1").withColumn("value", F.col("value") * 1.15), 12, 14)
    return gates.issue_ranks(issues).select("preset", "metric", "severity", "place")


@query("SELECT event_type, count(*) AS attempts, count(*) FILTER (value > 20) AS accepted, round(avg(value) FILTER (event_id % 9 > 0), 5) AS wins_ratio_mean, count(*) - count(*) FILTER (value > 20) AS rejected, round(count(*) FILTER (value > 20) / count(*), 6) AS accepted_fraction FROM events GROUP BY event_type")
def filter_yield(spark: SparkSession, sf_dir: str) -> DataFrame:
    wins = F.when(F.col("event_id") % 9 == 0, float("nan")).otherwise(F.col("value"))
    v = table(spark, sf_dir, "events").select("event_type", (F.col("value") > 20).alias("accepted"), wins.alias("wins_ratio"))
    return gates.filter_yield(v, ["event_type"], ["wins_ratio"]).withColumns({"wins_ratio_mean": r("wins_ratio_mean", 5), "accepted_fraction": r("accepted_fraction")})


@query(f"""WITH v AS (SELECT CASE WHEN o_orderkey % 11 > 0 THEN 0.75 + 0.25 * {uniform_sql(9, 'wins', 'o_orderkey')} END AS wins, CASE WHEN o_custkey % 32 < 8 THEN 0 WHEN o_custkey % 32 < 16 THEN 0.05 WHEN o_custkey % 32 < 24 THEN 0.10 ELSE 0.15 END AS relax FROM orders),
s AS (SELECT wins, least(t, greatest(t - relax, 0.80))::DOUBLE AS lim, t::DOUBLE AS threshold FROM v, (SELECT unnest([0.80, 0.85, 0.90, 0.95, 0.99]) AS t))
SELECT threshold, count(*) AS n, count(*) FILTER (wins >= lim) AS accepted, round(count(*) FILTER (wins >= lim) / count(*), 6) AS acceptance_rate FROM s GROUP BY threshold""")
def filter_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    wins = F.when(F.col("o_orderkey") % 11 > 0, 0.75 + 0.25 * uniform(9, "wins", "o_orderkey"))
    v = table(spark, sf_dir, "orders").select(wins.alias("wins_ratio"), gates.effective_threshold(F.lit(0.95), F.col("o_custkey") % 32 + 1).alias("threshold"))
    swept = gates.calibrate_filter(v, (0.80, 0.85, 0.90, 0.95, 0.99), 0.95)
    return swept.select("threshold", "n", "accepted", r("acceptance_rate").alias("acceptance_rate"))


# ---- generated corpora and judged datasets: no SQL says these


def small_config(task: str = "classification") -> Config:
    return Config.from_dict({"seed": 7, "dataset": {"task": task, "n_train": 256, "n_test": 128, "n_features_min": 8, "n_features_max": 16, "n_classes_max": 5}, "graph": {"n_nodes_max": 8}})


@query()
def generate_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = generate.generate_corpus(spark, small_config(), 25)
    return rows


@query()
def generate_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = generate.generate_corpus(spark, small_config(), 25)
    return metrics.profile_datasets(rows, "classification", 7, spearman=True, forest=True)


def judged_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as packed rows of datasets of about 250."""
    e = x64(spark, sf_dir)
    split = F.when(uniform(5, "split", "vec_id") < 0.7, "train").otherwise("test")
    return e.select(F.floor(F.col("vec_id") / 250).cast("long").alias("dataset_index"), split.alias("split"), F.col("vec_id").alias("row_index"), F.col("x").cast("array<float>").alias("x"), F.col("label").cast(T.DoubleType()).alias("y"))


@query()
def extra_trees_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extra_trees.filter_datasets(judged_rows(spark, sf_dir), "classification", 3)


@query()
def ridge_linearity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.profile_datasets(judged_rows(spark, sf_dir), "classification", 3).where("metric IN ('linearity_proxy', 'snr_proxy_db')")


@query("""SELECT floor(vec_id / 250)::BIGINT AS dataset_index, split, count(*) AS n, (64 * count(*))::BIGINT AS n_cells, true AS near_rate
FROM (SELECT vec_id, CASE WHEN """ + uniform_sql(5, "split", "vec_id") + """ < 0.7 THEN 'train' ELSE 'test' END AS split FROM embeddings) GROUP BY ALL""")
def inject_missing_mar(spark: SparkSession, sf_dir: str) -> DataFrame:
    hidden = postprocess.inject_missing(judged_rows(spark, sf_dir), "mar", 0.2, 3)
    gone = F.size(F.filter("x", lambda v: F.isnan(v)))
    out = hidden.groupBy("dataset_index", "split").agg(F.count("*").alias("n"), F.sum(F.size("x")).cast("long").alias("n_cells"), F.sum(gone).alias("n_missing"))
    # The draws differ from engine to engine, their share does not.
    return out.select("dataset_index", "split", "n", "n_cells", (F.abs(F.col("n_missing") / F.col("n_cells") - 0.2) < 0.03).alias("near_rate"))


_RANGE = "(SELECT unnest(range(25)) AS dataset_index) CROSS JOIN (VALUES ('train', 256), ('test', 128)) AS s(split, n)"


@query(f"SELECT dataset_index, split, n::BIGINT AS n, true AS several_classes, 0::BIGINT AS n_features_made FROM {_RANGE}")
def label_only_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = generate.generate_corpus(spark, small_config(), 25, labels_only=True)
    return rows.groupBy("dataset_index", "split").agg(F.count("*").alias("n"), (F.count_distinct("y") > 1).alias("several_classes"), F.count("x").alias("n_features_made"))


def _small_layout() -> Layout:
    return sample_layout(small_config(), SeedPath(7))


@query(f"""SELECT dataset_index, split, n::BIGINT AS n, 0::BIGINT AS first_row, (n - 1)::BIGINT AS last_row, n::BIGINT AS n_distinct, {_small_layout().n_features} AS least_width, {_small_layout().n_features} AS most_width, true AS finite
FROM {_RANGE}""")
def corpus_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What holds for each split of a generated corpus: rows numbered without gap, of one width, all finite."""
    rows, _ = generate.generate_corpus(spark, small_config(), 25)
    i, odd = F.col("row_index"), F.exists("x", lambda v: F.isnan(v) | (F.abs(v) == float("inf")))
    per = rows.groupBy("dataset_index", "split")
    return per.agg(F.count("*").alias("n"), F.min(i).alias("first_row"), F.max(i).alias("last_row"), F.count_distinct(i).alias("n_distinct"), F.min(F.size("x")).alias("least_width"), F.max(F.size("x")).alias("most_width"), (~F.bool_or(odd)).alias("finite"))


def _small_plan() -> list[tuple]:
    return plan_rows(sample_plan(small_config(), _small_layout(), SeedPath(7)))


@query("SELECT family, variant, count(*) AS n, count(*) FILTER (depth > 0) AS nested FROM (VALUES " + ", ".join(f"('{f}', {'NULL' if v is None else repr(v)}, {d})" for f, v, d in _small_plan()) + ") AS p(family, variant, depth) GROUP BY family, variant")
def plan_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = spark.createDataFrame(_small_plan(), "family string, variant string, depth int")
    return plan.groupBy("family", "variant").agg(F.count("*").alias("n"), F.count(F.when(F.col("depth") > 0, 1)).alias("nested"))


@query(f"""WITH g AS (SELECT {_small_layout().n_nodes} AS n_nodes, {len(_small_layout().edges)} AS n_edges),
b AS (SELECT unnest(range(25)) AS dataset_index, *, ceil(n_nodes * (n_nodes - 1) / 16)::INTEGER AS size FROM g)
SELECT dataset_index, n_nodes, n_edges, floor(dataset_index / 8)::BIGINT AS shard, size, ((dataset_index % 8) * size)::BIGINT AS "offset" FROM b""")
def lineage_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, meta = generate.generate_corpus(spark, small_config(), 25)
    return audit.lineage(meta, 8).select("dataset_index", "n_nodes", "n_edges", "shard", "size", "offset")


@query("SELECT kind, 40 AS n_rows, 1.0::DOUBLE AS least, 1.0::DOUBLE AS most FROM (VALUES ('gaussian'), ('weights'), ('singular_values'), ('kernel'), ('activation')) AS m(kind)")
def matrix_row_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each kind of random matrix has rows of length one; one matrix a kind, made on the executors."""
    kinds = spark.createDataFrame([(k,) for k in kernels.MATRICES], "kind string")

    def run(batches):
        for batch in batches:
            for kind in batch.column(0).to_pylist():
                m = kernels.random_matrix((SeedPath(7) / "matrix" / kind).generator(), 40, 9, kind)
                yield pa.RecordBatch.from_arrays([pa.array([kind] * 40), pa.array(np.linalg.norm(m, axis=1))], ["kind", "norm"])

    return kinds.mapInArrow(run, "kind string, norm double").groupBy("kind").agg(F.count("*").cast("int").alias("n_rows"), r(F.min("norm")).alias("least"), r(F.max("norm")).alias("most"))


_GUMBEL_SQL = "[" + ", ".join(uniform_sql(7, f"gumbel/{i}", "vec_id") for i in range(DIMS)) + "]"


@query(f"""WITH e AS (SELECT vec_id, unnest(range({DIMS}))::INTEGER AS i, unnest(x) AS v, unnest({_GUMBEL_SQL}) AS u FROM {X}),
z AS (SELECT vec_id, i, exp((v - ln(-ln(greatest(1e-9, least(1 - 1e-9, u))))) / 0.7) AS w FROM e)
SELECT vec_id, i, round(w / sum(w) OVER (PARTITION BY vec_id), 6) AS share FROM z""")
def gumbel_softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.array(*(uniform(7, f"gumbel/{i}", "vec_id") for i in range(DIMS)))
    shares = act.gumbel_softmax(F.col("x"), u, 0.7)
    return x64(spark, sf_dir).select("vec_id", F.posexplode(shares).alias("i", "share")).withColumn("share", r("share"))


_BROKEN = [
    ("schema_name", 2), ("schema_version", 3), ("graph.n_nodes", 5), ("graph.edge_count", 7), ("graph.adjacency_ref.encoding", 11), ("graph.adjacency_ref.blob_path", 13), ("graph.adjacency_ref.bit_offset", 17),
    ("graph.adjacency_ref.bit_length", 19), ("graph.adjacency_ref.sha256", 23), ("assignments.feature_to_node", 29), ("assignments.target_to_node", 31),
]


@query("SELECT problem, count(*) AS n FROM (SELECT CASE " + " ".join(f"WHEN o_orderkey % {m} = 1 THEN '{name}'" for name, m in _BROKEN) + " END AS problem FROM orders) GROUP BY problem")
def lineage_schema_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of graphs, each broken in the fields that its key picks: the first broken field is named."""
    off = {name: F.col("o_orderkey") % m == 1 for name, m in _BROKEN}
    n = F.when(off["graph.n_nodes"], 1).otherwise(6)
    ref = F.struct(
        F.when(off["graph.adjacency_ref.encoding"], "dense").otherwise(lineage.ENCODING).alias("encoding"), F.when(off["graph.adjacency_ref.blob_path"], "  ").otherwise("lineage/blobs").alias("blob_path"), F.lit("lineage/index").alias("index_path"),
        F.col("o_orderkey").alias("dataset_index"), F.when(off["graph.adjacency_ref.bit_offset"], 12).otherwise(16).cast("long").alias("bit_offset"), F.when(off["graph.adjacency_ref.bit_length"], 14).otherwise(n * (n - 1) / 2).cast("long").alias("bit_length"),
        F.when(off["graph.adjacency_ref.sha256"], "abc").otherwise(F.sha2(F.col("o_orderkey").cast("string"), 256)).alias("sha256"),
    )
    graph = F.struct(n.alias("n_nodes"), F.lit(None).cast("array<array<int>>").alias("adjacency"), F.when(off["graph.edge_count"], 16).otherwise(5).cast("long").alias("edge_count"), ref.alias("adjacency_ref"))
    nodes = F.struct(F.array(F.lit(0), F.when(off["assignments.feature_to_node"], 6).otherwise(5)).alias("feature_to_node"), F.when(off["assignments.target_to_node"], -1).otherwise(2).alias("target_to_node"))
    record = F.struct(F.when(off["schema_name"], "other").otherwise(lineage.SCHEMA_NAME).alias("schema_name"), F.when(off["schema_version"], "2").otherwise(lineage.COMPACT).alias("schema_version"), graph.alias("graph"), nodes.alias("assignments"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", record.alias("record"))
    return rows.select(lineage.problem(F.col("record")).alias("problem")).groupBy("problem").agg(F.count("*").alias("n"))
