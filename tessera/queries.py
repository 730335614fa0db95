"""Queries over the driver's tables, one or more for each operator, and the SQL that says the same.

Tensors of the queries: ``events`` as a vector (idx event_id, v value), ``embeddings`` as a matrix (i vec_id, j place in the vector).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import scalar as S
from tessera.functions import text as X
from tessera.operators import balance, blocks, charlm, collectives, executors, linalg, maps, norms, optim, reduce
from tessera.operators.autograd import Node
from tessera.operators.tensor import Tensor
from tessera.plans import shards
from tessera.sources import generators, pqtd, readers, sinks, storage, zones
from tessera.streaming import heartbeats

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
DIM = 64


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def load(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def events(spark: SparkSession, d: str) -> Tensor:
    return readers.tensor_of(load(spark, d, "events"), "event_id", "value")


def cells(spark: SparkSession, d: str) -> DataFrame:
    """(i, j, v) of the embeddings, as double."""
    return load(spark, d, "embeddings").select(F.col("vec_id").alias("i"), F.posexplode("embedding").alias("j", "v")).select("i", F.col("j").cast("long").alias("j"), F.col("v").cast("double").alias("v"))


def matrix(spark: SparkSession, d: str) -> Tensor:
    """The embeddings as a tensor; vec_id is dense from 0."""
    emb = load(spark, d, "embeddings")
    return Tensor.of_cells(cells(spark, d), emb.count(), DIM)


CELLS = "SELECT vec_id AS i, (j - 1)::BIGINT AS j, embedding[j]::DOUBLE AS v FROM (SELECT *, unnest(range(1, 65)) AS j FROM embeddings)"
FLAT = f"SELECT i * 64 + j AS idx, v FROM ({CELLS})"


def rounded(df: DataFrame, *names: str, to: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, to) for n in names or ("v",)})


# -- corpus ---------------------------------------------------------------------------------------------------------------------------


@query("SELECT sum(coalesce(strlen(text), 0))::BIGINT AS total, max(coalesce(strlen(text), 0))::BIGINT AS longest, min(coalesce(strlen(text), 0))::BIGINT AS shortest, avg(coalesce(strlen(text), 0)) AS mean FROM documents")
def text_length_stats(spark, d):
    return reduce.length_statistics(load(spark, d, "documents").select(X.byte_length("text").alias("length")))


@query("SELECT sum(n * 0.5::DOUBLE + 1) AS total, avg(n) * 0.5::DOUBLE + 1 AS expected_mean, avg(n * 0.5::DOUBLE + 1) AS mean FROM (SELECT coalesce(strlen(text), 0) AS n FROM documents)")
def text_length_scale_shift(spark, d):
    n = readers.text_lengths(load(spark, d, "documents")).select(F.col("length").cast("double").alias("v"))
    moved = S.add(S.multiply(F.col("v"), 0.5), 1.0)
    return n.agg(F.sum(moved).alias("total"), (F.avg("v") * 0.5 + 1.0).alias("expected_mean"), F.avg(moved).alias("mean"))


@query("SELECT (coalesce(strlen(text), 0) // 100 * 100)::BIGINT AS bin, count(*) AS n FROM documents GROUP BY 1")
def text_length_histogram(spark, d):
    return reduce.length_histogram(load(spark, d, "documents").select(X.byte_length("text").alias("length")))


@query("SELECT sum(n)::BIGINT AS total, max(n)::BIGINT AS longest, min(n)::BIGINT AS shortest, avg(n) AS mean FROM (SELECT CASE WHEN coalesce(text, '') = '' THEN 0 ELSE len(string_split(text, ' ')) END AS n FROM documents)")
def token_count_stats(spark, d):
    return reduce.length_statistics(load(spark, d, "documents").select(X.token_count("text").alias("length")))


@query("SELECT doc_id, CASE WHEN length(t) > 100 THEN substr(t, 1, 100) || '...' ELSE t END AS preview FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents ORDER BY doc_id LIMIT 3)")
def text_samples(spark, d):
    return readers.text_samples(load(spark, d, "documents"), 3).select("doc_id", X.preview("text").alias("preview"))


@query("SELECT (SELECT count(*) FROM lineitem) AS n_rows, 11::BIGINT AS n_columns, 'l_orderkey,l_partkey,l_suppkey,l_linenumber,l_quantity,l_extendedprice,l_discount,l_tax,l_returnflag,l_linestatus,l_shipdate' AS names")
def parquet_file_info(spark, d):
    info = readers.file_info(spark, f"{d}/lineitem.parquet")
    return spark.createDataFrame([(info["rows"], info["columns"], ",".join(info["names"]))], "n_rows long, n_columns long, names string")


@query("SELECT (SELECT count(*) FROM part) AS n_rows, 3::BIGINT AS n_columns, 'p_partkey,p_size,p_retailprice' AS names")
def matrix_metadata(spark, d):
    info = readers.matrix_metadata(load(spark, d, "part"))
    return spark.createDataFrame([(info["rows"], info["columns"], ",".join(info["names"]))], "n_rows long, n_columns long, names string")


@query("SELECT coalesce(l_discount, 0) AS v FROM lineitem")
def typed_column_scan(spark, d):
    return readers.column(spark, f"{d}/lineitem.parquet", "l_discount", "double")


@query("SELECT coalesce(l_quantity, 0) AS v FROM lineitem WHERE l_quantity >= 25")
def row_filter_pushdown(spark, d):
    return readers.column(spark, f"{d}/lineitem.parquet", "l_quantity", "double", where=("l_quantity", "gte", 25.0))


@query("SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders")
def multi_column_scan(spark, d):
    return readers.columns(spark, f"{d}/orders.parquet", ["o_orderkey", "o_totalprice", "o_orderpriority"])


@query("SELECT p_partkey AS i, j, CASE j WHEN 0 THEN p_partkey::FLOAT WHEN 1 THEN p_size::FLOAT ELSE p_retailprice::FLOAT END::DOUBLE AS v FROM (SELECT *, unnest([0, 1, 2]) AS j FROM part)")
def numeric_matrix_long(spark, d):
    return readers.matrix(load(spark, d, "part"), "p_partkey").select("i", "j", F.col("v").cast("double").alias("v"))


@query("SELECT 'GeForce MX130' AS name, 'geforce mx130' AS device, true AS holds UNION ALL SELECT 'CUDA: GeForce MX130/PCIe (0)', 'geforce mx130', true UNION ALL SELECT 'OpenCL: Intel(R) UHD', 'intel', false")
def device_names(spark, d):
    names = spark.createDataFrame([("GeForce MX130",), ("CUDA: GeForce MX130/PCIe (0)",), ("OpenCL: Intel(R) UHD",)], "name string")
    return names.select("name", X.device_key("name").alias("device"), X.name_holds("name", "mx130").alias("holds"))


# -- sources --------------------------------------------------------------------------------------------------------------------------


@query("SELECT range AS idx, 0.0::DOUBLE AS zero, 1.0::DOUBLE AS one, 2.5::DOUBLE AS filled FROM range(1000)")
def constant_generators(spark, d):
    z, o, f = (g(spark, (10, 100)).df for g in (generators.zeros, generators.ones, lambda s, n: generators.full(s, n, 2.5)))
    return z.withColumnRenamed("v", "zero").join(o.withColumnRenamed("v", "one"), "idx").join(f.withColumnRenamed("v", "filled"), "idx")


@query("SELECT range AS idx, range * range + 1 AS v FROM range(5000)")
def generator_fill(spark, d):
    return generators.generate(spark, (50, 100), lambda i: i * i + 1).df


@query("SELECT unnest([0, 1, 2, 3, 4, 5])::BIGINT AS idx, unnest([1, 2, 3, 4, 5, 6])::BIGINT AS v")
def in_memory_source(spark, d):
    return generators.from_data(spark, [[1, 2, 3], [4, 5, 6]]).df


@query("SELECT true AS centred, true AS scaled, true AS even, 1000000::BIGINT AS n")
def randn_moments(spark, d):
    """Whether the first three moments of a million draws are those of the normal law, within six of their deviations."""
    t = generators.randn(spark, (1000, 1000)).df
    return t.agg((F.abs(F.avg("v")) < 0.006).alias("centred"), (F.abs(F.stddev_pop("v") - 1) < 0.0043).alias("scaled"), (F.abs(F.skewness("v")) < 0.015).alias("even"), F.count("v").alias("n"))


@query("SELECT true AS centred, true AS inside, 1000000::BIGINT AS n")
def uniform_moments(spark, d):
    t = generators.rand(spark, (1000, 1000)).df
    return t.agg((F.abs(F.avg("v") - 0.5) < 0.0018).alias("centred"), ((F.min("v") >= 0) & (F.max("v") < 1)).alias("inside"), F.count("v").alias("n"))


# -- element by element ---------------------------------------------------------------------------------------------------------------

KEYS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]


def _pair(name: str, f, x: str, y: str, sql: str) -> None:
    def run(spark, d):
        return load(spark, d, "lineitem").select(*KEYS, f(F.col(x), F.col(y)).alias("v"))

    run.__name__ = name
    query(f"SELECT {', '.join(KEYS)}, {sql} AS v FROM lineitem")(run)


_pair("elementwise_add", S.add, "l_extendedprice", "l_tax", "l_extendedprice + l_tax")
_pair("elementwise_subtract", S.subtract, "l_extendedprice", "l_discount", "l_extendedprice - l_discount")
_pair("elementwise_multiply", S.multiply, "l_extendedprice", "l_discount", "l_extendedprice * l_discount")
_pair("elementwise_divide", S.divide, "l_extendedprice", "l_quantity", "l_extendedprice / l_quantity")
_pair("divide_integers", S.divide_integers, "l_partkey", "l_linenumber", "l_partkey // l_linenumber")


def _each(name: str, f, sql: str) -> None:
    def run(spark, d):
        return events(spark, d).map(f).df

    run.__name__ = name
    query(f"SELECT event_id AS idx, {sql} AS v FROM events")(run)


_each("scalar_add", lambda v: S.add(v, 100.0), "value + 100")
_each("scalar_subtract", lambda v: S.subtract(v, 3.14159), "value - 3.14159::DOUBLE")
_each("scalar_multiply", lambda v: S.multiply(v, 2.0), "value * 2")
_each("scalar_divide", lambda v: S.divide(v, 4.0), "value / 4")
_each("negate", S.negate, "-value")
_each("absolute", lambda v: S.absolute(v - 50.0), "abs(value - 50)")
_each("clamp", lambda v: S.clamp(v, 10.0, 60.0), "greatest(10, least(60, value))")
_each("fill", lambda v: F.lit(7.0), "7.0::DOUBLE")
_each("udf_map", lambda v: v * v + 1.0, "value * value + 1")


@query("SELECT event_id AS idx, value * 2 + 1 AS v FROM events")
def udf_map_batches(spark, d):
    return maps.map_batches(events(spark, d), lambda s: s * 2 + 1).df


@query("SELECT event_id AS idx, value - user_id AS v FROM events")
def udf_zip_map(spark, d):
    users = readers.tensor_of(load(spark, d, "events"), "event_id", "user_id")
    return maps.zip_columns(events(spark, d), users, lambda a, b: a - b).df


@query("SELECT event_id AS idx, value + user_id AS v FROM events")
def zip_join_add(spark, d):
    users = readers.tensor_of(load(spark, d, "events"), "event_id", "user_id")
    return (events(spark, d) + users).df


@query("SELECT event_id AS idx, round(value - (SELECT avg(value) FROM events), 6) AS v FROM events")
def scalar_broadcast(spark, d):
    t = events(spark, d)
    return rounded((t - reduce.mean(t)).df)


@query("SELECT event_id AS idx, value > 50 AS above, value < 20 AS below, value = 50 AS same FROM events")
def comparisons(spark, d):
    v = F.col("value")
    return load(spark, d, "events").select(F.col("event_id").alias("idx"), S.greater_than(v, 50.0).alias("above"), S.less_than(v, 20.0).alias("below"), S.equal_to(v, 50.0).alias("same"))


@query("SELECT event_id AS idx, value > user_id AS v FROM events")
def greater_than(spark, d):
    return (events(spark, d) > readers.tensor_of(load(spark, d, "events"), "event_id", "user_id")).df


@query("SELECT event_id AS idx, value < user_id AS v FROM events")
def less_than(spark, d):
    return (events(spark, d) < readers.tensor_of(load(spark, d, "events"), "event_id", "user_id")).df


@query("SELECT event_id AS idx, user_id = event_id % 50 AS v FROM events")
def equal_to(spark, d):
    e = load(spark, d, "events")
    return readers.tensor_of(e, "event_id", "user_id").equal_to(readers.tensor_of(e.withColumn("k", F.col("event_id") % 50), "event_id", "k")).df


@query("SELECT bool_or(value > 50) AS any_above, bool_and(value > 50) AS all_above, sum((value > 50)::INT)::BIGINT AS n_above FROM events")
def mask_any_all(spark, d):
    mask = events(spark, d) > 50.0
    return mask.df.agg(F.bool_or("v").alias("any_above"), F.bool_and("v").alias("all_above"), F.sum(F.col("v").cast("long")).alias("n_above"))


@query("SELECT event_id AS idx, value AS v FROM events WHERE value > 50")
def mask_filter(spark, d):
    t = events(spark, d)
    return t.where(t > 50.0)


@query("SELECT event_id AS idx, value AS v FROM events WHERE event_id = 17")
def element_get(spark, d):
    t = events(spark, d)
    return t.df.where(F.col("idx") == t.offset(17))


@query("SELECT event_id AS idx, CASE WHEN event_id = 17 THEN -1 ELSE value END AS v FROM events")
def element_set(spark, d):
    return events(spark, d).set(17, -1.0).df


@query("SELECT event_id AS idx, value AS v FROM events ORDER BY event_id LIMIT 10")
def head(spark, d):
    return events(spark, d).head(10)


# -- reductions -----------------------------------------------------------------------------------------------------------------------


def _whole(name: str, f, sql: str) -> None:
    def run(spark, d):
        return rounded(f(events(spark, d)).df.select("v"), to=4)

    run.__name__ = name
    query(f"SELECT round({sql}, 4) AS v FROM events")(run)


_whole("reduce_sum", reduce.total, "sum(value)")
_whole("reduce_mean", reduce.mean, "avg(value)")
_whole("reduce_max", reduce.largest, "max(value)")
_whole("reduce_min", reduce.smallest, "min(value)")


@query("SELECT event_id AS idx, value AS v FROM events ORDER BY value DESC, event_id LIMIT 1")
def argmax(spark, d):
    return reduce.argmax(events(spark, d))


@query("SELECT event_id AS idx, value AS v FROM events ORDER BY value, event_id LIMIT 1")
def argmin(spark, d):
    return reduce.argmin(events(spark, d))


@query("SELECT round(sum(value * user_id), 2) AS v FROM events")
def dot(spark, d):
    users = readers.tensor_of(load(spark, d, "events"), "event_id", "user_id")
    return rounded(reduce.dot(events(spark, d), users).df.select("v"), to=2)


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)), 6) AS v FROM embeddings")
def dot_arrays(spark, d):
    return rounded(load(spark, d, "embeddings").select("vec_id", reduce.dot_arrays("embedding", "embedding").alias("v")))


@query("SELECT round(max(abs(value - round(value))), 6) AS v FROM events")
def max_absolute_error(spark, d):
    t = events(spark, d)
    return rounded(reduce.worst_error(t, t.map(lambda v: F.round(v))))


@query("SELECT event_id AS idx, round((SELECT sum(value) FROM events), 4) AS v FROM events")
def all_reduce_broadcast(spark, d):
    return rounded(collectives.all_reduce_sum(events(spark, d).df), to=4)


@query("SELECT l_shipmode AS device, n AS elements, round(100.0 * n / sum(n) OVER (), 6) AS percent FROM (SELECT l_returnflag AS l_shipmode, count(*) AS n FROM lineitem GROUP BY 1)")
def shard_shares(spark, d):
    sizes = load(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("device")).agg(F.count(F.lit(1)).alias("n"))
    return rounded(reduce.shares(sizes, "device"), "percent")


# -- matrices -------------------------------------------------------------------------------------------------------------------------


@query(f"SELECT idx // 32 AS i, idx % 32 AS j, v FROM ({FLAT})")
def reshape(spark, d):
    t = matrix(spark, d)
    return t.reshape(t.size // 32, 32).cells()


@query(f"SELECT j AS i, i AS j, v FROM ({CELLS})")
def transpose(spark, d):
    return matrix(spark, d).transpose().cells()


def centroids(spark, d) -> DataFrame:
    """(i, j, v): sums of the embeddings of each label."""
    emb = load(spark, d, "embeddings").select(F.col("label").cast("long").alias("i"), F.posexplode("embedding").alias("j", "x"))
    return emb.groupBy("i", F.col("j").cast("long").alias("j")).agg(F.sum(F.col("x").cast("double")).alias("v"))


CENTROIDS = "SELECT label::BIGINT AS i, (j - 1)::BIGINT AS j, sum(embedding[j]::DOUBLE) AS v FROM (SELECT *, unnest(range(1, 65)) AS j FROM embeddings) GROUP BY 1, 2"


@query(f"WITH a AS ({CELLS}), b AS ({CENTROIDS}) SELECT a.i, b.i AS j, round(sum(a.v * b.v), 5) AS v FROM a JOIN b ON a.j = b.j GROUP BY a.i, b.i")
def matmul_abt(spark, d):
    labels = Tensor.of_cells(centroids(spark, d), 10, DIM)
    return rounded(linalg.matmul_abt(matrix(spark, d), labels).cells(), to=5)


@query(f"WITH a AS ({CELLS}) SELECT a.j AS i, b.j, round(sum(a.v * b.v), 5) AS v FROM a JOIN a b ON a.i = b.i GROUP BY a.j, b.j")
def gram_of_columns(spark, d):
    x, n = cells(spark, d), load(spark, d, "embeddings").count()
    return rounded(linalg.of_columns(x, x, (DIM, n, DIM)).select("i", "j", "v"), to=5)


@query("SELECT a.l_partkey AS i, b.l_suppkey AS j, round(sum(a.l_quantity::DOUBLE * b.l_linenumber), 4) AS v FROM lineitem a JOIN lineitem b USING (l_orderkey) GROUP BY 1, 2")
def matmul_of_orders(spark, d):
    """Parts by orders times orders by suppliers: two large sparse matrices. Pairs that share no order are 0, and left out."""
    lines = load(spark, d, "lineitem")
    a, b = lines.select("l_partkey", "l_orderkey", F.col("l_quantity").alias("v")), lines.select("l_suppkey", "l_orderkey", F.col("l_linenumber").alias("v"))
    return rounded(blocks.sparse_product(a, b, ("l_partkey", "l_orderkey"), ("l_suppkey", "l_orderkey")), to=4)


WEIGHT = "((i * 7 + j * 3) % 11 - 5) / 10.0"


def weights(spark, rows: int, cols: int) -> DataFrame:
    i, j = F.floor(F.col("id") / cols), F.col("id") % cols
    return spark.range(rows * cols).select(i.alias("i"), j.alias("j"), (((i * 7 + j * 3) % 11 - 5) / 10.0).alias("v"))


@query(f"WITH x AS ({CELLS}), w AS (SELECT i, j, ({WEIGHT})::DOUBLE AS v FROM (SELECT range // 16 AS i, range % 16 AS j FROM range(1024))) SELECT x.i, w.j, round(sum(x.v * w.v) + w.j / 8.0::DOUBLE, 5) AS v FROM x JOIN w ON x.j = w.i GROUP BY x.i, w.j")
def linear_forward(spark, d):
    bias = spark.range(16).select(F.col("id").alias("j"), (F.col("id") / 8.0).alias("v"))
    return rounded(linalg.linear_forward(cells(spark, d), weights(spark, DIM, 16), bias, (load(spark, d, "embeddings").count(), DIM, 16)), to=5)


@query(f"WITH x AS ({CELLS}) SELECT x.j AS i, e.label::BIGINT AS j, round(sum(x.v), 5) AS v FROM x JOIN embeddings e ON x.i = e.vec_id GROUP BY 1, 2")
def linear_backward(spark, d):
    """Gradient of the weights when the output's gradient is one at the label."""
    dy = load(spark, d, "embeddings").select(F.col("vec_id").alias("i"), F.col("label").cast("long").alias("j"), F.lit(1.0).alias("v"))
    return rounded(linalg.linear_backward(cells(spark, d), weights(spark, DIM, 10), dy, (load(spark, d, "embeddings").count(), DIM, 10))[1], to=5)


@query(f"WITH w AS (SELECT i, j, ({WEIGHT})::DOUBLE AS v FROM (SELECT range // 10 AS i, range % 10 AS j FROM range(640))) SELECT e.vec_id AS i, w.i AS j, round(w.v, 5) AS v FROM embeddings e JOIN w ON w.j = e.label")
def linear_backward_inputs(spark, d):
    """Gradient of the inputs when the output's gradient is one at the label."""
    dy = load(spark, d, "embeddings").select(F.col("vec_id").alias("i"), F.col("label").cast("long").alias("j"), F.lit(1.0).alias("v"))
    return rounded(linalg.linear_backward(cells(spark, d), weights(spark, DIM, 10), dy, (load(spark, d, "embeddings").count(), DIM, 10))[0], to=5)


@query(f"SELECT j, round(sum(v), 5) AS v FROM ({CELLS}) GROUP BY j")
def linear_backward_bias(spark, d):
    return rounded(linalg.linear_backward(cells(spark, d), weights(spark, DIM, DIM), cells(spark, d), (load(spark, d, "embeddings").count(), DIM, DIM))[2], to=5)


@query("SELECT event_id AS pos, j AS dim, ((user_id % 32 * 7 + j * 3) % 11 - 5)::DOUBLE / 10 AS v FROM (SELECT *, unnest(range(0, 4)) AS j FROM events)")
def embedding_lookup(spark, d):
    tokens = load(spark, d, "events").select(F.col("event_id").alias("pos"), (F.col("user_id") % 32).alias("token"))
    return linalg.embedding_forward(tokens, weights(spark, 32, 4).toDF("token", "dim", "v"))


@query(f"WITH x AS ({CELLS}) SELECT e.label::BIGINT AS token, x.j AS dim, round(sum(x.v), 5) AS v FROM x JOIN embeddings e ON x.i = e.vec_id GROUP BY 1, 2")
def embedding_scatter_add(spark, d):
    tokens = load(spark, d, "embeddings").select(F.col("vec_id").alias("pos"), F.col("label").cast("long").alias("token"))
    return rounded(linalg.embedding_backward(tokens, cells(spark, d).toDF("pos", "dim", "v")), to=5)


@query("SELECT event_id - 100 AS idx, value AS v FROM events WHERE event_id BETWEEN 100 AND 349")
def extract_shard(spark, d):
    return linalg.extract(events(spark, d), 100, 250).df


@query("SELECT event_id AS idx, value AS v FROM events")
def assemble_shards(spark, d):
    t = events(spark, d)
    k = 7
    plan = shards.even_plan(spark, t.size, k)
    dealt = t.df.withColumn("shard_id", shards.shard_of(F.col("idx"), t.size, k)).join(F.broadcast(plan), "shard_id")
    return linalg.assemble(dealt.select("shard_id", (F.col("idx") - F.col("offset")).alias("idx"), "v"), F.broadcast(plan.select("shard_id", "offset")))


@query("SELECT least(event_id // (n // 4), 3)::INT AS batch, event_id - least(event_id // (n // 4), 3) * (n // 4) AS idx, value AS v FROM events, (SELECT count(*) AS n FROM events)")
def micro_batches(spark, d):
    return linalg.micro_batches(events(spark, d), 4)


# -- activations, norms and losses ----------------------------------------------------------------------------------------------------


@query(f"SELECT i, j, round(greatest(v, 0), 6) AS relu, CASE WHEN v > 0 THEN 1.0::DOUBLE ELSE 0 END AS relu_slope, round(0.5 * v * (1 + tanh(sqrt(2 / pi()) * (v + 0.044715 * v * v * v))), 6) AS gelu, round(v / (1 + exp(-v)), 6) AS silu FROM ({CELLS})")
def activations(spark, d):
    v = F.col("v")
    return rounded(cells(spark, d).select("i", "j", S.relu(v).alias("relu"), S.relu_slope(v).alias("relu_slope"), S.gelu(v).alias("gelu"), S.silu(v).alias("silu")), "relu", "gelu", "silu")


@query(f"SELECT idx, round(exp(v - (SELECT max(v) FROM ({FLAT}))) / (SELECT sum(exp(v - (SELECT max(v) FROM ({FLAT})))) FROM ({FLAT})), 9) AS v FROM ({FLAT})")
def softmax_global(spark, d):
    return rounded(norms.softmax(matrix(spark, d)).df, to=9)


@query(f"SELECT i, j, round(exp(v - max(v) OVER (PARTITION BY i)) / s, 6) AS v FROM (SELECT *, sum(exp(v - m)) OVER (PARTITION BY i) AS s FROM (SELECT *, max(v) OVER (PARTITION BY i) AS m FROM ({CELLS})))")
def softmax_row(spark, d):
    rows = load(spark, d, "embeddings").select(F.col("vec_id").alias("i"), F.posexplode(norms.softmax_array("embedding")).alias("j", "v"))
    return rounded(rows.withColumn("j", F.col("j").cast("long")))


@query(f"SELECT idx, round((v - (SELECT avg(v) FROM ({FLAT}))) / sqrt((SELECT var_pop(v) FROM ({FLAT})) + 1e-5), 6) AS v FROM ({FLAT})")
def layer_norm_global(spark, d):
    return rounded(norms.layer_norm(matrix(spark, d)).df)


LOGITS = CELLS
PROBS = f"SELECT i, j, exp(v - m) / sum(exp(v - m)) OVER (PARTITION BY i) AS v FROM (SELECT *, max(v) OVER (PARTITION BY i) AS m FROM ({LOGITS}))"


def logits(spark, d) -> DataFrame:
    """Each value of the embeddings is a logit; the label names one of them."""
    return cells(spark, d)


def classes(spark, d) -> DataFrame:
    return load(spark, d, "embeddings").select(F.col("vec_id").alias("i"), F.col("label").cast("long").alias("j"))


@query(f"WITH l AS ({LOGITS}), m AS (SELECT max(v) AS m FROM l), s AS (SELECT sum(exp(v - m)) AS s FROM l, m) SELECT round(sum(CASE WHEN e.label = l.j AND exp(l.v - m) / s > 1e-12 THEN -ln(exp(l.v - m) / s) ELSE 0 END), 3) AS v FROM l JOIN embeddings e ON l.i = e.vec_id, m, s")
def cross_entropy_soft(spark, d):
    x = logits(spark, d)
    y = x.join(classes(spark, d).select("i", F.col("j").alias("y")), "i").select("i", "j", (F.col("j") == F.col("y")).cast("double").alias("v"))
    n = load(spark, d, "embeddings").count()
    return rounded(norms.cross_entropy(Tensor.of_cells(x, n, DIM), Tensor.of_cells(y, n, DIM)).df.select("v"), to=3)


@query(f"SELECT round(-avg(ln(p.v)), 6) AS loss FROM ({PROBS}) p JOIN embeddings e ON p.i = e.vec_id AND p.j = e.label")
def cross_entropy_index(spark, d):
    return rounded(norms.logit_loss(logits(spark, d), classes(spark, d)), "loss")


@query(f"SELECT p.i, p.j, round((p.v - (p.j = e.label)::INT) / (SELECT count(*) FROM embeddings), 9) AS v FROM ({PROBS}) p JOIN embeddings e ON p.i = e.vec_id")
def softmax_ce_grad(spark, d):
    n = load(spark, d, "embeddings").count()
    return rounded(norms.softmax_loss_gradient(norms.softmax_rows(logits(spark, d)), classes(spark, d), n), to=9)


# -- gradients and optimisers ---------------------------------------------------------------------------------------------------------


def users(spark, d) -> Tensor:
    return readers.tensor_of(load(spark, d, "events").select("event_id", (F.col("user_id") + 1.0).alias("u")), "event_id", "u")


def _grad(name: str, build, sql: str, of: int = 0) -> None:
    def run(spark, d):
        x, y = Node(events(spark, d), True), Node(users(spark, d), True)
        build(x, y).backward()
        return rounded((x, y)[of].grad.df, to=9)

    run.__name__ = name
    query(f"SELECT event_id AS idx, round({sql}, 9) AS v FROM (SELECT *, user_id + 1.0::DOUBLE AS u, count(*) OVER () AS n FROM events)")(run)


_grad("grad_multiply", lambda x, y: (x * y).sum(), "value", 1)
_grad("grad_add", lambda x, y: (x + y * y).sum(), "2 * u", 1)
_grad("grad_negate", lambda x, y: (-x * y).sum(), "-u")
_grad("grad_accumulated", lambda x, y: (x * y + x * 3.0).sum(), "u + 3")
_grad("grad_subtract", lambda x, y: (x - y).sum(), "-1.0::DOUBLE", 1)
_grad("grad_divide", lambda x, y: (x / y).sum(), "-value / (u * u)", 1)
_grad("grad_mean", lambda x, y: (x * x).mean(), "2 * value / n")
_grad("grad_relu_chain", lambda x, y: ((x - 50.0).relu() * y).sum(), "CASE WHEN value > 50 THEN u ELSE 0 END")
_grad("grad_absolute", lambda x, y: abs(x - y).sum(), "sign(value - u)::DOUBLE")
_grad("grad_clamp", lambda x, y: x.clamp(10.0, 60.0).sum(), "CASE WHEN value BETWEEN 10 AND 60 THEN 1.0::DOUBLE ELSE 0 END")


DEEP = 20


def _deep_sql() -> str:
    sql = "SELECT event_id, value * 0.001::DOUBLE AS y, 0.001::DOUBLE AS slope FROM events"
    for _ in range(DEEP):
        sql = f"SELECT event_id, y * y * 0.5 + y * 0.4 AS y, slope * (y + 0.4) AS slope FROM ({sql})"
    return f"SELECT event_id AS idx, round(slope * 1e9, 4) AS v FROM ({sql})"


@query(_deep_sql())
def grad_deep_shared(spark, d):
    """Twenty steps, each of which uses the one before it three times: one scan, whatever the depth."""
    x = Node(events(spark, d), True)
    y = x * 0.001
    for _ in range(DEEP):
        y = y * y * 0.5 + y * 0.4
    y.sum().backward()
    return rounded(x.grad.map(lambda v: v * 1e9).df, to=4)


TWO = "SELECT event_id, value / 20 AS x, (user_id % 5)::DOUBLE AS w FROM events"


def two(spark, d) -> tuple[Node, Node]:
    """Two columns of the events, read together."""
    rows = load(spark, d, "events").select(F.col("event_id").alias("idx"), (F.col("value") / 20).alias("x"), (F.col("user_id") % 5).cast("double").alias("w"))
    return tuple(Node.columns(rows, rows.count(), "x", "w"))


@query(f"WITH t AS ({TWO}), p AS (SELECT *, exp(x - (SELECT max(x) FROM t)) / (SELECT sum(exp(x - (SELECT max(x) FROM t))) FROM t) AS p FROM t) SELECT event_id AS idx, round(1e6 * p * (w - (SELECT sum(p * w) FROM p)), 5) + 0 AS v FROM p")
def grad_softmax(spark, d):
    x, w = two(spark, d)
    (x.softmax() * w).sum().backward()
    return rounded(x.grad.map(lambda v: v * 1e6).df, to=5).withColumn("v", F.col("v") + 0.0)  # no minus zeros


@query(f"WITH t AS ({TWO}), s AS (SELECT avg(x) AS m, sqrt(var_pop(x) + 1e-5) AS r, avg(w) AS g FROM t), y AS (SELECT *, (x - m) / r AS y FROM t, s) SELECT event_id AS idx, round((w - g - y * (SELECT avg(w * y) FROM y)) / r, 6) + 0 AS v FROM y")
def grad_layer_norm(spark, d):
    x, w = two(spark, d)
    (x.layer_norm() * w).sum().backward()
    return rounded(x.grad.df)


@query(f"WITH t AS ({TWO}) SELECT event_id AS idx, CASE WHEN event_id = (SELECT min(event_id) FROM t WHERE x = (SELECT max(x) FROM t)) THEN 1.0::DOUBLE WHEN event_id = (SELECT min(event_id) FROM t WHERE x = (SELECT min(x) FROM t)) THEN -1 ELSE 0 END AS v FROM t")
def grad_extremes(spark, d):
    x, _ = two(spark, d)
    (x.max() - x.min()).backward()
    return x.grad.df


@query(f"WITH a AS ({CELLS}), b AS ({CENTROIDS}), y AS (SELECT a.i, b.i AS k, sum(a.v * b.v) AS v FROM a JOIN b ON a.j = b.j GROUP BY 1, 2) SELECT y.i * 64 + b.j AS idx, round(sum(2 * y.v * b.v), 4) + 0 AS v FROM y JOIN b ON y.k = b.i GROUP BY y.i, b.j")
def grad_matmul(spark, d):
    """The slope of the sum of squares of a product by its left side: two more products."""
    a, b = Node(matrix(spark, d), True), Node(Tensor.of_cells(centroids(spark, d), 10, DIM))
    y = a.matmul_abt(b)
    (y * y).sum().backward()
    return rounded(a.grad.df, to=4)


@query(f"WITH f AS ({FLAT}), n AS (SELECT count(*) AS n FROM embeddings) SELECT (f.idx % n) * 64 + f.idx // n AS idx, round(f.v, 6) + 0 AS v FROM f, n")
def grad_transpose(spark, d):
    """The slope of a transposed and reshaped matrix against another matrix: places move, values stay."""
    a, b = Node(matrix(spark, d), True), Node(matrix(spark, d))
    rows = a.shape[0]
    (a.transpose().reshape(rows, DIM) * b).sum().backward()
    return rounded(a.grad.df)


#: Each shard of a thousand elements less its mean, times the other input; and its slopes.
CENTRED = maps.ShardOp(lambda x, w: (x - x.mean()) * w, lambda g, y, x, w: (g * w - (g * w).mean(), g * (x - x.mean())), size=1000)
CENTRED_SQL = f"SELECT *, (x - avg(x) OVER (PARTITION BY event_id // 1000)) * w AS z FROM ({TWO})"


@query(f"SELECT event_id AS idx, round(z, 9) + 0 AS v FROM ({CENTRED_SQL})")
def shard_map(spark, d):
    x, w = two(spark, d)
    return rounded(x.map_shards(CENTRED, w).value.df, to=9).withColumn("v", F.col("v") + 0.0)  # no minus zeros


@query(f"SELECT event_id AS idx, round(2 * z * w - avg(2 * z * w) OVER (PARTITION BY event_id // 1000), 6) + 0 AS v FROM ({CENTRED_SQL})")
def grad_shard_map(spark, d):
    """A caller's function on whole shards inside of a graph, with its own gradient."""
    x, w = two(spark, d)
    z = x.map_shards(CENTRED, w)
    (z * z).sum().backward()
    return rounded(x.grad.df)


@query("SELECT event_id AS idx, round(value - 0.01::DOUBLE * (2 * value / n), 9) AS v FROM (SELECT *, count(*) OVER () AS n FROM events)")
def sgd_step(spark, d):
    x = Node(events(spark, d), True)
    (x * x).mean().backward()
    return rounded(optim.sgd_step(x.value, x.grad).df, to=9)


@query("SELECT event_id AS idx, round(value - 0.001 * (m / (1 - 0.9)) / (sqrt(s / (1 - 0.999::DOUBLE)) + 1e-8) - 0.001 * ((0.9 * m + 0.1 * value) / (1 - 0.81::DOUBLE)) / (sqrt((0.999 * s + 0.001 * value * value) / (1 - 0.998001::DOUBLE)) + 1e-8), 6) AS v FROM (SELECT *, 0.1 * value AS m, 0.001 * value * value AS s FROM events)")
def adam_step(spark, d):
    """Two steps with the same gradient: the correction for bias follows the step."""
    t = events(spark, d)
    state = optim.adam_state(t)
    p, state = optim.adam_step(t, t, state, 1)
    p, _ = optim.adam_step(p, t, state, 2)
    return rounded(p.df)


# -- shard plans and collectives ------------------------------------------------------------------------------------------------------


@query("SELECT s AS shard_id, s * (n // 8) + least(s, n % 8) AS \"offset\", n // 8 + (s < n % 8)::INT AS count FROM (SELECT count(*) AS n FROM lineitem), (SELECT unnest(range(8)) AS s)")
def shard_plan_default(spark, d):
    return shards.default_plan(spark, load(spark, d, "lineitem").count(), 12)


@query("SELECT s AS shard_id, s * (n // 12) + least(s, n % 12) AS \"offset\", n // 12 + (s < n % 12)::INT AS count FROM (SELECT count(*) AS n FROM lineitem), (SELECT unnest(range(12)) AS s)")
def shard_plan_even(spark, d):
    return shards.even_plan(spark, load(spark, d, "lineitem").count(), 12)


@query("SELECT r AS rank, r * e AS \"offset\", greatest(0, least(e, n - r * e)) AS count FROM (SELECT n, (n + 6) // 7 AS e FROM (SELECT count(*) AS n FROM lineitem)), (SELECT unnest(range(7)) AS r)")
def shard_plan_ceil(spark, d):
    return shards.ceil_plan(spark, load(spark, d, "lineitem").count(), 7)


DEVICES = [shards.Device("CUDA: GeForce MX130", "cuda", 30.0, 80_000), shards.Device("OpenCL: GeForce MX130/PCIe", "opencl", 31.0, 80_000), shards.Device("OpenCL: Intel(R) UHD 620", "opencl", 10.0, 40_000), shards.Device("RAM", "cpu_dense"), shards.Device("Disk", "cpu_mmap")]


@query(f"SELECT s::INT AS shard_id, CASE s % 3 WHEN 0 THEN '{DEVICES[1].name}' WHEN 1 THEN '{DEVICES[0].name}' ELSE '{DEVICES[2].name}' END AS device, s * (n // k) + least(s, n % k) AS \"offset\", n // k + (s < n % k)::INT AS count FROM (SELECT n, greatest(1, least(CASE WHEN n > {shards.TWO_EACH_ABOVE} THEN 6 ELSE 3 END, n // {shards.ACCELERATOR_ELEMENTS})) AS k FROM (SELECT count(*) AS n FROM lineitem)), (SELECT unnest(range(6)) AS s) WHERE s < k")
def shard_plan_accelerators(spark, d):
    return shards.to_frame(spark, shards.accelerators_first(load(spark, d, "lineitem").count(), DEVICES))


SATURATING = f"""
WITH n AS (SELECT count(*) AS n FROM lineitem),
c AS (SELECT n, least(n, (80000 * {shards.MEMORY_PERCENT} / 100)::BIGINT // 4) AS a, least(n, (40000 * {shards.MEMORY_PERCENT} / 100)::BIGINT // 4) AS b FROM n),
t AS (SELECT *, least(n, a + b) AS t FROM c),
h AS (SELECT *, floor(a / (a + b)::DOUBLE * t)::BIGINT AS ha, floor(b / (a + b)::DOUBLE * t)::BIGINT AS hb FROM t),
g AS (SELECT n, ha + least(a - ha, t - ha - hb) AS ha, hb + (t - ha - hb) - least(a - ha, t - ha - hb) AS hb FROM h)
SELECT 0 AS shard_id, '{DEVICES[0].name}' AS device, 0::BIGINT AS "offset", ha AS count FROM g
UNION ALL SELECT 1, '{DEVICES[2].name}', ha, hb FROM g
UNION ALL SELECT 2, '{DEVICES[4].name}', ha + hb, n - ha - hb FROM g WHERE n > ha + hb
"""


@query(SATURATING)
def shard_plan_saturating(spark, d):
    return shards.to_frame(spark, shards.saturating(load(spark, d, "lineitem").count(), DEVICES))


@query("SELECT s AS shard_id, count(*) AS n, min(event_id) AS first, max(event_id) AS last FROM (SELECT event_id, CASE WHEN event_id < (n % 7) * (n // 7 + 1) THEN event_id // (n // 7 + 1) ELSE n % 7 + (event_id - (n % 7) * (n // 7 + 1)) // (n // 7) END::INT AS s FROM events, (SELECT count(*) AS n FROM events)) GROUP BY s")
def shard_sizes(spark, d):
    t = events(spark, d)
    return t.df.groupBy(shards.shard_of(F.col("idx"), t.size, 7).alias("shard_id")).agg(F.count(F.lit(1)).alias("n"), F.min("idx").alias("first"), F.max("idx").alias("last"))


@query("SELECT range AS rank, range % 4 AS tp_rank, range // 4 % 2 AS dp_rank, range // 8 AS pp_rank FROM range(24)")
def rank_grid(spark, d):
    return collectives.rank_grid(spark, 4, 2, 3)


@query("SELECT range AS rank, range // 8 * 2 + range // 4 % 2 AS tp_group, range // 8 * 4 + range % 4 AS dp_group, range // 4 % 2 * 4 + range % 4 AS pp_group FROM range(24)")
def rank_groups(spark, d):
    return collectives.groups(collectives.rank_grid(spark, 4, 2, 3)).select("rank", "tp_group", "dp_group", "pp_group")


def parts(spark, d) -> DataFrame:
    """The embeddings dealt over four ranks: rank vec_id mod 4, places numbered from 0."""
    n = load(spark, d, "embeddings").count()
    per = -(-n // 4)
    return cells(spark, d).select((F.col("i") % 4).cast("int").alias("rank"), (F.floor(F.col("i") / 4) * DIM + F.col("j")).alias("idx"), "v").where(F.col("idx") < per * DIM)


PARTS = f"SELECT (i % 4)::INT AS rank, i // 4 * 64 + j AS idx, v FROM ({CELLS})"
PER = "(SELECT (count(*) + 3) // 4 * 64 FROM embeddings)"


@query(f"SELECT rank * {PER} + idx AS idx, v FROM ({PARTS})")
def allgather(spark, d):
    return collectives.allgather(parts(spark, d), -(-load(spark, d, "embeddings").count() // 4) * DIM)


@query(f"SELECT (idx // (({PER} + 3) // 4))::INT AS rank, idx % (({PER} + 3) // 4) AS idx, v FROM (SELECT idx, round(avg(v), 6) AS v FROM ({PARTS}) GROUP BY idx)")
def reducescatter_mean(spark, d):
    n = -(-load(spark, d, "embeddings").count() // 4) * DIM
    return rounded(collectives.reduce_scatter(parts(spark, d), 4, n, "mean"))


@query("SELECT (event_id // ((n + 3) // 4))::INT AS rank, event_id % ((n + 3) // 4) AS idx, value AS v FROM events, (SELECT count(*) AS n FROM events)")
def scatter(spark, d):
    t = events(spark, d)
    return collectives.scatter(t.df, 4, t.size)


@query(f"SELECT idx, round(sum(v), 6) AS v FROM ({PARTS}) GROUP BY idx")
def allreduce_sum(spark, d):
    return rounded(collectives.allreduce(parts(spark, d), "sum"))


@query(f"SELECT idx, round(avg(v), 6) AS v FROM ({PARTS}) GROUP BY idx")
def allreduce_mean(spark, d):
    return rounded(collectives.allreduce(parts(spark, d), "mean"))


@query("SELECT rank::INT AS rank, event_id AS idx, value AS v FROM events, (SELECT unnest(range(3)) AS rank)")
def broadcast_copies(spark, d):
    return collectives.broadcast_to(events(spark, d).df, 3)


@query("SELECT doc_id, lang, (doc_id % 4)::INT AS rank FROM documents")
def rank_batch(spark, d):
    return collectives.rank_batch(load(spark, d, "documents").select("doc_id", "lang"), "doc_id", 4)


# -- character language model ---------------------------------------------------------------------------------------------------------


@query("SELECT doc_id, doc_id < floor(n * 0.9) AS is_train FROM documents, (SELECT count(*) AS n FROM documents)")
def train_test_split(spark, d):
    docs = load(spark, d, "documents")
    return charlm.split_rows(docs.select("doc_id"), "doc_id", docs.count())


def words(spark, d) -> DataFrame:
    """The different words of all documents, in small letters, and how often they occur."""
    return charlm.lines_of(load(spark, d, "documents"))


def prefixes(seq_len: int) -> str:
    """Common tables up to q: every prefix of every word."""
    return rf"""
l AS (SELECT line, count(*) AS weight, line || chr(10) AS s FROM (SELECT regexp_replace(lower(unnest(regexp_split_to_array(text, '[\x20\x09-\x0D]+'))), '[^a-z]', '', 'g') AS line FROM documents) WHERE line <> '' GROUP BY line),
p AS (SELECT line, weight, piece, substr(s, piece * {seq_len} + 1, {seq_len}) AS s FROM (SELECT *, unnest(range(0, (length(s) - 1) // {seq_len} + 1)) AS piece FROM l)),
t AS (SELECT line, weight, piece, list_transform(range(1, length(s) + 1), lambda k: CASE WHEN substr(s, k, 1) = chr(10) THEN 0 ELSE ascii(substr(s, k, 1)) - 96 END) AS t FROM p),
r AS (SELECT line, weight, piece, unnest(range(1, len(t) + 1)) AS n, t FROM t),
q AS (SELECT line, weight, piece, n, list_concat(list_transform(range(0, {seq_len + 1} - n), lambda z: 0), t[1:n]) AS tokens FROM r)
"""


@query(f"WITH {prefixes(16)} SELECT line, piece::INT AS piece, n::INT AS n, array_to_string(tokens, ',') AS tokens FROM q")
def char_prefix_rows(spark, d):
    rows = charlm.prefix_rows(words(spark, d).select("line"))
    return rows.select("line", "piece", "n", F.array_join(F.transform("tokens", lambda t: t.cast("string")), ",").alias("tokens"))


@query(f"WITH {prefixes(16)} SELECT line, piece::INT AS piece, n::INT AS n, array_to_string(list_transform(tokens[1:16], lambda t: CASE WHEN t = 0 THEN '.' ELSE chr((t + 96)::INT) END), '') AS x, tokens[17]::INT AS y FROM q")
def batch_inputs_targets(spark, d):
    rows = charlm.prefix_rows(words(spark, d).select("line")).withColumn("x", charlm.inputs())
    return rows.select("line", "piece", "n", charlm.shown("x").alias("x"), charlm.target().alias("y"))


@query("""
WITH h AS (SELECT doc_id, lang, row_number() OVER (ORDER BY md5('7:' || doc_id), doc_id) - 1 AS place, count(*) OVER () AS n FROM documents)
SELECT b, doc_id, lang FROM h JOIN (SELECT unnest(range(0, 2000)) AS b) ON place = ('0x' || substr(md5('7:' || b), 1, 15))::BIGINT % n
""")
def random_batch(spark, d):
    """Two thousand draws with replacement; places in the order of hashes, whatever the files."""
    return charlm.random_batch(load(spark, d, "documents").select("doc_id", "lang"), "doc_id", 2000, seed=7).select("b", "doc_id", "lang")


@query("SELECT world, 27 + (world - 27 % world) AS padded FROM (SELECT unnest([1, 2, 3, 4, 8]) AS world)")
def vocab_padding(spark, d):
    return spark.createDataFrame([(1,), (2,), (3,), (4,), (8,)], "world int").select("world", (F.lit(27) + (F.col("world") - F.lit(27) % F.col("world"))).alias("padded"))


@query(f"WITH p AS ({PROBS}), c AS (SELECT *, sum(v) OVER (PARTITION BY i ORDER BY j ROWS UNBOUNDED PRECEDING) AS c FROM p) SELECT i, coalesce(min(CASE WHEN c >= (i * 37 % 101 + 0.5::DOUBLE) / 101 THEN j END), max(j)) AS token FROM c GROUP BY i")
def inverse_cdf_sample(spark, d):
    p = norms.softmax_rows(logits(spark, d))
    draws = load(spark, d, "embeddings").select(F.col("vec_id").alias("i"), ((F.col("vec_id") * 37 % 101 + 0.5) / 101).alias("u"))
    return charlm.sample_index(p, draws)


#: A small net of fixed numbers; no sum of its first layer is 0, where the slope jumps.
SEQ, EMB, HIDDEN = 4, 2, 4


def fixed_net() -> charlm.Net:
    part = lambda rows, cols, salt: np.array([[((i * 7 + j * 3 + salt) % 11 - 5) / 10 for j in range(cols)] for i in range(rows)])
    return charlm.Net(part(charlm.VOCAB, EMB, 0), part(SEQ * EMB, HIDDEN, 1), part(1, HIDDEN, 2)[0] + 0.0137, part(HIDDEN, charlm.VOCAB, 3), part(1, charlm.VOCAB, 4)[0])


def _part_sql(rows: int, cols: int, salt: int) -> str:
    return f"SELECT range // {cols} AS i, range % {cols} AS j, ((range // {cols} * 7 + range % {cols} * 3 + {salt}) % 11 - 5)::DOUBLE / 10 AS v FROM range({rows * cols})"


FORWARD = f"""
WITH {prefixes(SEQ)},
wte AS ({_part_sql(27, EMB, 0)}), fc1 AS ({_part_sql(SEQ * EMB, HIDDEN, 1)}), b1 AS (SELECT i, j, v + 0.0137 AS v FROM ({_part_sql(1, HIDDEN, 2)})), fc2 AS ({_part_sql(HIDDEN, 27, 3)}), b2 AS ({_part_sql(1, 27, 4)}),
rows AS MATERIALIZED (SELECT row_number() OVER () AS id, tokens, tokens[{SEQ + 1}] AS y, sum(weight)::DOUBLE AS w FROM q GROUP BY tokens),
token AS (SELECT id, pos, tokens[pos + 1] AS token FROM rows, (SELECT unnest(range(0, {SEQ})) AS pos)),
x AS (SELECT id, pos * {EMB} + wte.j AS k, wte.v FROM token JOIN wte ON wte.i = token),
pre AS MATERIALIZED (SELECT id, fc1.j, sum(x.v * fc1.v) + any_value(b1.v) AS v FROM x JOIN fc1 ON fc1.i = x.k JOIN b1 ON b1.j = fc1.j GROUP BY id, fc1.j),
logits AS (SELECT id, fc2.j, sum(greatest(pre.v, 0) * fc2.v) + any_value(b2.v) AS v FROM pre JOIN fc2 ON fc2.i = pre.j JOIN b2 ON b2.j = fc2.j GROUP BY id, fc2.j),
probable AS MATERIALIZED (SELECT id, j, exp(v) / sum(exp(v)) OVER (PARTITION BY id) AS p FROM logits)
"""


@query(FORWARD + "SELECT round(sum(-w * ln(p)) / sum(w), 6) AS loss FROM probable JOIN rows USING (id) WHERE j = y")
def charlm_loss(spark, d):
    """Mean loss of the net over every prefix of every word of all documents."""
    rows = charlm.weighted_rows(words(spark, d), SEQ)
    return rounded(spark.createDataFrame([(charlm.loss(rows, fixed_net()),)], "loss double"), "loss")


@query(FORWARD + f""",
d AS MATERIALIZED (SELECT id, j, (p - (j = y)::INT) * w / (SELECT sum(w) FROM rows) AS v FROM probable JOIN rows USING (id)),
dpre AS MATERIALIZED (SELECT d.id, fc2.i AS j, sum(d.v * fc2.v) AS v FROM d JOIN fc2 ON fc2.j = d.j JOIN pre ON pre.id = d.id AND pre.j = fc2.i WHERE pre.v > 0 GROUP BY d.id, fc2.i),
dx AS (SELECT dpre.id, fc1.i AS k, sum(dpre.v * fc1.v) AS v FROM dpre JOIN fc1 ON fc1.j = dpre.j GROUP BY dpre.id, fc1.i),
g AS (
  SELECT 'fc2' AS name, pre.j AS i, d.j, sum(greatest(pre.v, 0) * d.v) AS v FROM pre JOIN d USING (id) GROUP BY pre.j, d.j
  UNION ALL SELECT 'b2', 0, j, sum(v) FROM d GROUP BY j
  UNION ALL SELECT 'fc1', x.k, dpre.j, sum(x.v * dpre.v) FROM x JOIN dpre USING (id) GROUP BY x.k, dpre.j
  UNION ALL SELECT 'b1', 0, j, sum(v) FROM dpre GROUP BY j
  UNION ALL SELECT 'wte', token.token, dx.k % {EMB}, sum(dx.v) FROM dx JOIN token ON token.id = dx.id AND token.pos = dx.k // {EMB} GROUP BY 2, 3),
o AS (SELECT 'wte' AS name, * FROM wte UNION ALL SELECT 'fc1', * FROM fc1 UNION ALL SELECT 'b1', * FROM b1 UNION ALL SELECT 'fc2', * FROM fc2 UNION ALL SELECT 'b2', * FROM b2)
SELECT o.name, o.i::INT AS i, o.j::INT AS j, round(o.v - 0.1 * coalesce(g.v, 0), 7) + 0 AS v FROM o LEFT JOIN g ON g.name = o.name AND g.i = o.i AND g.j = o.j
""")
def charlm_step(spark, d):
    """The net's parameters after one step down the gradient over all prefixes, added up over partitions."""
    net = fixed_net()
    _, slopes = charlm.gradient(charlm.weighted_rows(words(spark, d), SEQ), net)
    return rounded(charlm.step(net, slopes, 0.1).cells(spark), to=7)


@query()
def charlm_train(spark, d):
    """(step, loss) of five steps on random batches of 512 of the different prefixes; tests hold the loop against a plain one."""
    rows = charlm.weighted_rows(words(spark, d), SEQ).select(F.array_join("tokens", ",").alias("key"), "tokens")
    _, losses = charlm.train(rows, "key", fixed_net(), steps=5, batch_size=512, lr=0.5, seed=3)
    return spark.createDataFrame(list(enumerate(losses)), "step int, loss double")


MOST = 12


@query(f"""
WITH RECURSIVE n AS (SELECT
  list_transform(range(0, 27), lambda t: list_transform(range(0, {EMB}), lambda e: ((t * 7 + e * 3) % 11 - 5)::DOUBLE / 10)) AS wte,
  list_transform(range(0, {HIDDEN}), lambda j: list_transform(range(0, {SEQ * EMB}), lambda i: ((i * 7 + j * 3 + 1) % 11 - 5)::DOUBLE / 10)) AS fc1,
  list_transform(range(0, {HIDDEN}), lambda j: ((j * 3 + 2) % 11 - 5)::DOUBLE / 10 + 0.0137) AS b1,
  list_transform(range(0, 27), lambda j: list_transform(range(0, {HIDDEN}), lambda i: ((i * 7 + j * 3 + 3) % 11 - 5)::DOUBLE / 10)) AS fc2,
  list_transform(range(0, 27), lambda j: ((j * 3 + 4) % 11 - 5)::DOUBLE / 10) AS b2),
g AS (
  SELECT c_custkey AS id, 0 AS step, [0, 0, 0, c_custkey % 27]::BIGINT[] AS context, []::BIGINT[] AS said FROM customer
  UNION ALL
  SELECT id, step + 1, list_append(context[2:{SEQ}], token), list_append(said, token) FROM (
    SELECT id, step, context, said, coalesce(list_position(list_transform(range(1, 28), lambda c: list_sum(e[1:c]) / list_sum(e) >= u), true), 27)::BIGINT - 1 AS token FROM (
      SELECT id, step, context, said, ((id * 7919 + step * 104729) % 1000003 + 0.5::DOUBLE) / 1000003 AS u, list_transform(range(1, 28), lambda c: exp(b2[c] + list_dot_product(h, fc2[c]))) AS e FROM (
        SELECT id, step, context, said, fc2, b2, list_transform(range(1, {HIDDEN + 1}), lambda j: greatest(0, b1[j] + list_dot_product(flatten(list_transform(context, lambda t: wte[t + 1])), fc1[j]))) AS h
        FROM g, n WHERE step < {MOST} AND (step = 0 OR said[-1] <> 0)))))
SELECT id, array_to_string(arg_max(said, step), ',') AS tokens FROM g GROUP BY id
""")
def charlm_sample(spark, d):
    """What the net says after a token of each customer's own, to its end or 12 tokens."""
    key = F.col("c_custkey").cast("long")
    contexts = load(spark, d, "customer").select(key.alias("id"), F.array((key % 27).cast("int")).alias("tokens"))
    said = charlm.sample(contexts, fixed_net(), MOST, lambda ids, step: ((ids * 7919 + step * 104729) % 1000003 + 0.5) / 1000003)
    return said.select("id", F.array_join(F.transform("tokens", lambda t: t.cast("string")), ",").alias("tokens"))


# -- sinks ----------------------------------------------------------------------------------------------------------------------------


def own_path(spark, tag: str) -> str:
    """A new path in the folder that driver and executors share."""
    return f"{storage.checkpoint_dir(spark)}/tessera-core/{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"


@query("SELECT p_partkey, p_size, p_retailprice FROM part")
def csv_round_trip(spark, d):
    """Numbers as text with ten digits under a header, and back."""
    part, path = load(spark, d, "part").select("p_partkey", "p_size", "p_retailprice"), own_path(spark, "csv")
    sinks.save_csv(part, path)
    return spark.read.schema(part.schema).option("header", True).csv(path)


@query(ORACLES["numeric_matrix_long"])
def pqtd_round_trip(spark, d):
    """The numeric columns through the binary format and back."""
    path = own_path(spark, "pqtd")
    pqtd.save(load(spark, d, "part"), path)
    return readers.matrix(pqtd.load(spark, path), F.col("p_partkey").cast("long")).select("i", "j", F.col("v").cast("double").alias("v"))


@query("SELECT count(*) AS n, 0::BIGINT AS overlaps FROM events")
def ranges_in_order(spark, d):
    """Partitions of a tensor as ranges of its index: none reaches into the next."""
    dealt = sinks.in_ranges(events(spark, d), 7).df.groupBy(F.spark_partition_id().alias("part")).agg(F.min("idx").alias("first"), F.max("idx").alias("last"), F.count(F.lit(1)).alias("n"))
    ends = dealt.withColumn("before", F.lag("last").over(Window.orderBy("part")))  # seven rows
    return ends.agg(F.sum("n").alias("n"), F.count(F.when(F.col("before") >= F.col("first"), 1)).alias("overlaps"))


@query("SELECT event_id AS idx, CASE WHEN event_id % 100 = 7 THEN -value WHEN event_id % 1000 = 8 THEN 0.5 ELSE value END AS v FROM events")
def elements_set(spark, d):
    """A tensor on disk with one element in a hundred changed, merged, and some changed again: only what changed is written."""
    t = events(spark, d)
    z = zones.Zones.write(t, own_path(spark, "zones"), zone=4096)
    z.set(t.df.where("idx % 100 = 7").select("idx", (-F.col("v")).alias("v")))
    z.merge(spark)
    z.set(t.df.where("idx % 1000 = 8").select("idx", F.lit(0.5).alias("v")))
    return z.tensor(spark).df


# -- balancing ------------------------------------------------------------------------------------------------------------------------

WORKERS = """
WITH w AS (
  SELECT user_id % 8 AS worker_id, count(*) AS ops, sum(value) AS used, count(*) % 90 AS queue, avg(value) / 100 AS busy, floor(max(epoch(ts)))::BIGINT AS seen,
         (user_id % 8 * 3) % 5 AS assigned FROM events GROUP BY user_id % 8),
b AS (SELECT *, CASE worker_id % 5 WHEN 0 THEN 0.5::DOUBLE WHEN 1 THEN 0.3 WHEN 2 THEN 0.8 WHEN 3 THEN 0.6 ELSE 0.7 END AS base FROM w),
s AS (
  SELECT worker_id, queue, assigned, worker_id <> 3 AS healthy, greatest(0, least(1, base * (0.3 * least(1, ops / 1000::DOUBLE) + 0.3 * (used / (used + 1000)))
    * (1 - 0.2::DOUBLE * least(1, queue / 100::DOUBLE)) * (1 - 0.2::DOUBLE * busy)) ) AS score, seen FROM b)
"""


def workers(spark, d) -> DataFrame:
    """Eight workers made of the users' events: worker user_id mod 8."""
    w = load(spark, d, "events").groupBy((F.col("user_id") % 8).alias("worker_id")).agg(
        F.count(F.lit(1)).alias("ops"), F.sum("value").alias("used"), (F.avg("value") / 100).alias("busy"), F.max(F.col("ts").cast("timestamp").cast("long")).alias("seen")
    )
    w = w.withColumn("queue", F.col("ops") % 90).withColumn("assigned", F.col("worker_id") * 3 % 5).withColumn("healthy", F.col("worker_id") != 3)
    backend = F.element_at(F.array(*map(F.lit, ("dense", "mmap", "cuda", "opengl", "opencl"))), (F.col("worker_id") % 5 + 1).cast("int"))
    return w.withColumn("score", balance.capacity_score(backend, F.col("ops"), F.col("used"), F.col("used") + 1000, F.col("queue"), F.col("busy")))


@query(WORKERS + "SELECT worker_id, round(score, 6) AS score FROM s")
def heartbeat_capacity(spark, d):
    return rounded(workers(spark, d).select("worker_id", "score"), "score")


@query(WORKERS + "SELECT worker_id, worker_id <> 3 AND (SELECT max(seen) FROM s)::BIGINT - seen::BIGINT < 3600 AS alive FROM s")
def liveness(spark, d):
    w = workers(spark, d)
    now = w.agg(F.max("seen").alias("now"))
    status = F.when(F.col("healthy"), "RUNNING").otherwise("FAILED")
    return w.crossJoin(F.broadcast(now)).select("worker_id", balance.alive(status, F.col("seen"), F.col("now"), 3600).alias("alive"))


@query(WORKERS + "SELECT worker_id FROM s WHERE healthy ORDER BY score DESC, worker_id LIMIT 1")
def assign_capacity(spark, d):
    return balance.by_capacity(workers(spark, d))


@query(WORKERS + "SELECT worker_id FROM s WHERE healthy ORDER BY 0.6 * queue + 0.4 * assigned, worker_id LIMIT 1")
def assign_least_connections(spark, d):
    return balance.by_connections(workers(spark, d))


@query(WORKERS + ", h AS (SELECT worker_id, row_number() OVER (ORDER BY worker_id) - 1 AS n, count(*) OVER () AS k FROM s WHERE healthy) SELECT doc_id AS shard_id, h.worker_id FROM documents, h WHERE doc_id % k = n")
def assign_round_robin(spark, d):
    return balance.by_turn(load(spark, d, "documents").select(F.col("doc_id").alias("shard_id")), workers(spark, d))


@query(WORKERS + ", h AS (SELECT * FROM s WHERE healthy) SELECT a.worker_id FROM h a LEFT JOIN h b ON a.worker_id <> b.worker_id GROUP BY a.worker_id, a.queue, a.assigned, a.score ORDER BY greatest((a.queue + a.assigned + 1) / a.score, max((b.queue + b.assigned) / b.score)), a.worker_id LIMIT 1")
def assign_minmax_fairness(spark, d):
    return balance.by_fairness(workers(spark, d))


NUMBER = "('0x' || substr(md5('{}:' || doc_id), 1, 15))::BIGINT"
LISTED = WORKERS + ", h AS (SELECT list(worker_id ORDER BY worker_id) AS w, list(CASE WHEN score > 0 THEN (queue + assigned) / score ELSE queue + assigned END ORDER BY worker_id) AS l, count(*) AS n FROM s WHERE healthy)"


@query(LISTED + f", c AS (SELECT doc_id, w, l, n, {NUMBER.format(42)} % n AS a, ({NUMBER.format(42)} % n + 1 + {NUMBER.format(43)} % (n - 1)) % n AS b FROM documents, h) SELECT doc_id AS shard_id, CASE WHEN l[a + 1] <= l[b + 1] THEN w[a + 1] ELSE w[b + 1] END AS worker_id FROM c")
def assign_two_choices(spark, d):
    return balance.by_two_choices(load(spark, d, "documents").select(F.col("doc_id").alias("shard_id")), workers(spark, d))


@query(LISTED + f" SELECT doc_id AS shard_id, w[{NUMBER.format(0)} % n + 1] AS worker_id FROM documents, h")
def assign_hash(spark, d):
    return balance.by_hash(load(spark, d, "documents").select(F.col("doc_id").alias("shard_id")), workers(spark, d))


EWMA = """
WITH RECURSIVE b AS (SELECT user_id % 8 AS worker_id, row_number() OVER (PARTITION BY user_id % 8 ORDER BY event_id) AS n, event_id % 40 + (1 - value / 200) * 100 AS x FROM events),
f AS (
  SELECT worker_id, n, x AS load FROM b WHERE n = 1
  UNION ALL
  SELECT b.worker_id, b.n, CASE WHEN f.load = 0 THEN b.x ELSE 0.3::DOUBLE * b.x + (1 - 0.3::DOUBLE) * f.load END FROM f JOIN b ON b.worker_id = f.worker_id AND b.n = f.n + 1)
SELECT worker_id, round(load, 6) AS load FROM f QUALIFY n = max(n) OVER (PARTITION BY worker_id)
"""


@query(EWMA)
def predicted_load(spark, d):
    beats = load(spark, d, "events").select((F.col("user_id") % 8).alias("worker_id"), F.col("event_id").alias("at"), (F.col("event_id") % 40).alias("queue"), (F.col("value") / 200).alias("score"))
    return rounded(balance.smoothed_load(beats), "load")


PREDICTED = WORKERS.replace("WITH w AS", "WITH RECURSIVE w AS").rstrip() + """,
beats AS (SELECT user_id % 8 AS worker_id, row_number() OVER (PARTITION BY user_id % 8 ORDER BY event_id) AS n, event_id % 40 + (1 - value / 200) * 100 AS x FROM events),
f AS (
  SELECT worker_id, n, x AS load FROM beats WHERE n = 1
  UNION ALL
  SELECT t.worker_id, t.n, CASE WHEN f.load = 0 THEN t.x ELSE 0.3::DOUBLE * t.x + (1 - 0.3::DOUBLE) * f.load END FROM f JOIN beats t ON t.worker_id = f.worker_id AND t.n = f.n + 1),
p AS (SELECT worker_id, load FROM f QUALIFY n = max(n) OVER (PARTITION BY worker_id))
SELECT s.worker_id FROM s LEFT JOIN p ON s.worker_id = p.worker_id WHERE healthy
ORDER BY CASE WHEN score > 0 THEN (coalesce(load, 0) + assigned) / score ELSE coalesce(load, 0) + assigned END, s.worker_id LIMIT 1
"""


@query(PREDICTED)
def assign_predictive(spark, d):
    beats = load(spark, d, "events").select((F.col("user_id") % 8).alias("worker_id"), F.col("event_id").alias("at"), (F.col("event_id") % 40).alias("queue"), (F.col("value") / 200).alias("score"))
    return balance.by_prediction(workers(spark, d), balance.smoothed_load(beats))


def experts(spark, d) -> DataFrame:
    """32 experts, loaded by the events of the users that fall to them."""
    return load(spark, d, "events").groupBy((F.col("user_id") % 32).alias("expert_id")).agg(F.round(F.sum("value"), 3).alias("load"))


def placed_sql(nodes: int, group: int, redundant: int, last: str) -> str:
    """Experts of each node, largest first, to the worker with least load; then the largest again to another one, at half the load."""
    return f"""
WITH RECURSIVE e AS (SELECT user_id % 32 AS expert_id, round(sum(value), 3) AS load FROM events GROUP BY 1),
m AS (SELECT *, CASE WHEN {nodes} > 1 AND count(*) OVER () % {group} = 0 THEN {nodes} ELSE 1 END AS nodes, count(*) OVER () AS experts FROM e),
d AS (SELECT *, CASE WHEN nodes = 1 THEN 0 ELSE least(expert_id // {group} // greatest(1, experts // {group} // nodes), nodes - 1) END AS node, 8 // nodes AS each FROM m),
o AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY load DESC, expert_id) AS k, count(*) OVER (PARTITION BY node) AS n FROM d),
r AS (
  SELECT DISTINCT node, n, each, 0::BIGINT AS k, 0::BIGINT AS expert_id, 0::BIGINT AS w, [0.0::DOUBLE for i in range(each)] AS total, []::BIGINT[] AS has FROM o
  UNION ALL
  SELECT node, n, each, k, expert_id, w, [total[i] + CASE WHEN i = w THEN add ELSE 0 END for i in range(1, each + 1)], list_append(has, w)
  FROM (
    SELECT *, list_position(free, list_min(free)) AS w FROM (
      SELECT r.node, r.n, r.each, r.k + 1 AS k, o.expert_id, CASE WHEN r.k < r.n THEN o.load ELSE o.load / 2 END AS add, total, has,
             [CASE WHEN r.k >= r.n AND i = has[r.k - r.n + 1] THEN 1e300::DOUBLE ELSE total[i] END for i in range(1, r.each + 1)] AS free
      FROM r JOIN o ON o.node = r.node AND o.k = CASE WHEN r.k < r.n THEN r.k + 1 ELSE r.k - r.n + 1 END WHERE r.k < r.n + {redundant}))),
p AS (SELECT r.expert_id, r.node * r.each + r.w - 1 AS worker_id, o.load / CASE WHEN o.k <= {redundant} THEN 2 ELSE 1 END AS load FROM r JOIN o ON o.node = r.node AND o.expert_id = r.expert_id WHERE r.k > 0)
{last}
"""


@query(placed_sql(1, 1, 4, "SELECT * FROM p"))
def expert_lpt(spark, d):
    return balance.balance_experts(experts(spark, d), workers=8, redundant=4)


@query(placed_sql(2, 4, 2, "SELECT * FROM p"))
def expert_hierarchical(spark, d):
    return balance.balance_experts(experts(spark, d), workers=8, nodes=2, group_size=4, redundant=2)


@query(placed_sql(1, 1, 4, "SELECT worker_id, count(*) AS experts, round(sum(load), 4) AS load FROM p GROUP BY 1"))
def expert_worker_loads(spark, d):
    return rounded(balance.worker_loads(balance.balance_experts(experts(spark, d), workers=8, redundant=4)), "load", to=4)


STICKY = WORKERS.replace("WITH w AS", "WITH RECURSIVE w AS") + """,
c AS (SELECT list(queue ORDER BY worker_id) AS q, list(assigned ORDER BY worker_id) AS a, list(healthy ORDER BY worker_id) AS h FROM s),
r AS (
  SELECT -1 AS k, 0::BIGINT AS got, q, a, h, []::BIGINT[] AS held FROM c
  UNION ALL
  SELECT k, got, q, [a[i] + CASE WHEN fresh AND i = got + 1 THEN 1 ELSE 0 END for i in range(1, 9)], able, CASE WHEN k < 25 THEN list_append(held, got) ELSE held END
  FROM (
    SELECT *, fresh_ AS fresh, CASE WHEN fresh_ THEN list_position(cost, list_min(cost)) - 1 ELSE held[k - 24] END AS got FROM (
      SELECT *, k < 25 OR NOT able[held[greatest(k - 24, 1)] + 1] AS fresh_, [CASE WHEN able[i] THEN 0.6::DOUBLE * q[i] + 0.4::DOUBLE * a[i] ELSE 1e9 END for i in range(1, 9)] AS cost FROM (
        SELECT k + 1 AS k, q, a, held, CASE WHEN k + 1 >= 25 THEN [h[i] AND i <> 1 for i in range(1, 9)] ELSE h END AS able FROM r WHERE k < 49))))
SELECT CASE WHEN k < 25 THEN k ELSE k + 975 END AS at, k % 25 AS shard_id, got AS worker_id FROM r WHERE k >= 0
"""


@query(STICKY)
def sticky_assign(spark, d):
    """Nations ask for a worker, and again after worker 0 has failed."""
    asks = load(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("shard_id"))
    once = asks.select(F.col("shard_id").alias("at"), "shard_id", F.lit(None).cast("long").alias("failed"))
    again = asks.select((F.col("shard_id") + 1000).alias("at"), "shard_id", F.when(F.col("shard_id") == 0, 0).cast("long").alias("failed"))
    return balance.assign(once.union(again), workers(spark, d).select("worker_id", "score", "queue", "assigned", "healthy"))


# -- executors ------------------------------------------------------------------------------------------------------------------------


@query("SELECT event_id AS idx, value * (event_id % 16 + 1) AS v FROM events")
def worker_forward(spark, d):
    w = spark.range(16).select(F.col("id").alias("k"), (F.col("id") + 1.0).alias("w"))
    return executors.worker_forward(events(spark, d).df, w, 16)


@query("SELECT (event_id % 4)::INT AS rank, event_id AS idx, value * (event_id % 4 + 1) AS v FROM events")
def data_parallel(spark, d):
    parts_ = events(spark, d).df.withColumn("rank", (F.col("idx") % 4).cast("int"))
    w = spark.range(32).select((F.col("id") % 4).cast("int").alias("rank"), F.floor(F.col("id") / 4).alias("k"), (F.col("id") % 4 + 1.0).alias("w"))
    return executors.data_parallel(parts_, w, 8)


@query("SELECT event_id AS idx, round(value * 2.5, 6) AS v FROM events")
def tensor_parallel(spark, d):
    t = events(spark, d)
    w = spark.range(4).select(F.col("id").cast("int").alias("rank"), F.lit(0).cast("long").alias("k"), (F.col("id") + 1.0).alias("w"))
    return rounded(executors.tensor_parallel(t.df, w, w, t.size, 1, 1)[1])


@query("SELECT event_id AS idx, (value * 2 + 1) * 0.5 AS v FROM events")
def pipeline_parallel(spark, d):
    on = lambda f: lambda df: df.withColumn("v", f(F.col("v")))
    return executors.pipeline(events(spark, d), [on(lambda v: v * 2.0), on(lambda v: v + 1.0), on(lambda v: v * 0.5)])


@query(f"WITH x AS ({CELLS}), w AS (SELECT i, j, ({WEIGHT})::DOUBLE AS v FROM (SELECT range // 16 AS i, range % 16 AS j FROM range(1024))) SELECT x.i, w.j, round(sum(x.v * w.v), 5) AS v FROM x JOIN w ON x.j = w.i GROUP BY x.i, w.j")
def fsdp_forward(spark, d):
    w = weights(spark, DIM, 16).withColumn("rank", (F.col("i") % 4).cast("int"))
    return rounded(executors.sharded_linear(cells(spark, d), w), to=5)


@query(f"WITH x AS ({CELLS}) SELECT x.i AS token, x.j AS dim, round(x.v * (e.label + 1) * 0.5::DOUBLE, 6) AS v FROM x JOIN embeddings e ON x.i = e.vec_id")
def expert_parallel(spark, d):
    gates = load(spark, d, "embeddings").select(F.col("vec_id").alias("token"), F.explode(F.sequence(F.lit(0), F.lit(9))).alias("expert"), F.col("label")).select("token", "expert", F.when(F.col("expert") == F.col("label"), 0.5).otherwise(0.1).alias("gate"))
    scale = spark.range(10 * DIM).select(F.floor(F.col("id") / DIM).cast("int").alias("expert"), (F.col("id") % DIM).alias("dim"), (F.floor(F.col("id") / DIM) + 1.0).alias("w"))
    return rounded(executors.expert_parallel(cells(spark, d).toDF("token", "dim", "v"), gates, scale))


# -- streams --------------------------------------------------------------------------------------------------------------------------


@query("SELECT worker_id, floor(epoch(min(ts)))::BIGINT AS first, floor(epoch(max(ts)))::BIGINT AS last, count(*) AS beats FROM (SELECT *, sum(fresh) OVER (PARTITION BY worker_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT user_id % 8 AS worker_id, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id % 8 ORDER BY ts, event_id) < INTERVAL 600 SECOND THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY worker_id, g")
def heartbeat_gaps(spark, d):
    beats = load(spark, d, "events").select((F.col("user_id") % 8).alias("worker_id"), F.col("ts").cast("timestamp").alias("ts"))
    out = heartbeats.gaps(beats, timeout_s=600)
    return out.select("worker_id", F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"), "beats")


@query("SELECT (floor(epoch(ts))::BIGINT // 3600 * 3600)::BIGINT AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_windowed(spark, d):
    """The events as a stream of files, to the end, with hourly windows; each batch's result replaces the one before it on disk."""
    schema = load(spark, d, "events").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))
    path = own_path(spark, "windows")
    keep = lambda batch, _: batch.write.mode("overwrite").parquet(f"{path}/now")
    run = heartbeats.windowed(source).writeStream.outputMode("complete").option("checkpointLocation", f"{path}/state").foreachBatch(keep).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(f"{path}/now").select(F.col("start").cast("long").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))
