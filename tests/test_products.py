"""Products of sparse matrices: their work follows the cells that meet, not the numbers of rows and columns."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

from tessera import queries
from tessera.operators import blocks


def test_orders_with_far_keys(spark, tmp_path):
    """As in SQL: numbers far apart, sums of 0, null quantities and keys, lines that occur twice, an order with many lines."""
    far = 1 << 40
    lines = [(k % 40, (k * 7 % 23) * far, (k * 5 % 11) * far, k % 7, float(k % 50)) for k in range(600)]
    lines += [(50, far, far, 1, 0.0), (51, far + 1, far, 2, None), (52, None, 3, 4, 5.0), (52, 6, None, 4, 5.0), (None, 1, 1, 1, 1.0), (53, 9, far, 3, 2.0), (53, 9, far, 3, 2.0)]
    lines += [(54, k, -k, 1, 1.0) for k in range(60)]
    names = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity")
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.float64())
    pq.write_table(pa.table({n: pa.array(c, t) for n, c, t in zip(names, zip(*lines, strict=True), kinds, strict=True)}), tmp_path / "lineitem.parquet")
    con = duckdb.connect()
    con.sql(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet'")
    key = lambda x: tuple((v is not None, v or 0) for v in x)
    want = sorted(con.sql(queries.ORACLES["matmul_of_orders"]).fetchall(), key=key)
    assert sorted((tuple(r) for r in queries.matmul_of_orders(spark, str(tmp_path)).select("i", "j", "v").collect()), key=key) == want


def test_cells_that_occur_many_times_meet_once(spark):
    a = spark.range(200_000).selectExpr("1000000000000L as i", "3L as j", "1.0D as v")
    assert [tuple(r) for r in blocks.sparse_product(a, a, ("i", "j"), ("i", "j")).collect()] == [(10**12, 10**12, 4e10)]
