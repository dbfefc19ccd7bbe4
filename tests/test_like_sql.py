"""Results to the last digit as SQL gives them, on values where engines differ."""

import duckdb
from pyspark.sql import functions as F

from basketry.functions.scalars import half_up
from basketry.operators.distributed import exact_quantiles


def test_half_up_scales_before_it_rounds(spark):
    values = [1.0328125, 33.05 / 32, 16.65 / 32, 65.99 / 32, 0.0003125, -0.0003125, 2.5e-7]
    rows = spark.createDataFrame(list(enumerate(values)), "i int, v double")
    ours = [r[0] for r in rows.orderBy("i").select(half_up(F.col("v"), 6)).collect()]
    con = duckdb.connect()
    theirs = [con.execute("SELECT round(?::DOUBLE, 6)", [v]).fetchall()[0][0] for v in values]
    assert ours == theirs


def test_quantiles_to_the_last_bit(spark):
    groups = [[3.33, 4.04], [3.88, 3.96], [76.26, 105.73], [4.52, 6.24, 7.1], [2.44, 4.15, 9.3, 11.07], [35.71, 49.04], [8.0], [0.0, 0.1]]
    rows = [(g, v) for g, values in enumerate(groups) for v in values]
    shares = {"a": 0.25, "b": 0.5, "c": 0.75}
    ours = exact_quantiles(spark.createDataFrame(rows, "g int, v double"), ["g"], "v", shares).orderBy("g").collect()
    con = duckdb.connect()
    con.execute("CREATE TABLE t (g INT, v DOUBLE)")
    con.executemany("INSERT INTO t VALUES (?, ?)", rows)
    theirs = con.execute("SELECT g, quantile_cont(v, 0.25), quantile_cont(v, 0.5), quantile_cont(v, 0.75) FROM t GROUP BY g ORDER BY g").fetchall()
    assert [tuple(r) for r in ours] == theirs
