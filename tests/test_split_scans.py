import pytest
from pyspark.sql import functions as F

from millrace.sources.files import key_ranges, read_split


def filled(spark, tmp_path, name, keys):
    url = f"jdbc:derby:{tmp_path}/{name};create=true"
    keys.select(F.col("k").cast("long").alias("k"), F.md5(F.col("k").cast("string")).alias("v")).coalesce(1).write.format("jdbc").options(url=url, dbtable="t", batchsize=10_000).save()
    return url


@pytest.mark.parametrize("shape", ["even", "crowded", "sparse"])
def test_ranges_hold_equal_parts(spark, tmp_path, shape):
    """Even keys; nine tenths within a millionth of the span; keys that grow by powers."""
    i = F.col("id")
    key = {"even": i * 3 - 500, "crowded": F.when(i < 3600, i).otherwise(i * 10**9), "sparse": F.floor(F.pow(F.lit(1.009), i))}[shape]
    keys = spark.range(4000).select(key.alias("k")).distinct()
    n = keys.count()
    url = filled(spark, tmp_path, shape, keys)
    df = read_split(spark, url, "t", '"k"', 8)
    sizes = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == n and df.select("k").distinct().count() == n
    assert len(sizes) == df.rdd.getNumPartitions() and max(sizes) <= 2 * n / 8 and min(sizes) >= n / 8 / 2


def test_one_key_nulls_and_empty_tables(spark, tmp_path):
    keys = spark.range(600).select(F.when(F.col("id") < 400, 7).when(F.col("id") < 500, F.col("id")).alias("k"))
    url = filled(spark, tmp_path, "one", keys)
    ranges, without = key_ranges(spark, url, "t", '"k"', 4)
    assert without == 100 and any(a <= 7 < b for a, b in ranges) and all(a < b for a, b in ranges)
    df = read_split(spark, url, "t", '"k"', 4)
    assert df.count() == 600 and df.where("k = 7").count() == 400 and df.where("k is null").count() == 100
    none = filled(spark, tmp_path, "none", keys.where("k < 0"))
    assert key_ranges(spark, none, "t", '"k"', 4) == ([], 0) and read_split(spark, none, "t", '"k"', 4).count() == 0
