"""Row-wise helpers run unchanged on a streaming DataFrame."""

from pyspark.sql import functions as F

from wardtable.functions import expressions as X
from wardtable.operators import columns as C


def test_stateless_helpers_on_a_stream(spark, tmp_path):
    spark.createDataFrame([(1, "38.5 C"), (2, None)], "id int, t string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id int, t string").parquet(str(tmp_path / "in"))
    shaped = C.prefix_columns(stream.withColumn("t", X.temperature_class(X.first_number(F.col("t")))), "v_", ["id"])
    q = (
        shaped.writeStream.format("parquet").option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    )
    q.awaitTermination(120)
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(1, 2), (2, None)]
