import numpy as np
from pyspark.sql import functions as F

from tabulon import MinMaxScaler, StandardScaler
from tabulon.streaming import fit_stream, running_moments


def test_stream_fits(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id", "value")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    x = np.array([r[0] for r in events.select("value").collect()])
    for name, s in (("s", StandardScaler()), ("m", MinMaxScaler())):
        stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        fit_stream(s, stream, ["value"], str(tmp_path / name), availableNow=True).awaitTermination()
        assert s.n_samples_seen_ == len(x)
        if name == "s":
            np.testing.assert_allclose([s.mean_[0], s.var_[0]], [x.mean(), x.var()], rtol=1e-12)
        else:
            assert (s.data_min_[0], s.data_max_[0]) == (x.min(), x.max())


def test_running_moments(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id", "value")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = running_moments(stream, ["value"]).writeStream.outputMode("complete").format("memory").queryName("running").trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.table("running").first()
    want = events.agg(F.count("value"), F.avg("value"), F.var_pop("value")).first()
    np.testing.assert_allclose([got["n"], got["mean"], got["var"]], list(want), rtol=1e-12)
