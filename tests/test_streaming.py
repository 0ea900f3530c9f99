"""A stream over files gives what the closed table gives, for the hours that its watermark has passed."""

from tracelens.sources.views import Tables
from tracelens.streaming import series

SF = "/root/testdata/sf0.001"


def test_streams_equal_tables(spark, tmp_path):
    t = Tables(spark, SF)
    for name, f, source, time in (("hourly", series.hourly, t.jobs, "hour"), ("bursts", lambda j: series.bursts(j, 0), t.jobs, "minute"), ("once", series.once, t.telemetry, "ts"), ("sessions", series.high_sessions, t.telemetry, "last")):
        source.coalesce(1).write.parquet(f"{tmp_path}/{name}/in")
        stream = f(spark.readStream.schema(source.schema).parquet(f"{tmp_path}/{name}/in"))
        q = stream.writeStream.format("parquet").option("path", f"{tmp_path}/{name}/out").option("checkpointLocation", f"{tmp_path}/{name}/state").trigger(availableNow=True).start()
        q.awaitTermination()
        got = {tuple(r) for r in spark.read.parquet(f"{tmp_path}/{name}/out").collect()}
        want = {tuple(r) for r in f(source).collect()}
        assert got and got <= want, name
        at = stream.columns.index(time)
        end = max(r[at] for r in want)
        assert {r for r in want if (end - r[at]).days >= 3} <= got, name
