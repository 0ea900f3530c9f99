"""Each record is read once by its types, and as texts only beside it, whatever columns and filters follow."""

from tracelens.plans import catalog


def test_records_are_read_once(spark):
    plan = catalog.QUERIES["src_csv_jobs"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert 1 <= plan.count("from_csv(") <= 2
