"""Profiles of arriving files: totals add up, and a restarted query resumes
from its checkpoint without re-profiling committed batches."""

import os
import tempfile

from tablelens.streaming.arrivals import profile_arrivals, read_batches, running_counts

from paths import SF_SMALL


def test_arrivals_resume_and_add_up(spark):
    base = tempfile.mkdtemp(prefix="tl-stream-")
    src, out, ckpt = (os.path.join(base, d) for d in ("src", "out", "ckpt"))
    orders = spark.read.parquet(f"{SF_SMALL}/orders.parquet")
    orders.repartition(3).write.parquet(os.path.join(src, "part1"))
    opts = dict(sections=False, top_k=0, correlations=False)

    def run():
        q = profile_arrivals(spark, src + "/*", orders.schema, out, checkpoint_location=ckpt,
                             files_per_batch=1, **opts)
        q.awaitTermination()

    run()
    first = read_batches(spark, out).select("batch_id").distinct().count()
    assert first == 3
    run()  # nothing new: no batch is profiled again
    assert read_batches(spark, out).select("batch_id").distinct().count() == first
    orders.repartition(2).write.parquet(os.path.join(src, "part2"))
    run()  # only the new files
    totals = {r["column_name"]: r for r in running_counts(spark, out).collect()}
    n = orders.count()
    assert totals["o_orderkey"]["record_count"] == 2 * n
    assert totals["o_orderkey"]["batches"] == 5


def test_streamed_files_are_not_small(spark, tmp_path, monkeypatch):
    """Batches are counted in files: small files make many batches of the same fixed cost."""
    import os

    from pyspark.sql import functions as F

    from tablelens.plans import catalog, fixtures
    from tablelens.streaming import arrivals

    row = spark.range(0, 50_000, 1, 1)
    row.select(*[F.col("id").cast(t).alias(n) if t in ("bigint", "int", "double") else F.lit("2020-01-01").cast(t).alias(n)
                 for n, t in fixtures.TABLES["lineitem"]]).write.parquet(f"{tmp_path}/lineitem.parquet")

    class Stop(Exception):
        pass

    def seen(spark, src, *args, **options):
        raise Stop(len([f for f in os.listdir(src) if f.endswith(".parquet")]))

    monkeypatch.setattr(arrivals, "profile_arrivals", seen)
    for query in ("stream_state", "stream_profile"):
        try:
            catalog.QUERIES[query](spark, str(tmp_path))
            assert False
        except Stop as e:
            assert e.args == (1,)
