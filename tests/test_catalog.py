"""The registered queries cut their data into many slices."""

import os

import pytest
from pyspark.sql import functions as F

FOLDER = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the given tables")
def test_queries_cross_slice_borders(spark):
    import catalog
    from zonewatch.operators.timeline import slice_frames, slice_us

    frames = catalog.Views(spark, FOLDER).frames
    n = frames.agg(F.count_distinct(F.expr(f"us div {slice_us()}L")), F.count_distinct(F.expr(f"seq div {slice_frames()}L"))).first()
    spark.conf.unset("zonewatch.slice.seconds")
    spark.conf.unset("zonewatch.slice.frames")
    assert n[0] > 10 and n[1] > 5
