"""The shared folder."""

import os

from seqweave.session import clear_work, lasting_path, open_output, shared_dir, work_dir, written


def test_written_tables_and_cleaning(spark):
    df = written(spark.createDataFrame([(1, "a"), (None, None)], "n int, s string"), "here")
    assert sorted(map(str, df.collect())) == sorted(map(str, spark.createDataFrame([(1, "a"), (None, None)], "n int, s string").collect()))
    assert written(df.limit(0), "none").count() == 0
    own = shared_dir(spark)
    assert shared_dir(spark) == own and os.listdir(own + "/seqweave")
    kept, other = lasting_path(spark, "kept"), own + "/seqweave/other-application/x"
    for path in (kept, other):
        with open_output(spark, path) as f:
            f.write(b"1")
    clear_work(spark)
    assert not os.path.exists(work_dir(spark)) and open(kept).read() == open(other).read() == "1"
