"""Scratch tables in the shared folder."""
import os

from venturelens.session import discard, written


def test_discard_removes_only_what_written_made(spark, tmp_path):
    kept = written(spark.range(5), "kept")
    gone = written(spark.range(7), "gone")
    path = gone._scratch.removeprefix("file:")
    assert os.path.isdir(path) and gone.count() == 7
    own = str(tmp_path / "own")
    spark.range(3).write.parquet(own)
    discard(gone, gone.where("id > 3"), spark.read.parquet(own))
    assert not os.path.exists(path) and kept.count() == 5 and spark.read.parquet(own).count() == 3
