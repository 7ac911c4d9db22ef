"""Derived tables follow their inputs; scratch folders are shared or refused."""
import pytest
from pyspark.sql import functions as F

from lotwise import session as S


def test_a_derived_table_follows_each_of_its_inputs(spark, tmp_path):
    paths = [str(tmp_path / name) for name in "ab"]
    for path in paths:
        spark.range(3).write.parquet(path)
    read = lambda: [spark.read.parquet(path) for path in paths]
    total = lambda: S.stored(spark, str(tmp_path / "t"), lambda: read()[0].unionByName(read()[1]).agg(F.sum("id").alias("s")), read()).first().s
    assert total() == 6
    spark.range(5).write.mode("overwrite").parquet(paths[1])
    assert total() == 13
    spark.range(4).write.mode("append").parquet(paths[0])
    assert total() == 19


@pytest.mark.parametrize("root,master,default_fs,fine", [
    ("file:/w/_scratch", "local[8]", "file:///", True), ("/w/_scratch", "spark://h:7077", "hdfs://n", True), ("hdfs://n/w", "yarn", "file:///", True),
    ("s3a://bucket/w", "k8s://x", "file:///", True), ("file:/w/_scratch", "yarn", "hdfs://n", False), ("/w/_scratch", "spark://h:7077", "file:///", False)])
def test_a_local_folder_is_refused_on_a_cluster(root, master, default_fs, fine):
    if fine:
        S.require_shared(root, master, default_fs)
    else:
        with pytest.raises(ValueError):
            S.require_shared(root, master, default_fs)
