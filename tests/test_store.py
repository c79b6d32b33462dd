import pytest

from weightlake.operators import catalog
from weightlake.plans import store


def test_versions(spark, tmp_path):
    root = str(tmp_path / "store")
    with pytest.raises(FileNotFoundError):
        store.load(root, spark)
    first = spark.createDataFrame([("a", 10), ("b", 20)], "name string, original_size long")
    assert store.save(first, root) == 1
    more = spark.createDataFrame([("b", 25), ("c", 30)], "name string, original_size long")
    assert store.save(catalog.upsert(store.load(root, spark), more), root) == 2
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(store.load(root, spark)) == [("a", 10), ("b", 25), ("c", 30)]
    assert rows(store.load(root, spark, 1)) == [("a", 10), ("b", 20)]


def test_failed_saving_leaves_the_last_version(spark, tmp_path):
    root = str(tmp_path / "store")
    store.save(spark.range(3), root)
    with pytest.raises(Exception):
        store.save(spark.range(3).selectExpr("raise_error('no') AS id"), root)
    assert store.versions(root, spark) == [1] and store.load(root, spark).count() == 3
    assert [p.name for p in (tmp_path / "store").iterdir()] == ["version=1"]
