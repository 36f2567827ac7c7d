"""The shared folder: what steps leave there and what goes."""

import os

from seqloom import storage


def _folders(spark):
    root = storage.checkpoint_root(spark).removeprefix("file:")
    return set(os.listdir(f"{root}/seqloom")) if os.path.isdir(f"{root}/seqloom") else set()


def test_settled_keeps_the_result_alone(spark):
    before = _folders(spark)

    def make():
        inner = storage.settled(spark, "inner", lambda: storage.stored(spark.range(5), "deepest").filter("id > 1"))
        return storage.stored(inner, "middle").union(storage.stored(spark.range(1), "other"))

    found = storage.settled(spark, "result", make)
    assert sorted(r.id for r in found.collect()) == [0, 2, 3, 4]
    new = _folders(spark) - before
    assert len(new) == 1 and new.pop().startswith("result-")


def test_settled_clears_up_after_an_error(spark):
    before = _folders(spark)
    try:
        storage.settled(spark, "result", lambda: storage.stored(spark.range(3), "middle").select("nothing_of_the_kind"))
    except Exception as e:
        assert "nothing_of_the_kind" in str(e)
    assert _folders(spark) == before
