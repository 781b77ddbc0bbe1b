"""Tables in the shared folder come back whole and go with their scope."""

import os

from tallymill import store


def test_keep_and_scope(spark):
    with store.scope() as made:
        df = store.keep(spark.range(100).selectExpr("id", "id % 3 AS x"), "t")
        assert df.filter("x = 1").count() == 33
    assert len(made) == 1
    folder = made[0].removeprefix("file:")
    assert os.path.isdir(folder)
    store.drop(spark, made)
    assert not os.path.exists(folder) and not made
