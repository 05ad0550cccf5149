"""Scratch tables live as long as what reads them."""

from __future__ import annotations

import os

import pytest

from tessera import scratch


def there(table) -> bool:
    return os.path.isdir(table.scratch_path.removeprefix("file://"))


def test_owners_keep_what_is_read(spark):
    with scratch.owner() as outer:
        a = scratch.materialize(spark.range(3), "a")
        with scratch.owner() as inner:
            b, c = scratch.materialize(spark.range(4), "b"), scratch.materialize(spark.range(5), "c")
            inner.keep(c)
        assert there(a) and not there(b) and there(c) and c.count() == 5
        outer.keep(a)
        assert there(a) and not there(c)
    assert a.count() == 3
    scratch.discard(a)
    assert not there(a)


def test_an_error_deletes(spark):
    with pytest.raises(KeyError), scratch.owner():
        a = scratch.materialize(spark.range(3), "a")
        raise KeyError
    assert not there(a)


def test_no_local_folder_on_a_cluster(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

    class Session:
        conf, sparkContext = {}, Context()

    with pytest.raises(RuntimeError, match="checkpoint.dir"):
        scratch.shared_root(Session())
    Context.master = "local-cluster[2,1,1024]"
    with pytest.raises(RuntimeError, match="checkpoint.dir"):
        scratch.shared_root(Session())
