import os
from types import SimpleNamespace

import numpy as np
import pytest

from weftline.llm import store


def test_files_of_several_arrays(tmp_path):
    uri = tmp_path.as_uri()
    arrays = {"a": np.arange(10, dtype=np.uint64), "b": np.empty(0, np.uint8), "c": np.array([1, 2], np.int32)}
    store.put(uri, "one", **arrays)
    store.put(uri, "one", **arrays)
    got = store.get(uri, "one")
    assert list(got) == ["a", "b", "c"] and all((got[k] == v).all() and got[k].dtype == v.dtype for k, v in arrays.items())
    assert os.listdir(tmp_path) == ["one"]


def test_files_kept_are_few_and_hold_no_descriptors(tmp_path):
    uri = tmp_path.as_uri()
    for i in range(300):
        store.put(uri, str(i), a=np.full(100, i))
    files = store.Files(uri, most=16)
    before = len(os.listdir("/proc/self/fd"))
    for i in [*range(300), *range(0, 300, 7)]:
        assert (files(str(i))["a"] == i).all()
    assert len(files.kept) == 16 and len(os.listdir("/proc/self/fd")) <= before + 16
    files = store.Files(uri, most_bytes=3000)
    files.mapped = False
    for i in range(20):
        files(str(i))
    assert len(files.kept) == 3 and files.size <= 3000


def test_no_folder_of_one_machine_on_a_cluster():
    conf = SimpleNamespace(get=lambda *_: None)
    context = SimpleNamespace(getConf=lambda: conf, master="spark://host:7077", _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: SimpleNamespace(isDefined=lambda: False))))
    with pytest.raises(ValueError):
        store.root(SimpleNamespace(conf=conf, sparkContext=context))


def test_tables_are_forgotten(spark):
    table = store.written(spark, spark.range(5), "test")
    path = table._stored.removeprefix("file://")
    assert os.path.isdir(path) and table.count() == 5
    store.forget(table, spark.range(1))
    assert not os.path.exists(path)
