"""Quarantine, recovery markers, single files and counters."""

import pytest

from weft.operators import overview
from weft.runtime import new_path
from weft.sources import recovery as R


def test_corrupt_table(spark, rows):
    path = new_path(spark, "index")
    assert rows(R.open_table(spark, path, "a long", 1)) == [] and R.recovered_at(spark, path) is None
    spark.range(3).withColumnRenamed("id", "a").coalesce(1).write.parquet(path)
    assert rows(R.open_table(spark, path, "a long", 1)) == [(0,), (1,), (2,)]
    spark.createDataFrame([("no parquet",)], "value string").coalesce(1).write.mode("overwrite").text(path)
    fs, of = R._files(spark, path)
    part = next(s.getPath() for s in fs.listStatus(of(path)) if s.getPath().getName().startswith("part-"))
    fs.rename(part, of(path + "/part-0.parquet"))
    assert rows(R.open_table(spark, path, "a long", 7)) == [] and R.recovered_at(spark, path) == 7
    assert not fs.exists(of(path)) and fs.exists(of(path + ".corrupt-7"))
    R.full_pass_done(spark, path)
    assert R.recovered_at(spark, path) is None
    with pytest.raises(RuntimeError):
        R.quarantine(spark, path, 7)


def test_memory_for_writing(spark, rows):
    path = new_path(spark, "memory")
    good = '{"sessions": [{"id": "s", "timestamp": 1, "calls": [{"query": "q", "timestamp": 2, "tokens": 3}]}]}'
    for name, text in (("a", good), ("b", "{broken"), ("c", '{"other": 1}')):
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{path}/{name}")
    at = f"{path}/*/part-*.txt"
    calls, bad = R.memory_for_writing(spark, at, 9)
    assert rows(calls, "session_id", "query", "tokens") == [("s", "q", 3)]
    assert len(bad) == 2 and ["/b/" in f or "/c/" in f for f in bad] == [True, True]
    assert R.memory_for_writing(spark, at, 10)[1] == []
    only = new_path(spark, "broken")
    spark.createDataFrame([("[",)], "value string").coalesce(1).write.text(only)
    calls, bad = R.memory_for_writing(spark, f"{only}/part-*.txt", 11)
    assert rows(calls) == [] and len(bad) == 1


def test_single_files(spark, rows):
    files = spark.createDataFrame([(1, "a.rs", "h"), (2, "sub/b.rs", "h")], "id long, path string, hash string")
    new = lambda *p: spark.createDataFrame([(x, "new") for x in p], "path string, hash string")
    assert rows(R.index_file(files, new("/w/a.rs"), ["/w", "/w/inner"]), "path", "hash") == [("a.rs", "new"), ("sub/b.rs", "h")]
    with pytest.raises(ValueError):
        R.index_file(files, new("/elsewhere/a.rs"), ["/w"])
    assert rows(R.remove_file(files, new("/w/sub/b.rs", "/elsewhere/a.rs"), ["/w"]), "path") == [("a.rs",)]


def test_counters(spark, rows):
    path = new_path(spark, "tool-calls")
    R.record_tool_call(spark, path, 10, 30)
    R.record_tool_call(spark, path, 0, 60)
    assert rows(overview.token_usage(spark.read.schema("sent long, saved long").json(path))) == [(10, 90, 2, 5, "90%")]
    with pytest.raises(ValueError):
        R.record_tool_call(spark, path, -1, 0)
