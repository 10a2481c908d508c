"""Versions are published only after two equal looks, and readers stay on theirs."""

import shutil
import time
from pathlib import Path

import pytest

from weftline.streaming import reload


def test_versions_follow_two_equal_looks(spark, tmp_path):
    source, target = tmp_path / "source", f"{tmp_path}/target"
    spark.range(10).write.parquet(str(source))
    whole = next(p for p in source.iterdir() if p.suffix == ".parquet").read_bytes()
    with pytest.raises(LookupError):
        reload.current(spark, target)
    watcher = reload.Watcher(spark, str(source), target)
    half = Path(source / "part-x.parquet")
    half.write_bytes(whole[: len(whole) // 2])  # a writer is at work
    assert watcher.look() == reload.CHANGED
    half.write_bytes(whole[:-8])
    assert watcher.look() == reload.CHANGED  # another size: not equal to the look before
    half.write_bytes(whole)
    assert [watcher.look() for _ in range(3)] == [reload.CHANGED, reload.PUBLISHED, reload.SAME]
    first = reload.current(spark, target)
    n = first.count()
    spark.range(5).write.mode("append").parquet(str(source))
    assert watcher.look() == reload.CHANGED
    assert reload.Watcher(spark, str(source), target).look() == reload.PUBLISHED  # a watcher that starts again goes on
    assert (first.count(), reload.current(spark, target).count()) == (n, n + 5)


def test_changes_between_looks_and_unreadable_sources(spark, tmp_path, monkeypatch):
    source, target = tmp_path / "source", f"{tmp_path}/target"
    spark.range(10).coalesce(1).write.parquet(str(source))
    watcher = reload.Watcher(spark, str(source), target)
    assert watcher.look() == reload.CHANGED
    seen, real = [], watcher.fingerprint

    def moving():
        seen.append(1)
        if len(seen) == 2:  # between the load and the look after it
            spark.range(1).write.mode("append").parquet(str(source))
        return real()

    monkeypatch.setattr(watcher, "fingerprint", moving)
    assert watcher.look() == reload.MOVED
    with pytest.raises(LookupError):
        reload.current(spark, target)
    assert [watcher.look() for _ in range(2)] == [reload.CHANGED, reload.PUBLISHED]
    assert reload.current(spark, target).count() == 11
    bad = source / "part-bad.parquet"
    bad.write_bytes(b"not a table")
    assert [watcher.look() for _ in range(3)] == [reload.CHANGED, reload.UNREADABLE, reload.UNREADABLE]
    assert reload.current(spark, target).count() == 11
    bad.unlink()
    assert watcher.look() == reload.SAME
    looks = [r["state"] for r in reload.kept_table(spark, f"{target}/looks", reload.LOOKS).orderBy("look").collect()]
    assert looks == [reload.CHANGED, reload.MOVED, reload.CHANGED, reload.PUBLISHED, reload.CHANGED, reload.UNREADABLE, reload.UNREADABLE, reload.SAME]


def test_a_stream_of_looks(spark, tmp_path):
    source, target = f"{tmp_path}/source", f"{tmp_path}/target"
    spark.range(3).write.parquet(source)
    query = reload.Watcher(spark, source, target).start(f"{tmp_path}/checkpoint", 0.5)
    try:
        for _ in range(120):
            if reload.kept_table(spark, f"{target}/pointers", reload.POINTERS).count():
                break
            time.sleep(0.5)
    finally:
        query.stop()
    assert reload.current(spark, target).count() == 3
    shutil.rmtree(source)
    assert reload.current(spark, target).count() == 3
