"""Intermediate tables: folders of any names, and threads of their own."""

import threading
from pathlib import Path

import pytest

from gridwell import session


@pytest.mark.parametrize("name", ["my dir", "50%20 off", "plain"])
def test_tables_are_told_by_their_own_paths(spark, tmp_path, monkeypatch, name):
    folder = tmp_path / name
    for root in (f"file://{folder}", str(folder)):
        monkeypatch.setattr(session, "shared_dir", lambda _, root=root: root)

        def make():
            first = session.written(spark.range(5), "first")
            return session.written(first.where("id > 1"), "second")

        kept = session.passing(make)
        derived = session.passing(lambda: session.written(spark.range(3), "third").where("id = 1"))
        assert kept.count() == 3 and derived.count() == 1
        assert sorted(p.name.split("-")[0] for p in folder.iterdir()) == ["kept", "second"]
        session.drop_written(kept, derived)
        assert list(Path(folder).iterdir()) == []


def test_threads_keep_apart(spark):
    got, both = {}, threading.Barrier(2, timeout=60)

    def run(n):
        def make():
            held = session.written(spark.range(n), "held")
            both.wait()
            return session.written(held, "out")

        got[n] = session.passing(make)
        both.wait()

    threads = [threading.Thread(target=run, args=(n,)) for n in (3, 4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert {n: df.count() for n, df in got.items()} == {3: 3, 4: 4}
