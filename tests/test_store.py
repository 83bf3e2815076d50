"""Tables of a block are removed at its end; its result and what others stored stay."""

import os

import pytest

from hubbub.plans.store import keep, removed, stored


def _there(df) -> list[bool]:
    return [os.path.exists(f.removeprefix("file://")) for f in df.inputFiles()]


def test_removed(spark):
    before = stored(spark.range(10), "before")
    with removed(spark):
        outer = stored(before.where("id > 2"), "outer")
        with removed(spark):
            inner = stored(outer.where("id > 4"), "inner")
            files = inner.inputFiles()
            result = keep(inner.where("id > 6"), "result")
        assert files and not any(os.path.exists(f.removeprefix("file://")) for f in files)
        assert all(_there(result)) and all(_there(outer))
        out = keep(result.where("id > 7"), "out")
        files = outer.inputFiles() + result.inputFiles()
    assert not any(os.path.exists(f.removeprefix("file://")) for f in files)
    assert sorted(r.id for r in out.collect()) == [8, 9] and before.count() == 10


def test_removed_after_a_failure(spark):
    with pytest.raises(ZeroDivisionError), removed(spark):
        files = stored(spark.range(3), "lost").inputFiles()
        1 / 0  # noqa: B018
    assert files and not any(os.path.exists(f.removeprefix("file://")) for f in files)
    assert all(_there(keep(spark.range(3), "outside")))
