"""op4 holds few rows at once, whatever its batches."""

import os
import tracemalloc

import pyarrow as pa

from hubbub.llm import repeats


def test_repeats_hold_few_rows_at_once():
    """A batch of contexts becomes its windows, and one of documents its contexts, in small parts."""
    n, more = 4000, 63
    data = pa.array([os.urandom(repeats.LENGTH + more) for _ in range(n)], pa.binary())
    ids, zeros = pa.array(range(n), pa.int64()), pa.array([0] * n, pa.int64())
    batch = pa.RecordBatch.from_arrays([ids, zeros, pa.array([True] * n), zeros, pa.array([more] * n, pa.int32()), data], names=["id", "tag", "single", "first", "more", "data"])
    tracemalloc.start()
    rows = sum(b.num_rows for b in repeats._windows(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == n * (more + 1)
    assert peak < 16 << 20


def test_small_sorts_find_what_one_sort_finds(monkeypatch):
    """Whole cores meet however few bytes are sorted at a time."""
    text = os.urandom(400)
    rows = [(core, 7, 10 * core + k, 0, True, 0, 40, 20, text[core : core + 240] if k < 2 else os.urandom(240)) for core in range(50) for k in range(3)]
    names = ["core", "h", "id", "tag", "single", "first", "more", "place", "data"]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def found() -> list[dict]:
        return [r for b in repeats._compared(iter([batch])) for r in b.to_pylist()]

    whole = found()
    monkeypatch.setattr(repeats, "SORT_BYTES", 300)
    assert found() == whole and {r["id"] for r in whole} == {10 * c + k for c in range(50) for k in range(2)}
