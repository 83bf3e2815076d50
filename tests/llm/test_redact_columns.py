"""redact() passes every other column, one or none, and stores each text once."""

import os

from hubbub.llm import pii


def _tables(spark) -> dict[str, int]:
    """Bytes of each table of spans in the shared folder."""
    root = (spark.conf.get("spark.checkpoint.dir", None) or "").removeprefix("file://")
    found = [d for d in os.listdir(root) if d.startswith("pii-spans")] if root else []
    return {d: sum(os.path.getsize(f"{root}/{d}/{f}") for f in os.listdir(f"{root}/{d}")) for d in found}


def test_redact_columns(spark):
    rows = [(1, "write to ann@example.org now", "a@b.org", {"k": 1}), (2, None, None, None), (3, "", "x", {})]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `row` string, `a.b c` map<string,int>")
    out = pii.redact(docs)
    assert out.columns == docs.columns
    assert sorted(map(tuple, out.collect())) == [(1, "write to [EMAIL] now", "a@b.org", {"k": 1}), rows[1], rows[2]]
    only = pii.redact(docs.select("text"))
    assert only.columns == ["text"] and {r.text for r in only.collect()} == {"write to [EMAIL] now", None, ""}


def test_redact_stores_a_text_once(spark):
    texts = [(k, os.urandom(40_000).hex()) for k in range(8)]
    before = _tables(spark)
    pii.redact(spark.createDataFrame(texts, "doc_id long, text string")).count()
    (size,) = [n for d, n in _tables(spark).items() if d not in before]
    assert size < 1.5 * 8 * 80_000
