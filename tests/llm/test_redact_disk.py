"""redact() stores no text, and replaces what detect() finds."""

import os

from hubbub.llm import pii
from hubbub.plans import store

NAMES = ("[EMAIL]", "[IP]", "[CARD]", "[PHONE]")


def test_redact_stores_no_text(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(store, "shared_dir", lambda spark: f"file://{tmp_path}")
    texts = [(k, f"write to a{k}@b.org, or ann at example dot org, call +1 (212) 555-01{k:02} from 10.0.0.{k} or (212) 555-0{k:03} " + os.urandom(500).hex()) for k in range(90)]
    docs = spark.createDataFrame([*texts, (90, None), (91, "")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert not [t for t in os.listdir(tmp_path) if "text" in spark.read.parquet(str(tmp_path / t)).columns]

    want, n = {}, 0
    for r in pii.detect(docs).collect():
        out, at = [], 0
        for x in sorted(r.spans, key=lambda x: (x.s, x.e, x.kind)):
            if x.s >= at:
                out += [r.text[at : x.s], NAMES[x.kind]]
            at, n = max(at, x.e), n + 1
        want[r.doc_id] = r.text and "".join([*out, r.text[at:]])
    assert got == want and n > 3 * 90
