"""Perspectives and derivative records: small tables, and every registered query against its SQL."""

import hashlib

import pandas as pd
import pytest

from beamspark.llm import derivatives, perspectives
from beamspark.llm.shared import ORACLES, QUERIES
from check import normal


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    got = pd.DataFrame([r.asDict() for r in df.collect()], columns=df.columns)
    cur = duck.execute(ORACLES[name])
    want = pd.DataFrame(cur.fetchall(), columns=[d[0] for d in cur.description])
    assert sorted(got.columns) == sorted(want.columns) and len(got)
    pd.testing.assert_frame_equal(normal(got), normal(want))


def test_rotation(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "Ann", "Hi"), (1, 2, "Bo", "Yo <|end|>"), (1, 3, "Ann", None), (2, 0, "system", "alone"), (None, 5, None, "x"),
            (None, None, "Cy", "first"), (3, 0, "Ann", "a"), (3, 0, "Ann", "a"), (3, 64, "Bo", "late")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as part", "2 as said", "3 as of")
    got = {(r.conv_id, r.perspective, r.part): r for r in perspectives.rotated(df).collect()}
    assert set(got) == {(1, "Ann", 0), (1, "Bo", 0), (None, "Cy", -1), (None, "Cy", 0), (None, "unknown", -1), (None, "unknown", 0),
                        (3, "Ann", 0), (3, "Ann", 1), (3, "Bo", 0), (3, "Bo", 1)}
    ann = got[(1, "Ann", 0)]
    assert ann.rendered == ("<|system|>\nBe kind.<|end|>\n<|assistant|>\nHi<|end|>\n<|user name=Bo|>\nYo < |end|><|end|>\n<|assistant|>\n<|end|>\n")
    for r in got.values():
        said = [r.rendered[s.begin:s.finish] for s in r.mask]
        assert all(s.endswith("<|end|>\n") and r.rendered[m.begin - 14:m.begin] == "<|assistant|>\n" for s, m in zip(said, r.mask, strict=True))
        assert len(said) == r.rendered.count("<|assistant|>\n")
    assert got[(3, "Ann", 0)].n_turns == 2 and got[(3, "Bo", 0)].mask == []
    assert perspectives.rotated(df.limit(0)).count() == 0


def test_derivatives(spark):
    page = "<html><head><title>T</title><script>x<p></script></head><body><p>A &amp; b&nbsp;c</p><div>d<br>e</div><!-- no --></body>"
    rows = [("r1", "http://u", "2020-01-01T00:00:00Z", "HTTP/1.1 200 OK\r\nServer: x", page), ("r1", "http://u", "2020-01-01T00:00:00Z", "HTTP/1.1 200 OK\r\nServer: x", page),
            ("r2", None, None, None, None), (None, "", "", "", "")]
    df = spark.createDataFrame(rows, "record_id string, target_uri string, date string, http_headers string, payload string").selectExpr("*", "9 as text", "8 as fields")
    got = derivatives.derived(df, keep=("target_uri",)).collect()
    assert len(got) == 8
    mine = [r for r in got if r.refers_to == "r1"]
    conversion, metadata = (next(r for r in mine if r.record_type == k) for k in ("conversion", "metadata"))
    assert conversion.block == "T\nA & b c\nd\ne"
    assert conversion.concurrent_to == metadata.record_id and metadata.concurrent_to == conversion.record_id
    for r in mine:
        assert "WARC-Refers-To: <r1>\r\n" in r.header and "WARC-Refers-To-Date: 2020-01-01T00:00:00Z\r\n" in r.header and r.header.endswith("\r\n\r\n")
        assert f"Content-Length: {len(r.block.encode())}\r\n" in r.header
        assert r.block_digest == "sha256:" + hashlib.sha256(r.block.encode()).hexdigest() and r.block_digest in r.header
        assert r.source_digest == "sha256:" + hashlib.sha256(page.encode()).hexdigest()
    assert "source-headers: HTTP/1.1 200 OK\r\n\tServer: x\r\n" in metadata.block and metadata.source_digest in metadata.block
    bare = next(r for r in got if r.refers_to == "r2" and r.record_type == "conversion")
    assert bare.block == "" and "Target-URI" not in bare.header and "Date" not in bare.header
    assert derivatives.derived(df.limit(0)).count() == 0
