"""Archives with ids of other types, repeated rows and several reading tasks."""

import hashlib

import pytest

pytest.importorskip("runledger.llm")
from runledger.llm import warc  # noqa: E402
from runledger.llm.common import tuned  # noqa: E402


@pytest.mark.parametrize("kind,ids", [("string", ["a", "b", "c", None]), ("int", [1, 2, 3, None]), ("bigint", [1, 2, 1 << 40, None])])
def test_ids_keep_their_type(spark, tmp_path, kind, ids):
    big = "x" * 1500
    rows = [(ids[0], big, "clash"), (ids[1], big, None), (ids[2], "small", None), (ids[3], None, None)]
    pages = tuned(spark).createDataFrame(rows, f"page_id {kind}, html string, path string")
    back = warc.read_packages(warc.write_packages(pages, str(tmp_path / kind)))
    assert back.schema["id"].dataType == back.schema["refers_to"].dataType == pages.schema["page_id"].dataType
    got = {r["id"]: (r["type"], r["refers_to"], r["payload_bytes"], r["digest"]) for r in back.collect()}
    sha = lambda t: hashlib.sha1(t.encode()).hexdigest()
    assert got == {ids[0]: ("revisit", ids[1], 1500, sha(big)), ids[1]: ("response", None, 1500, sha(big)),
                   ids[2]: ("response", None, 5, sha("small")), ids[3]: ("response", None, 0, sha(""))}


def test_repeated_rows_and_many_runs(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "RUN", 300)
    monkeypatch.setattr(warc, "TASK_RUNS", 2)
    pages = tuned(spark).createDataFrame([(i, f"{i} " * (i + 1)) for i in range(40)] + [(7, "7 " * 8)] * 2, "page_id long, html string")
    packages = warc.write_packages(pages, str(tmp_path / "p"))
    back = warc.read_packages(packages)
    assert sorted((r["id"], r["payload"].decode()) for r in back.collect()) == sorted(tuple(r) for r in pages.collect())
    assert back.rdd.getNumPartitions() > 1
