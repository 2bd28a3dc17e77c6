"""All stages in a row over hostile tables: nulls, empty and very long texts, repeated rows, clashing columns, empty tables."""

import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import corpus_pipeline

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def folder(path, documents, **others):
    """A data folder with these documents, and the other tables as given or as they are."""
    pq.write_table(documents, path / "documents.parquet")
    for name in ("labels", "benchmark"):
        pq.write_table(others.get(name, pq.read_table(f"{SF}/{name}.parquet")), path / f"{name}.parquet")
    return str(path)


def more(documents, rows):
    """The documents with further rows of the same schema; what a row does not say is null."""
    return pa.concat_tables([documents, pa.Table.from_pylist([{n: r.get(n) for n in documents.schema.names} for r in rows], documents.schema)])


def test_hostile_rows_go_through_all_stages(spark, tmp_path):
    plain = pq.read_table(f"{SF}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in plain.to_pylist()}
    good = {r.doc_id for r in corpus_pipeline.keep_good(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF).select("doc_id").collect()}
    first = min(good)
    long = "\n".join(texts[k] for k in sorted(good)) * 8
    leak = pq.read_table(f"{SF}/benchmark.parquet").to_pylist()[0]
    item = next(v for k, v in leak.items() if isinstance(v, str) and len(v) > 40)
    rows = [
        {"doc_id": 10_000_001, "text": None},
        {"doc_id": 10_000_002, "text": ""},
        {"doc_id": 10_000_003, "text": " \t\n\r\x0b\x0c"},
        {"doc_id": 10_000_004, "text": long},
        {"doc_id": 10_000_005, "text": texts[first]},
        {"doc_id": first, "text": texts[first]},
        {"doc_id": None, "text": texts[first]},
        {"doc_id": None, "text": None},
        {"doc_id": 10_000_006, "text": texts[max(good)] + "\n" + item},
    ]
    documents = more(plain, rows)
    for name in ("shard", "Slot", "score", "size", "_nth", "component_id", "copies", "rate", "key"):
        documents = documents.append_column(name, pa.array(range(documents.num_rows), pa.int64()))
    sf = folder(tmp_path, documents)
    out = corpus_pipeline.run(spark, sf)
    got = out.collect()
    # the last stage's own columns keep their names, a column of the table with one of these gets an underscore
    assert [c.rstrip("_") if c not in documents.schema.names else c for c in out.columns[: len(documents.schema.names)]] == documents.schema.names
    assert len({c.lower() for c in out.columns}) == len(out.columns)
    ids = [r["doc_id"] for r in got]
    # both rows of the smallest id of a group stay, its copies under other ids and the leak go
    assert first in ids and 10_000_005 not in ids and 10_000_006 not in ids
    assert len({r["key"] for r in got if r["doc_id"] == first}) == 2
    by_key = dict(zip(documents["key"].to_pylist(), documents["text"].to_pylist(), strict=True))
    assert all(r["text"] == by_key[r["key"]] for r in got)
    slots = {}
    for r in got:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_no_documents(spark, tmp_path):
    documents = pq.read_table(f"{SF}/documents.parquet").slice(0, 0)
    assert corpus_pipeline.run(spark, folder(tmp_path, documents)).count() == 0


def test_no_benchmark(spark, tmp_path):
    benchmark = pq.read_table(f"{SF}/benchmark.parquet").slice(0, 0)
    sf = folder(tmp_path, pq.read_table(f"{SF}/documents.parquet"), benchmark=benchmark)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert corpus_pipeline.decontaminated(spark, docs, sf).count() == docs.count()
    assert corpus_pipeline.run(spark, sf).count() > 0
