"""Scratch tables, memory, and operators on empty tables."""

import os

import pyarrow as pa
import pytest

from tracewell.llm import byte_bpe, common, entry, main_text, packing, token_counts, toxicity, transport_stream
from tracewell.llm.vocab import multi_path


def test_scratch_is_per_application(spark):
    kept = common.materialize(spark.range(3).toDF("x"), "kept")
    folder = common.scratch_dir(spark)
    assert kept.count() == 3 and folder.endswith(spark.sparkContext.applicationId) and os.path.isdir(folder)
    common.drop_scratch(spark)
    assert not os.path.exists(folder) and os.path.isdir(os.path.dirname(os.path.dirname(folder)))


def test_no_local_folder_on_a_cluster(spark, monkeypatch):
    class Conf:
        def get(self, _):
            return None

    class Context:
        master, applicationId = "spark://host:7077", "app-1"

        def getConf(self):
            return Conf()

    class Session:
        sparkContext = Context()

    with pytest.raises(RuntimeError, match="checkpoint"):
        common.scratch_dir(Session())


def test_text_slices_keep_every_text():
    texts = ["a" * 10, None, "", "b" * 3000, "c"] * 7
    found = [(first, part) for first, part in common.text_slices(pa.array(texts), max_bytes=100, max_rows=4)]
    assert [t for _, part in found for t in part] == [(t or "").encode() for t in texts]
    assert [first for first, _ in found] == [sum(len(p) for _, p in found[:i]) for i in range(len(found))]


def test_release_and_trimmed_keep_results():
    common.release()
    batches = [pa.RecordBatch.from_arrays([pa.array([i])], ["x"]) for i in range(3)]
    assert [b.column(0)[0].as_py() for b in common.trimmed(lambda it: (b for b in it))(iter(batches))] == [0, 1, 2]


def test_columns_on_empty_tables(no_docs):
    columns = {
        "media": transport_stream.digest_column("text"), "tokens": token_counts.count_column(entry._longest_match(multi_path()), "text", "t"), "bpe": byte_bpe.round_trip_column(entry._codec(multi_path()), "text", "t"),
        "main": main_text.main_text_column("text"), "toxic": toxicity.score_column(toxicity.ToxicityModel({" x ": 1.0}), "text"),
    }
    for name, column in columns.items():
        assert no_docs.select("doc_id", column.alias(name)).collect() == []
    assert packing.pack_documents(no_docs).collect() == []
