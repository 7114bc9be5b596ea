"""Each stage of the pipeline on its predecessor's output against a plain version of it."""

import pytest

import corpus_pipeline as cp
from tests.llm.test_pairs import brute_components
from tests.llm.test_passages import brute_passages

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in cp.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, docs, SF).write.parquet(path)
        out.append((docs, spark.read.parquet(path)))
        docs = out[-1][1]
    return out


def test_columns(stages):
    for before, after in stages[:-1]:
        assert sorted(after.columns) == sorted(cp.COLUMNS) and after.count() <= before.count()


def test_language_keeps_texts_with_letters(stages):
    before, after = stages[0]
    kept = {r.doc_id for r in after.collect()}
    assert {r.doc_id for r in before.collect() if any(c.isalpha() for c in r.text or "")} == kept


def test_toxic_go(stages, spark):
    before, after = stages[1]
    kept = {r.doc_id for r in after.collect()}
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    gone = {r.doc_id for r in before.collect()} - kept
    assert not [d for d in gone if toxic.get(d) == 0] and len(gone) < 0.2 * before.count()


def test_one_of_each_group_stays(stages):
    before, after = stages[2]
    want, _ = brute_components([(r.doc_id, r.text) for r in before.collect()])
    assert sorted(r.doc_id for r in after.collect()) == sorted(set(want.values()))


def test_repeats_go(stages):
    before, after = stages[3]
    rows = before.collect()
    want = {r.doc_id: k.decode("utf-8", "ignore") for r, k in zip(rows, brute_passages([r.text.encode() for r in rows], 400, cp.PASSAGE_WORDS), strict=True)}
    got = {r.doc_id: (r.text, r.n_chars) for r in after.collect()}
    assert got == {d: (t, len(t)) for d, t in want.items() if t}


def test_all_are_packed(stages):
    before, after = stages[4]
    total = {r.doc_id: len(r.text.encode()) + 1 for r in before.collect()}
    found: dict[int, int] = {}
    for r in after.collect():
        found[r.doc_id] = found.get(r.doc_id, 0) + r.length
    assert found == total


def test_hard_rows(spark, hard_docs, no_docs):
    docs = hard_docs.select(*cp.COLUMNS)
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() > 0
    for _, stage in cp.STAGES:
        assert stage(spark, no_docs, SF).count() == 0
