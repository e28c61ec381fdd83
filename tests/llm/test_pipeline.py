"""The pipeline against its stages applied by hand, and its behaviour on odd tables."""

from collections import Counter

import corpus_pipeline
import pytest
from lurescan.llm import decontaminate, packing, pii, quality, simhash
from test_exact import components, expected_hits, expected_print

from llm_helpers import FOLDER, read


@pytest.fixture()
def quick(monkeypatch):
    monkeypatch.setattr(pii, "STEPS", 5)
    monkeypatch.setattr(quality, "STEPS", 5)


def test_stages_take_effect(spark, quick):
    docs = read(spark, "documents")
    columns = docs.columns
    for place, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r for r in docs.collect()}
        after = corpus_pipeline.stored(stage(spark, docs, FOLDER))
        if name == "packing":
            assert {r.doc_id for r in after.collect()} == set(before)
            break
        assert after.columns == columns
        rows = {r.doc_id: r for r in after.collect()}
        assert len(rows) == after.count() and rows.keys() <= before.keys()
        if name == "quality":
            scores = quality.quality(docs, read(spark, "labels"))
            assert set(rows) == {r.doc_id for r in scores.collect() if r.predicted}
        if name == "near copies":
            ids = sorted(before)
            groups = components([expected_print(before[i].text) for i in ids], 2)
            assert set(rows) == {ids[g] for g in groups}
        if name == "benchmark passages":
            items = [(r.item_id, r.text) for r in read(spark, "benchmark").collect()]
            hits = expected_hits([(i, r.text) for i, r in before.items()], items, 10)
            assert set(rows) == {h[0] for h in hits if not h[5]}
        if name == "personal data":
            assert set(rows) == set(before)
            for i, r in before.items():
                for _, s, e in pii.base_spans(r.text):
                    assert r.text[s:e] not in rows[i].text
                assert rows[i].n_chars == len(rows[i].text)
        docs = after
    assert place == 4


def test_odd_rows_pass_through(spark, edge, none, labels, quick, tmp_path):
    folder = str(tmp_path)
    labels.write.parquet(f"{folder}/labels.parquet")
    benchmark = spark.createDataFrame([(1, None), (None, "x"), (2, "")], "item_id bigint, text string")
    benchmark.write.parquet(f"{folder}/benchmark.parquet")
    for table in (edge, none):
        docs = table
        for name, stage in corpus_pipeline.STAGES:
            docs = corpus_pipeline.stored(stage(spark, docs, folder))
            if name != "packing":
                assert docs.columns == edge.columns
    assert docs.count() == 0


def test_repeated_rows_and_ids(spark, edge, labels):
    kept = simhash.without_copies(edge)
    assert Counter(r.doc_id for r in kept.collect())[9] == 2
    benchmark = spark.createDataFrame([(1, "Alpha beta gamma delta")], "item_id bigint, text string")
    left = decontaminate.clean_documents(edge, benchmark)
    assert left.count() == edge.count() - 3 and left.columns == edge.columns


def test_packed_result_holds_the_texts(spark, edge):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    name, stage = corpus_pipeline.STAGES[-1]
    docs = edge.filter("doc_id IN (1, 6, 7, 8)").dropDuplicates(["doc_id"])
    parts = {}
    for r in stage(spark, docs, FOLDER).collect():
        parts.setdefault(r.doc_id, []).append((r.start, r.ids))
    texts = {d: tokenizer.decode([i for _, ids in sorted(p) for i in ids][:-1]) for d, p in parts.items()}
    assert texts == {r.doc_id: r.text for r in docs.collect()}
