"""The stages in turn against brute force: what each keeps and gives is judged on its own input."""

import hashlib

import pytest
import sentencepiece

import corpus_pipeline as c
from laminara.llm import quality_crf, sp_bpe
from tests.llm.helpers import empty, odd, table
from tests.llm.test_similar import brute
from tests.llm.test_simhash import brute_components, brute_print


def test_stages(spark, sf):
    docs = table(spark, sf, "documents")
    columns = docs.columns
    model = quality_crf.train(docs, table(spark, sf, "labels"))
    texts = {d.doc_id: d.text for d in docs.collect()}
    one = c.stage_quality(spark, docs, sf).cache()
    assert one.columns == columns
    assert {d.doc_id for d in one.collect()} == {i for i, t in texts.items() if quality_crf.assess(t, model)["kept"]}
    two = c.stage_near_dedup(spark, one, sf).cache()
    groups = brute_components({d.doc_id: brute_print(d.text, 5) for d in one.collect()})
    firsts = {d.doc_id: d.text for d in one.collect() if d.doc_id in set(groups.values())}
    assert two.columns == columns and sorted(d.doc_id for d in two.collect()) == sorted(set(firsts) - brute(firsts))
    three = c.stage_pii(spark, two, sf).cache()
    assert three.columns == columns and {d.doc_id for d in three.collect()} == {d.doc_id for d in two.collect()}
    assert all(d.n_chars == len(d.text) for d in three.collect())
    four = c.stage_mixing(spark, three, sf).cache()
    assert four.columns == columns and {d.doc_id for d in four.collect()} <= {d.doc_id for d in three.collect()}
    toxic = {d.doc_id for d in table(spark, sf, "labels").where("toxic = 1").collect()}
    lost = {d.doc_id for d in three.collect()} - {d.doc_id for d in four.collect()}
    clean = {d.doc_id for d in three.collect()} - toxic
    assert len(lost & clean) <= 0.05 * len(clean)
    five = {d.doc_id: d for d in c.stage_encode(spark, four, sf).collect()}
    lib = sentencepiece.SentencePieceProcessor(model_file=sp_bpe.default_model())
    for d in four.collect():
        ids = lib.encode(d.text)
        assert five[d.doc_id].n_tokens == len(ids) and five[d.doc_id].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def test_run_is_the_stages_in_turn(spark, sf):
    got = c.run(spark, sf)
    assert got.count() == len(set(r.doc_id for r in got.collect())) > 0


@pytest.mark.parametrize("make", [odd, empty])
def test_odd_documents(spark, sf, make):
    docs = make(spark)
    for name, stage in c.STAGES[:-1]:
        if "n_chars" not in docs.columns:
            docs = docs.selectExpr("*", "cast(length(text) as bigint) as n_chars")
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        out.count()
        docs = out
    assert c.STAGES[-1][1](spark, docs, sf).count() == docs.count()
    assert c.STAGES[-1][1](spark, make(spark), sf).count() == make(spark).count()
