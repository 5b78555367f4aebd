import random

import corpus_pipeline
from eventlens.llm import exact_dedup, packing, quality
from tests.llm.conftest import ODD
from tests.llm.test_duplicates import plain_classes, plain_repeats
from tests.llm.test_tokens import check_packed

SF = "/root/testdata/sf0.001"


def test_stages_act_on_what_the_one_before_kept(spark, tmp_path):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, now, seen = docs.columns, docs, {}
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, SF).write.parquet(f"{tmp_path}/{number}")
        before, now = now, spark.read.parquet(f"{tmp_path}/{number}")
        seen[name] = ([(r.doc_id, r.text) for r in before.collect()], now.collect())
        if number < len(corpus_pipeline.STAGES) - 1:
            assert now.columns == columns
    rows, kept = seen["quality_classifier"]
    scores = quality.score(docs, quality.learn(docs, spark.read.parquet(f"{SF}/labels.parquet")))
    assert {r.doc_id for r in kept} == {r.doc_id for r in scores.where("predicted = 1").collect()}
    rows, kept = seen["exact_dedup"]
    last = {}
    for i, text in rows:
        key = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        last[key] = max(i, last.get(key, i))
    assert {r.doc_id for r in kept} == set(last.values())
    rows, kept = seen["near_dedup"]
    assert {r.doc_id for r in kept} == set(plain_classes(rows).values())
    rows, kept = seen["suffix_array_dedup"]
    want = plain_repeats(rows)
    assert {(r.doc_id, r.text) for r in kept} == {(i, w[3].decode("utf-8", "ignore")) for i, w in want.items()}
    rows, found = seen["best_fit_packing"]
    check_packed(found, rows, Tokenizer.from_file(packing.default_tokenizer()), packing.CAPACITY)
    run = corpus_pipeline.run(spark, SF).collect()
    assert sorted((r.doc_id, r.piece, r.ids_crc32) for r in run) == sorted((r.doc_id, r.piece, r.ids_crc32) for r in found)


def test_stages_take_odd_and_empty_tables(documents, spark):
    random.seed(1)
    for docs in (documents(ODD), documents(ODD).limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            rows = out.collect()
            if name != "best_fit_packing":
                assert out.columns == docs.columns
            if name == "exact_dedup" and rows:
                assert exact_dedup.exact_groups(out).where("not kept").count() == 0
            assert bool(rows) == bool(docs.take(1)), name
