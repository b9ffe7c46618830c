"""The pipeline against a brute-force version, and on tables without rows."""

import re

import public_tokenizers
import sentencepiece

import corpus_pipeline
from tests.conftest import DATA
from tests.llm.test_operators import brute_components
from tidewatch.llm import decontaminate, pii, quality_rules

SF = f"{DATA}/sf0.001"


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    kept = {r.doc_id: r.clean_text for r in quality_rules.quality_rules(docs).collect() if r.kept}
    one = {i: t for i, t in kept.items() if brute_components(kept.items())[i][1] == i} if len(kept) < 400 else None
    plain = lambda t: " ".join(re.sub(r"[!-/:-@\[-`{-~]", "", (t or "").lower()).split())
    items = [plain(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = {i: t for i, t in one.items() if not any(b and b in plain(t) for b in items)}
    dirty = {i for i in clean if i not in out}
    frame = spark.createDataFrame([(i, clean[i]) for i in sorted(dirty)], "doc_id long, text string")
    found = decontaminate.find_contamination(frame, spark.read.parquet(f"{SF}/benchmark.parquet"))
    assert {r.doc_id for r in found.collect()} == dirty and len(dirty) <= 2  # edited copies only
    assert set(out) <= set(clean)
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = {r.doc_id: r.text for r in pii.pseudonymize(spark.createDataFrame(list(clean.items()), "doc_id long, text string"), corpus_pipeline.PII_KEY).collect()}
    for i, r in out.items():
        assert list(r.ids) == sp.encode(texts[i]) and r.n_tokens == len(r.ids) and r.round_trip


def test_stages_keep_columns_and_take_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    none = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SF).count() == 0
        if stage is not corpus_pipeline.STAGES[-1][1]:
            assert stage(spark, none, SF).columns == docs.columns


def test_repeated_rows_leave_one(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(5)
    out = corpus_pipeline.near_duplicates(spark, docs.union(docs), SF)
    assert out.count() == out.select("doc_id").distinct().count() <= 5


def test_missing_and_shared_ids_lose_no_texts(spark):
    text = lambda k: " ".join(f"w{k}x{j}" for j in range(40))
    rows = [(None, text(1)), (None, text(2)), (None, text(2)), (7, text(3)), (7, text(4)), (7, text(4)), (8, text(5)), (None, text(5)), (9, text(3))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = corpus_pipeline.near_duplicates(spark, docs, SF)
    assert sorted(map(tuple, out.collect()), key=str) == sorted([(None, text(1)), (None, text(2)), (7, text(3)), (7, text(4)), (8, text(5))], key=str)
    leak = next(r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if len(r.text.split()) > 9)
    docs = spark.createDataFrame([(None, leak), (None, text(1)), (7, leak), (7, text(2))], "doc_id long, text string")
    assert {tuple(r) for r in corpus_pipeline.decontamination(spark, docs, SF).collect()} == {(None, text(1)), (7, text(2))}


def test_near_duplicates_where_parts_have_only_common_keys(spark):
    rows = [(i, f"alpha beta gamma delta epsilon {'word' * (i % 9)}{i // 18}") for i in range(36)]
    out = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), SF).collect()
    assert sorted(r.doc_id for r in out) == [i for i, (_, root) in sorted(brute_components(rows).items()) if i == root]
