from collections import Counter

import corpus_pipeline
from tabulon.llm import mixing, quality, secrets
from tabulon.llm.common import DOCUMENT_COLUMNS
from tests.llm.test_neardup import brute_classes
from tests.llm.test_scans_and_packing import check_packing

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark, docs):
    rows = docs
    for (name, stage), n in zip(corpus_pipeline.STAGES, range(5), strict=True):
        out = stage(spark, rows, SF)
        before = rows.collect()
        after = out.collect()
        if n < 4:
            assert out.columns == DOCUMENT_COLUMNS
        if n == 0:
            judged = {r["doc_id"] for r in quality.score(rows, spark.read.parquet(f"{SF}/labels.parquet")).where("kept").collect()}
            assert {r["doc_id"] for r in after} == judged and 0 < len(judged) < len(before)
        if n == 1:
            classes = brute_classes([(r["doc_id"], r["text"]) for r in before])
            assert sorted(r["doc_id"] for r in after) == sorted(set(classes.values()))
        if n == 2:
            texts = {r["doc_id"]: r["text"] for r in after}
            assert len(after) == len(before)
            for r in before:
                assert texts[r["doc_id"]] == secrets.redact(r["text"], secrets.find(r["text"]))
        if n == 3:
            rates = {r["stratum"]: r for r in mixing.source_rates(rows, corpus_pipeline.SOURCE_WEIGHTS).collect()}
            assert abs(sum(r["rate"] * r["n_rows"] for r in rates.values()) - len(before)) < 1e-6
            assert abs(len(after) - len(before)) < 5 * len(before) ** 0.5
            assert {r["doc_id"] for r in after} <= {r["doc_id"] for r in before}
        if n == 4:
            texts = {}
            for r in before:
                texts.setdefault(r["doc_id"], []).append(r["text"])
            check_packing(after, texts)
        rows = spark.createDataFrame(after, out.schema) if n < 4 else out


def test_run(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert rows and len({r["sequence_id"] for r in rows}) == len(rows)


def test_run_leaves_one_folder(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(corpus_pipeline, "checkpoint_folder", lambda _: str(tmp_path))
    assert corpus_pipeline.run(spark, SF).count() > 0
    assert [p.name for p in tmp_path.glob("pipeline-*/*")] == ["mix_sources"]


def test_stages_on_odd_rows(spark, odd_docs, no_docs):
    by_name = dict(corpus_pipeline.STAGES)
    plain = lambda df: sorted(map(str, df.select(*DOCUMENT_COLUMNS).collect()))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, no_docs, SF).collect() == []
        assert name == "pack_sequences" or stage(spark, odd_docs, SF).columns == DOCUMENT_COLUMNS
    long_words = "word " * 30_000
    kept = by_name["quality_rules"](spark, odd_docs, SF).collect()
    assert kept == []  # too few words, or windows repeated throughout
    near = by_name["near_dedup"](spark, odd_docs, SF)
    assert plain(near) == plain(odd_docs.distinct())
    assert plain(by_name["secret_scans"](spark, odd_docs, SF)) == plain(odd_docs)
    keys = odd_docs.selectExpr("doc_id", "concat(text, ' token=abcdef1234') text", "lang", "source", "n_chars")
    for r in by_name["secret_scans"](spark, keys, SF).collect():
        assert r["text"] is None or ("abcdef1234" not in r["text"] and r["n_chars"] == len(r["text"]))
    mixed = by_name["mix_sources"](spark, odd_docs, SF).collect()
    assert {r["doc_id"] for r in mixed} <= {r["doc_id"] for r in odd_docs.collect()}
    assert all(r["text"] is None or len(r["text"]) < 10_000 or r["text"] == long_words for r in mixed)
    packed = by_name["pack_sequences"](spark, odd_docs, SF).collect()
    texts = {}
    for r in odd_docs.collect():
        texts.setdefault(r["doc_id"], []).append(r["text"])
    check_packing(packed, texts)


def test_mixing_means(spark):
    docs = spark.createDataFrame([(i, "t", "en", "abc"[i % 10 // 4], 1) for i in range(4000)], "doc_id long, text string, lang string, source string, n_chars long")
    out = Counter(r["source"] for r in mixing.mix(docs, {"a": 1.0, "b": 2.0, "c": 5.0}).collect())
    for s, w in (("a", 1), ("b", 2), ("c", 5)):
        assert abs(out[s] - 4000 * w / 8) < 5 * (4000 * w / 8) ** 0.5
    many = mixing.mix(docs.limit(3), {"a": 1.0}, total=600.0).collect()
    assert abs(len(many) - 600) < 125 and len({(r["doc_id"], r["part"], r["copy"]) for r in many}) == len(many)
    assert mixing.mix(docs, {"zzz": 1.0}).count() == 0
