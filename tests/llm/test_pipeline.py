"""The pipeline's stages against brute force, and its run."""
import corpus_pipeline as pipeline
from llm_cases import SCHEMA, SF_SMALL, again_bytes, cases, frame, near_groups, prepared  # noqa: F401

from capgraph.llm import common, op7_language, op9_toxicity, tokenizer


def test_stages_one_by_one(spark):
    docs = common.table(spark, SF_SMALL, "documents")
    names = [n for n, _ in pipeline.STAGES]
    assert names == ["toxicity", "language", "near_duplicates", "repeated_text", "packing"]
    kept = {}
    for name, stage in pipeline.STAGES:
        before = docs
        docs = common.written(stage(spark, before, SF_SMALL))
        kept[name] = docs
        if name != "packing":
            assert docs.columns == before.columns
        rows = [(r.doc_id, r.text) for r in before.collect()]
        if name == "toxicity":
            model = op9_toxicity.learned(before, common.table(spark, SF_SMALL, "labels"))
            f = op9_toxicity.Features()
            want = [i for i, t in rows if model.score(f((t or "").encode())) < 0.7]
            assert sorted(r.doc_id for r in docs.collect()) == sorted(want) and len(want) > 0.5 * len(rows)
        elif name == "language":
            classify = op7_language.Classifier(op7_language.learned(before))
            want = [i for i, t in rows if classify((t or "").encode())[2]]
            assert sorted(r.doc_id for r in docs.collect()) == sorted(want) and len(want) > 0.95 * len(rows)
        elif name == "near_duplicates":
            groups, _ = near_groups(rows)
            assert sorted(r.doc_id for r in docs.collect()) == sorted({min(rows[j][0] for j in g) for g in groups})
        elif name == "repeated_text":
            want = {}
            for (i, t), (spans, _) in zip(rows, again_bytes(rows, 200)):
                ends = [0, *(x for s in spans for x in s), len((t or "").encode())]
                want[i] = "".join((t or "").encode()[a:b].decode("utf-8", "ignore") for a, b in zip(ends[::2], ends[1::2]))
            assert {r.doc_id: r.text for r in docs.collect()} == want
            assert all(r.n_chars == len(r.text) for r in docs.collect())
        else:
            tok = tokenizer.load(tokenizer.default_path())
            want = {i: len(tok.ids_of((t or "").encode())) // 4 + 1 for i, t in rows}
            got = {r.doc_id: r.n for r in docs.groupBy("doc_id").agg({"length": "sum"}).toDF("doc_id", "n").collect()}
            assert got == want
            assert docs.groupBy("sequence_id").agg({"length": "sum"}).toDF("s", "n").where("n > 4096").count() == 0


def test_run_is_the_stages_in_order(spark):
    out = pipeline.run(spark, SF_SMALL)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and out.count() > 0


def test_stages_of_little_and_of_odd_rows(spark, tmp_path):
    labels = spark.createDataFrame([(1, 0, 1), (2, 1, 0)], "doc_id bigint, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for rows in ([], cases()):
        docs = frame(spark, rows)
        for name, stage in pipeline.STAGES:
            before, docs = docs, common.written(stage(spark, docs, str(tmp_path)))
            assert name == "packing" or docs.columns == before.columns
        if not rows:
            assert docs.count() == 0 and SCHEMA


def test_run_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0
