import pyarrow as pa
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from quern.llm import quality_rules, queries, toxicity  # noqa: E402
from quern.llm.common import each_part  # noqa: E402

from .test_join_and_media import brute_components  # noqa: E402
from .test_texts import rules  # noqa: E402

DATA = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark, documents):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "toxicity", "n-gram Jaccard join", "best-fit packing"]
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    kept = {i for i, t in texts.items() if not rules(t)[5]}
    stage = dict(corpus_pipeline.STAGES)
    first = stage["quality rules"](spark, documents, DATA)
    assert {r["doc_id"] for r in first.collect()} == kept and first.columns == documents.columns
    model = toxicity.train(first, spark.read.parquet(f"{DATA}/labels.parquet"), toxicity.trainable)
    mild = {r["doc_id"] for r in toxicity.scored(first, model, ["doc_id"]).collect() if r["score"] < 0.7}
    single = {c for _, _, c in brute_components([(i, texts[i]) for i in mild], 5, 80)}
    out = corpus_pipeline.run(spark, DATA).collect()
    assert {r["doc_id"] for r in out} == single


def test_odd_rows_and_an_empty_table_through_all_stages(spark, odd, none, tmp_path):
    for k, docs in enumerate((odd, none)):
        rows = docs
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
            out = stage(spark, rows, DATA)
            assert out.columns == docs.columns and out.dtypes == docs.dtypes  # extra columns of any name come through
            out.write.parquet(f"{tmp_path}/{k}-{i}")
            rows = spark.read.parquet(f"{tmp_path}/{k}-{i}")
        left = sorted(((r["doc_id"], (r["text"] or "")[:8]) for r in rows.collect()), key=str)
        packed = corpus_pipeline.STAGES[-1][1](spark, rows, DATA).collect()
        # Of the copies of the first text the one with the least id stays, once; short and empty texts went with the rules.
        assert left == ([(1, "a b c d "), (5, "w0x0 w1x"), (8, "another "), (8, "▁ odd <|"), (None, "null id ")] if k == 0 else [])
        assert {r["doc_id"] for r in packed} == {i for i, _ in left}


def test_quality_rules_judge_each_text_once_and_by_one_worker_a_task(spark, documents):
    plan = quality_rules.host_rules(documents)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_long_batches_are_judged_in_parts():
    texts, met = pa.array(["a" * 10, None, "", "b" * 30, "cd", "ef"]), []

    def values(part):
        met.append(part)
        return [len(x) for x in part]

    assert each_part(texts.slice(1), values, pa.int32(), 20).to_pylist() == [0, 0, 30, 2, 2]
    assert met == [[b"", b""], [b"b" * 30], [b"cd", b"ef"]]
    assert each_part(texts[:0], values, pa.int32()).to_pylist() == []


def test_query_names():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{i}" for i in range(1, 11)]
