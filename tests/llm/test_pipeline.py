import pytest
from test_decontamination import brute as brute_hits
from test_jaccard import brute as brute_classes
from test_tokens import wanted

import corpus_pipeline
from gaugeworks.llm import mil, toxicity
from gaugeworks.llm.chosen_path import keep_one_of_each
from gaugeworks.llm.queries import quality_model, toxicity_model


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The documents before and after each stage."""
    d = "/root/testdata/sf0.01"
    out, docs = [], spark.read.parquet(f"{d}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stages") / str(k))
        stage(spark, docs, d).write.parquet(path)
        out.append((docs, docs := spark.read.parquet(path)))
    return out


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_columns_stay_until_the_last_stage(stages):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    assert all(after.columns == columns for _, after in stages[:-1])
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "near_duplicates", "decontamination", "bpe"]


def test_filters_follow_their_scores(spark, stages):
    d = "/root/testdata/sf0.01"
    before, after = stages[0]
    scores = toxicity.score_documents(before, toxicity_model(spark, d, before))
    assert ids(after) == ids(scores.where("score < 0.7")) and 0 < after.count() < before.count()
    before, after = stages[1]
    scores = mil.score_documents(before, quality_model(spark, d, before))
    assert ids(after) == ids(scores.where("score >= 0.5")) and 0 < after.count() < before.count()


def test_one_of_each_group_stays(stages):
    before, after = stages[2]
    classes = brute_classes([(r.doc_id, r.text) for r in before.collect()])
    assert ids(after) == sorted({c for _, c, _, _ in classes}) and after.count() < before.count()


def test_contaminated_documents_go(spark, stages):
    before, after = stages[3]
    items = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").collect()]
    hits = brute_hits([(r.doc_id, r.text) for r in before.collect()], items)
    assert ids(after) == sorted(i for i, n, h, _ in hits if not (h > 0 and 20 * h >= n))


def test_ids_are_those_of_the_library(stages):
    before, after = stages[4]
    got = {r.doc_id: (r.token_ids, r.n_tokens) for r in after.collect()}
    assert got == {r.doc_id: (wanted(r.text), len(wanted(r.text))) for r in before.collect()}


def test_run_equals_the_stages(spark, stages):
    assert ids(corpus_pipeline.run(spark, "/root/testdata/sf0.01")) == ids(stages[-1][1])


def test_copies_repeated_rows_and_nulls(spark):
    text = "one two three four five six seven"
    rows = [(3, text, "a"), (2, text.upper(), "b"), (2, text.upper(), "b"), (None, text, "c"), (None, None, "d"), (5, None, "e"), (6, "", "f"), (7, "other words", "g")]
    df = spark.createDataFrame(rows, "doc_id long, text string, class_id string")
    assert sorted(map(str, keep_one_of_each(df).collect())) == sorted(str(r) for r in df.collect()[1:2] + df.collect()[3:])


def test_clashing_columns_stay(spark):
    docs = spark.createDataFrame([(1, "a b", 7, "x"), (2, None, 8, "y")], "doc_id long, text string, N_TOKENS int, token_ids string")
    out = corpus_pipeline.encode(spark, docs, "/root/testdata/sf0.001")
    assert out.columns == ["doc_id", "N_TOKENS", "token_ids", "token_ids_", "n_tokens_"]
    assert [(r.N_TOKENS, r.token_ids, r.n_tokens_) for r in out.orderBy("doc_id").collect()] == [(7, "x", len(wanted("a b"))), (8, "y", 0)]
