import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from panelwise.llm.common import table

FOLDER = "/root/testdata/sf0.001"


def test_run_equals_the_stages_and_their_brute_force(spark):
    docs = table(spark, FOLDER, "documents")
    columns, seen = docs.columns, [set(r.doc_id for r in docs.collect())]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, FOLDER).collect(), docs.schema)
        assert docs.columns == columns
        seen.append({r.doc_id for r in docs.collect()})
        assert seen[-1] <= seen[-2]
    out = corpus_pipeline.run(spark, FOLDER).collect()
    assert {r.doc_id for r in out} == seen[-1] and len(out) == len(seen[-1])

    labels = {r.doc_id: r for r in table(spark, FOLDER, "labels").collect()}
    clean = [d for d, r in labels.items() if r.toxic == 0 and r.quality == 1]
    assert sum(d in seen[2] for d in clean) >= 0.9 * len(clean)
    toxic = [d for d, r in labels.items() if r.toxic == 1]
    assert sum(d in seen[1] for d in toxic) <= 0.4 * len(toxic)

    from test_jaccard import brute

    rows = [(r.doc_id, r.text) for r in table(spark, FOLDER, "documents").collect() if r.doc_id in seen[2]]
    assert seen[3] == {c for _, c, _, _ in brute(rows)}
    items = [" ".join(r.text.lower().split()) for r in table(spark, FOLDER, "benchmark").collect()]
    texts = {d: " ".join(t.lower().split()) for d, t in rows}
    assert not any(i in texts[d] for d in seen[4] for i in items)
    assert {d for d in seen[3] if any(i in texts[d] for i in items)} == seen[3] - seen[4]


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_take_odd_rows(spark, name, stage):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "word", None, "s", 4), (3, "some text here.\n" * 9000, "en", "s", 1), (3, "some text here.\n" * 9000, "en", "s", 1)]
    docs = spark.createDataFrame([(*r, 1.0, "x") for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, hits string")
    for k, c in enumerate(("flagged", "found", "Hits_", "kept_id", "kept_digest", "repeats", "own_digest", "n", "signature", "digest")):
        docs = docs.withColumn(c, F.lit(k))
    out = stage(spark, docs, FOLDER)
    if name != "token ids":
        assert out.columns == docs.columns
    assert out.count() <= len(rows)
    assert stage(spark, docs.where("false"), FOLDER).count() == 0
