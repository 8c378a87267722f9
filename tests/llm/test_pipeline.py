import duckdb
import pytest

import __spark_entry__
import corpus_pipeline
from textloom.llm import registry
from textloom.llm.toxicity import fit, score_toxicity

FOLDER = "/root/testdata/sf0.001"


def test_every_operator_has_its_query():
    names = list(registry.queries())
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11))
    assert "pipeline" in __spark_entry__.queries()


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_queries_agree_with_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.sql(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    got = registry.queries()[name](spark, FOLDER)
    columns = sorted(got.columns)
    plain = lambda v: round(v, 6) if isinstance(v, float) else v
    rows = sorted((tuple(map(plain, r)) for r in got.select(*columns).collect()), key=repr)
    want = con.sql(f"select {', '.join(columns)} from ({registry.oracle_sql()[name]})").fetchall()
    assert rows == sorted((tuple(map(plain, r)) for r in want), key=repr)


def test_stages_one_by_one(spark):
    """Each stage against what a brute-force version keeps of the stage before."""
    from tests.llm.test_dedup_and_join import LOW, brute_components

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "exact_dedup", "jaccard_join", "source_mixing", "best_fit_packing"]
    clean = stages["toxicity"](spark, docs, FOLDER).cache()
    scores = score_toxicity(docs, fit(docs, spark.read.parquet(f"{FOLDER}/labels.parquet")))
    assert sorted(r["doc_id"] for r in clean.collect()) == sorted(r["doc_id"] for r in scores.where("score < 0.5").collect())
    once = stages["exact_dedup"](spark, clean, FOLDER).cache()
    last = {}
    for r in clean.collect():
        key = (r["text"] or "").translate(LOW)
        last[key] = max(last.get(key, -1), r["doc_id"])
    assert sorted(r["doc_id"] for r in once.collect()) == sorted(last.values())
    single = stages["jaccard_join"](spark, once, FOLDER).cache()
    want = {c for _, c in brute_components([(r["doc_id"], r["text"]) for r in once.collect()]).values()}
    assert {r["doc_id"] for r in single.collect()} == want and single.count() == len(want)
    mixed = stages["source_mixing"](spark, single, FOLDER).cache()
    assert clean.columns == once.columns == single.columns == mixed.columns == columns
    assert {r["doc_id"] for r in mixed.collect()} <= want and mixed.groupBy("doc_id").count().where("count > 3").count() == 0
    pieces = stages["best_fit_packing"](spark, mixed, FOLDER)
    assert pieces.where("piece = 0").count() == mixed.count()
    total = pieces.agg({"length": "sum"}).first()[0]
    assert pieces.select("sequence_id").distinct().count() <= -(-total // 2048) + 1
    assert corpus_pipeline.run(spark, FOLDER).count() == pieces.count()


def test_pipeline_of_awkward_and_of_no_rows(spark, awkward, tmp_path):
    """Nulls, empty and long texts, repeated rows and clashing columns go through every stage; so does an empty table."""
    known = spark.createDataFrame([*((k, 0) for k in (1, 2, 4, 5, 6, 7, 9)), (8, 1), (None, 1)], "doc_id long, toxic int")
    for name, docs, labels in (("rows", awkward, known), ("none", awkward.limit(0), known.limit(0))):
        folder = str(tmp_path / name)
        docs.write.parquet(f"{folder}/documents.parquet")
        labels.write.parquet(f"{folder}/labels.parquet")
        left = spark.read.parquet(f"{folder}/documents.parquet")
        for stage, apply in corpus_pipeline.STAGES[:-1]:
            out = apply(spark, left, folder)
            assert out.columns == docs.columns, stage
            left = corpus_pipeline.write_table(out, f"test-{stage}")
        ids = [r["doc_id"] for r in left.collect()]
        pieces = corpus_pipeline.STAGES[-1][1](spark, left, folder).collect()
        assert sorted(r["doc_id"] for r in pieces if r["piece"] == 0 and r["doc_id"] is not None) == sorted(i for i in ids if i is not None)
        assert bool(ids) == (name == "rows") and not {1, 3} & set(ids)
