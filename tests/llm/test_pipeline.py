import corpus_pipeline
from pagelake.llm import classifier, decontam, mixing
from tests.llm.helpers import SF, documents, odd_documents, words
from tests.llm.test_neardup import brute


def test_stages_step_by_step(spark, tmp_path):
    """Each stage against what its operator, or a brute-force version, says of its input."""
    docs = documents(spark)
    marks = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    frames = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, frames[-1], SF)
        out.write.parquet(f"{tmp_path}/{name}")
        frames.append(spark.read.parquet(f"{tmp_path}/{name}"))
    rows = [f.collect() for f in frames]
    ids = [{r["doc_id"] for r in rs} for rs in rows]
    for before, f, (name, _) in zip(frames, frames[1:], corpus_pipeline.STAGES, strict=False):
        assert name == "shard" or f.columns == before.columns
    machine = classifier.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    scores = classifier.score_documents(docs, machine).collect()
    assert ids[1] == {r["doc_id"] for r in scores if r["score"] >= 0.3}
    assert all(i in ids[1] for i, q in marks.items() if q == 1)
    assert ids[2] == set(brute([(r["doc_id"], r["text"]) for r in rows[1]], n=5).values())
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    bad = {r["doc_id"] for r in decontam.contaminated(frames[2], items).collect()}
    assert ids[3] == ids[2] - bad
    taken = {r["doc_id"]: r["taken"] for r in mixing.taken_words(frames[3]).collect()}
    copies = {}
    for r in rows[4]:
        copies[r["doc_id"]] = copies.get(r["doc_id"], 0) + len(words(r["text"]))
    assert copies == {i: t for i, t in taken.items() if t}
    assert len(rows[5]) == len(rows[4]) and {r["shard"] for r in rows[5]} <= set(range(16))


def test_run_is_what_the_stages_give(spark):
    assert {"doc_id", "text", "lang", "source", "n_chars", "shard", "slot"} <= set(corpus_pipeline.run(spark, SF).columns)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontaminate", "mix", "shard"]


def test_odd_rows_pass_all_stages(spark):
    docs = odd_documents(spark)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert set(docs.columns) <= set(out.columns)
        docs = out
    docs.collect()
    empty = odd_documents(spark).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, SF)
    assert empty.count() == 0
