import corpus_pipeline
from panelspark.llm import bpe, lines, mixing, nearcopies, toxicity
from panelspark.llm.common import BATCH_BYTES, bounded_batches, word_count
from tests.llm.data import awkward, frame, multiset
from tests.llm.test_lines import brute as line_brute
from tests.llm.test_nearcopies import check
from tests.llm.test_toxicity import corpus


def test_stage_names_and_columns(spark, tmp_path):
    rows, labels = corpus(300)
    rows = rows + [(1000 + i, f"first line {i % 3}\nsecond line\nthird line {i % 3}\n{i}", "en", f"s{i % 4}", 0) for i in range(60)] + awkward()[-8:]
    docs = frame(spark, rows)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, t) for i, t in labels], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert len(corpus_pipeline.STAGES) == 5
    # By hand: the scores of the first stage, then every step in plain Python.
    known = spark.read.parquet(str(tmp_path / "labels.parquet")).where(~toxicity.held_out("doc_id"))
    kept = [tuple(r)[:5] for r in toxicity.classify(docs, known).where("predicted = 0").select(docs.columns).collect()]
    assert 0 < len(rows) - len(kept) < len(rows) / 2
    changed = line_brute(kept, lines.RUN)
    kept = [(r[0], changed[r[0], r[1]][0], r[2], r[3], None if r[1] is None else len(changed[r[0], r[1]][0])) for r in kept]
    rest = [tuple(r) for r in nearcopies.keep_dissimilar(frame(spark, kept)).collect()]
    check(kept, rest)
    kept = rest
    mixed = mixing.repeat_rows(mixing.mix(frame(spark, kept), word_count("text"), mixing.cycle_weights(3, 1, 2))).collect()
    words = bpe.Vocabulary(bpe.default_vocabulary(spark))
    want = [(r["doc_id"], r["source"], r["n_chars"], len(words.encode(r["text"] or "")), words.encode(r["text"] or "")) for r in mixed]
    got = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "source", "n_chars", "n_tokens", "ids").collect()
    assert multiset(map(tuple, got)) == multiset(want)


def test_every_stage_takes_awkward_and_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for rows in (awkward(), []):
        docs = frame(spark, rows)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, str(tmp_path))
            assert out.columns == docs.columns
            assert out.count() <= 2 * len(rows)
        assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == len(rows)


def test_batches_are_bounded_unless_tighter_already(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    try:
        for start, want in ((str(64 << 20), BATCH_BYTES), ("1000", 1000)):
            spark.conf.set(name, start)
            bounded_batches(spark)
            assert spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch() == want
    finally:
        spark.conf.set(name, before)
