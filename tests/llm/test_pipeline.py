import random

import corpus_pipeline
from credalis.llm import decontaminate

from .test_dedup import WORDS, brute_components


def test_stages_on_planted_documents(spark, tmp_path):
    rng = random.Random(9)
    make = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    rows = [(i, make(rng.randint(8, 60)), "xx", f"s{i % 3}", 0) for i in range(80)]
    bench = make(14)
    base = make(70)
    rows += [(100, rows[3][1], "xx", "s0", 0), (101, rows[3][1], "xx", "s1", 0)]  # exact copies
    rows += [(110, base, "xx", "s0", 0), (111, base + " tail", "xx", None, 0)]  # near copies
    rows += [(120, f"{make(5)} {bench} {make(5)}", "xx", "s0", 0), (130, None, "xx", "s0", 0), (131, "12 34", "xx", "s0", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    gone = {100, 101, 111, 120, 130, 131}
    assert {r.doc_id for r in out} == {r[0] for r in rows} - gone and len(out) == len(rows) - len(gone)
    assert {r.doc_id: r.text for r in out} == {r[0]: r[1] for r in rows if r[0] not in gone}
    assert len({(r.slot, r.place) for r in out}) == len(out)
    kept = [(r.doc_id, r.text) for r in out]
    assert all(i == root for i, (_, root) in brute_components(kept, 5).items())
    assert not any(r.contaminated for r in decontaminate.contamination(spark.createDataFrame(kept, "doc_id long, text string"), spark.createDataFrame([(1, bench)], "item_id long, text string")).collect())
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "exact_dedup", "near_dedup", "decontaminate", "mix"]


def test_stages_on_empty_and_odd_tables(spark, tmp_path):
    """Each stage on an empty table, and on nulls, repeated rows and columns with clashing names."""
    spark.createDataFrame([(1, " ".join(WORDS[:14])), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    shape = "doc_id long, text string, lang string, source string, n_chars long"
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, spark.createDataFrame([], shape), str(tmp_path)).count() == 0
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(WORDS) for _ in range(30)), "xx", None if i % 5 == 0 else "s", i, "own", "y", 7) for i in range(40)]
    rows += [rows[3], (None, None, None, None, None, None, None, None), (50, "", "xx", "s", 1, "a", "b", 2)]
    docs = spark.createDataFrame(rows, f"{shape}, score string, _row string, digest int")
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, str(tmp_path))
        assert got.columns[: len(docs.columns)] == docs.columns
        ids = [r.doc_id for r in got.collect()]
        assert set(range(40)) <= set(ids) and len(ids) >= 40, name
        assert ids.count(3) == (1 if name == "exact_dedup" else 2), name
