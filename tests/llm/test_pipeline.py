import re

import corpus_pipeline
from corpus_pipeline import COLUMNS, STAGES
from stanzaflow.llm import pii, toxicity

from tests.llm.test_decontam import plain as contaminated
from tests.llm.test_near_dedup import plain as linked

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark, tmp_path):
    """Each stage on its own input: what it keeps, and that all columns stay as they are."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame(
        [(None, "x", "en", "s", 1), (None, None, None, None, None), (90001, None, "en", "src0", 0), (90002, "", None, None, 0)], docs.schema
    )
    docs = docs.unionByName(extra)
    kept = {}
    for name, stage in STAGES:
        before = docs
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = (before, docs)
    rows = {k: (sorted(map(tuple, b.collect()), key=str), sorted(map(tuple, a.collect()), key=str)) for k, (b, a) in kept.items()}
    assert all(kept[k][1].columns == COLUMNS for k in list(kept)[:-1])

    before, after = rows["toxicity"]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    bad = {r.doc_id for r in toxicity.op4(kept["toxicity"][0], labels).collect() if r.predicted}
    assert after == [r for r in before if r[0] not in bad] and bad
    before, after = rows["near_duplicates"]
    stay = {i for i, _, _, keep in linked([(r[0], r[1]) for r in before], 80) if keep}
    assert after == [r for r in before if r[0] in stay] and len(after) < len(before)
    before, after = rows["decontamination"]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    gone = {x[0] for x in contaminated([(r[0], r[1]) for r in before], items)}
    assert after == [r for r in before if r[0] not in gone] and gone
    before, after = rows["personal_data"]
    want = [(i, t and pii.redact(t), lang, s, n if t is None else len(pii.redact(t))) for i, t, lang, s, n in before]
    assert after == sorted(want, key=str)
    before, after = rows["mixing"]
    size = sorted(len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in before)
    assert sorted(r[1] for r in after) == size
    assert abs(sum(r[4] for r in after) - 1.5 * sum(size)) < 0.02 * sum(size)


def test_empty_tables_and_clashing_columns(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    wide = docs.selectExpr("*", "doc_id AS key", "text AS score", "lang AS hash", "1 AS shard", "source AS size", "'x' AS kept", "2 AS predicted")
    for name, stage in STAGES:
        assert stage(spark, docs.limit(0), SF).collect() == []
        got = stage(spark, wide, SF)
        assert got.columns == stage(spark, docs, SF).columns
        assert name == "mixing" or got.columns == COLUMNS
        assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, stage(spark, docs, SF).collect()), key=str)
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    for name, stage in (STAGES[0], STAGES[2]):
        assert stage(spark, docs, str(tmp_path)).count() == 40


def test_a_very_long_text_and_repeated_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id < 30")
    long = " ".join(f"w{i * 7919 % 100003}" for i in range(150_000))
    more = spark.createDataFrame([(90001, long, "en", "s", len(long)), (90001, long, "en", "s", len(long))], docs.schema)
    rows = docs.unionByName(more)
    for name, stage in STAGES[:-1]:
        kept = [r.n_chars for r in stage(spark, rows, SF).filter("doc_id = 90001").collect()]
        assert kept == [len(long)] * 2, name


def test_run_equals_the_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, SF)
    got = corpus_pipeline.run(spark, SF)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, docs.collect()))
