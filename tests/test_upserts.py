"""Keyed results of a stream: late rows, a query that is stopped and goes on, batches that run again."""

import random

from stanzaflow.operators import selecting as sl
from stanzaflow.streaming import upserts

SCHEMA = "k int, seq long, v string"


def test_stream_equals_batch_through_a_restart(spark, tmp_path):
    rng = random.Random(1)
    rows = [(rng.choice([1, 1, 1, 2, 3, None, rng.randrange(50)]), i, f"v{i}") for i in range(300)]
    rng.shuffle(rows)
    run = lambda: upserts.versions(
        upserts.upserted(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in"), ["k"], "seq"), f"{tmp_path}/out", f"{tmp_path}/state"
    ).trigger(availableNow=True).start().awaitTermination(120)
    for part in range(4):
        spark.createDataFrame(rows[part * 75 : part * 75 + 75], SCHEMA).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
        if part != 1:
            run()  # two files are read in one go after a pause
    want = sl.last_wins(spark.createDataFrame(rows, SCHEMA), ["k"], "seq").collect()
    got = upserts.latest(spark, f"{tmp_path}/out", ["k"]).collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) and len({r.k for r in got}) == len(got)
    newest = max(int(p.name.split("=")[1]) for p in (tmp_path / "out").glob("batch=*"))
    spark.read.parquet(f"{tmp_path}/out/batch={newest}").write.mode("overwrite").parquet(f"{tmp_path}/copy")
    spark.read.parquet(f"{tmp_path}/copy").write.mode("overwrite").parquet(f"{tmp_path}/out/batch={newest}")  # a batch that runs again
    assert sorted(map(str, upserts.latest(spark, f"{tmp_path}/out", ["k"]).collect())) == sorted(map(str, want))
