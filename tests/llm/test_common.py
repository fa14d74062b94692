import pyarrow as pa
from pyspark.sql import functions as F

from leafmill.llm import common


def sizes(df):
    def make():
        def step(batch):
            yield pa.record_batch([pa.array([batch.num_rows]), pa.array([batch.nbytes])], ["n", "size"])

        return step

    return common.map_batches(df, make, "n long, size long").collect()


def test_batches_are_bounded_by_bytes(spark):
    df = spark.range(0, 12_000, 1, 1).select(F.repeat(F.lit("x"), 2000).alias("text"))
    got = sizes(df)
    assert sum(r.n for r in got) == 12_000
    assert max(r.size for r in got) < 2 * common.BATCH_BYTES
    long = sizes(spark.range(0, 3, 1, 1).select(F.repeat(F.lit("x"), 2 * common.BATCH_BYTES).alias("text")))
    assert sum(r.n for r in long) == 3


def test_a_bound_of_the_session_stays(spark):
    other = spark.newSession()
    other.conf.set(common.BATCH_KEY, 1 << 20)
    sizes(other.range(3))
    assert int(other.conf.get(common.BATCH_KEY).rstrip("b")) == 1 << 20


def test_slices_are_small_and_whole():
    texts = ["x" * 8000] * 200 + ["y" * 900_000, None, "z"]
    batch = pa.record_batch([pa.array(texts)], ["text"])
    parts = list(common.slices(batch, "text"))
    assert [t for p in parts for t in p.column("text").to_pylist()] == texts
    assert all(p.num_rows == 1 or sum(len(t or "") for t in p.column("text").to_pylist()) <= 1 << 18 for p in parts)
