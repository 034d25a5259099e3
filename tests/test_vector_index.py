import numpy as np
import pytest
from pyspark.sql import functions as F

from talkweave.operators.search import vector_topk
from talkweave.sources.vector_index import REST, VectorIndex

SCHEMA = "passage_id long, embedding array<float>"


def clustered(n, dims=16, centres=20, seed=3):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, dims))
    rows = middle[rng.integers(centres, size=n)] + 0.05 * rng.normal(size=(n, dims))
    return [(i, [float(x) for x in v]) for i, v in enumerate(rows.astype("float32"))]


def rounded(df):
    return [(r[0], round(r[1], 9)) for r in df.collect()]


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    data = clustered(3_000)
    data += [(10_000 + i, data[5][1]) for i in range(1_000)]  # one vector on a quarter of the rows
    docs = spark.createDataFrame(data, SCHEMA).repartition(4).cache()
    index = VectorIndex(spark, str(tmp_path_factory.mktemp("vectors"))).fit(docs, 24)
    return data, docs, index.add(docs.where("passage_id % 2 = 0"), 0).add(docs.where("passage_id % 2 = 1"), 1)


@pytest.mark.parametrize("k", [1, 7, 150, 1_200])
def test_same_rows_as_the_full_scan(made, k):
    data, docs, index = made
    for at in (0, 5, 17):
        assert rounded(index.topk(data[at][1], k)) == rounded(vector_topk(docs, data[at][1], k))


def test_a_counted_part_of_the_rows_and_files_is_read(made):
    data, docs, index = made
    rings, chosen = index.rings(), index.chosen(data[0][1], 10)
    assert sum(r.rows for r in rings) == len(data)
    assert sum(r.rows for r in chosen) < 0.2 * len(data)
    every, some = (index._read(x).select(F.input_file_name()).distinct().count() for x in (rings, chosen))
    assert 0 < some < 0.5 * every
    plan = index._read(chosen)._jdf.queryExecution().executedPlan().toString()
    pruned = plan[plan.index("PartitionFilters: [") :].splitlines()[0]
    assert "cell" in pruned and "ring" in pruned


def test_a_query_far_from_all_and_filters(made, spark):
    data, docs, index = made
    away = [-x for x in data[0][1]]
    assert rounded(index.topk(away, 20)) == rounded(vector_topk(docs, away, 20))
    allowed = docs.where("passage_id % 40 = 3")
    got = rounded(index.topk(data[0][1], 30, allowed))
    assert got == rounded(vector_topk(allowed, data[0][1], 30))
    few = docs.where("passage_id in (1, 2)")
    assert len(rounded(index.topk(data[0][1], 30, few))) == 2


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    data = clustered(300)
    docs = spark.createDataFrame(data, SCHEMA)
    index = VectorIndex(spark, str(tmp_path / "v")).fit(docs, 8).add(docs, 0)
    before = rounded(index.topk(data[1][1], 25))
    index.add(docs, 0)
    assert rounded(index.topk(data[1][1], 25)) == before and sum(r.rows for r in index.rings()) == 300


def test_defined_cases(spark, tmp_path):
    data = clustered(200)
    odd = [(900, None), (901, []), (902, [0.0] * 16), (903, [1.0, 2.0]), (904, data[0][1] + [9.0])]
    docs = spark.createDataFrame(data + odd, SCHEMA)
    index = VectorIndex(spark, str(tmp_path / "odd")).fit(docs, 8).add(docs)
    assert sum(r.rows for r in index.rings() if r.cell == REST) == 4
    for query in (data[0][1], [0.0] * 16, data[0][1][:5]):
        assert rounded(index.topk(query, 60)) == rounded(vector_topk(docs, query, 60))
    with pytest.raises(ValueError):
        index.topk(data[0][1], 0)
    empty = VectorIndex(spark, str(tmp_path / "none")).fit(docs.limit(0)).add(docs.limit(0))
    assert empty.topk(data[0][1], 5).collect() == []
