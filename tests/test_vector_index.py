import numpy as np
import pandas as pd
import pytest

from loomfield.operators import vector_index as I
from loomfield.operators.vectors import cosine_topk


def clustered(n, d=24, groups=40, seed=1):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(groups, d))
    return middle[rng.integers(groups, size=n)] + 0.35 * rng.normal(size=(n, d))


def table(spark, x, first=0):
    return spark.createDataFrame(pd.DataFrame({"id": np.arange(first, first + len(x)), "v": x.tolist()}), "id long, v array<double>")


def recall(index, df, every=50):
    asked = df.where(f"id % {every} = 0")
    got, want = (({(r.query_id, r.vec_id) for r in q.collect()}) for q in (I.search_index(index, asked, "id", "v"), cosine_topk(df, asked, "id", "v")))
    return len(got & want) / len(want)


def test_recall_and_share_by_size(spark, tmp_path):
    """On clustered vectors the part of the rows that a query looks at falls with the size, and recall stays."""
    shares = []
    for n in (1000, 4000, 16000):
        df = table(spark, clustered(n)).repartition(4)
        index = I.build_index(df, str(tmp_path / str(n)), "id", "v")
        assert recall(index, df) >= 0.9
        again = I.open_index(spark, str(tmp_path / str(n)))
        assert again.probes == index.probes and np.allclose(again.centres[24], index.centres[24])
        shares.append(index.share[24])
    assert shares[0] > shares[2] and shares[2] < 0.2


def test_recall_on_the_given_vectors(spark, tmp_path):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").selectExpr("vec_id AS id", "embedding AS v")
    assert recall(I.build_index(df, str(tmp_path / "e"), "id", "v"), df) >= 0.9


def test_parts_of_large_lists_find_what_whole_ones_do(spark, tmp_path, monkeypatch):
    df = table(spark, clustered(600, groups=2))
    index = I.build_index(df, str(tmp_path / "p"), "id", "v")
    whole = sorted(map(tuple, I.search_index(index, df.where("id % 5 = 0"), "id", "v").collect()))
    monkeypatch.setattr(I, "ROWS", 7)
    monkeypatch.setattr(I, "QUERIES", 5)
    assert sorted(map(tuple, I.search_index(index, df.where("id % 5 = 0"), "id", "v").collect())) == whole
    every = sorted(map(tuple, I.search_index(index, df.where("id % 5 = 0"), "id", "v", probes=10**6).collect()))
    assert every == sorted(map(tuple, cosine_topk(df, df.where("id % 5 = 0"), "id", "v").collect()))


def test_odd_vectors(spark, tmp_path):
    rows = [(1, [1.0, 0.0]), (2, [1e200, 1e200]), (3, [0.0, 0.0]), (4, None), (5, [1.0, None]), (6, [float("nan"), 1.0]), (None, [1.0, 1.0]), (7, [1.0, 2.0, 3.0]), (8, [1.0, 0.0]), (1, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "id long, v array<double>").selectExpr("*", "1 AS d", "2 AS list")
    index = I.build_index(df, str(tmp_path / "o"), "id", "v")
    got = {(r.query_id, r.vec_id): r.score for r in I.search_index(index, df, "id", "v").collect()}
    assert got == {(1, 8): 1.0, (8, 1): 1.0, (1, 2): pytest.approx(2**-0.5), (2, 1): pytest.approx(2**-0.5), (8, 2): pytest.approx(2**-0.5), (2, 8): pytest.approx(2**-0.5)}
    none = I.build_index(df.limit(0), str(tmp_path / "n"), "id", "v")
    assert I.search_index(none, df, "id", "v").collect() == [] and I.open_index(spark, str(tmp_path / "n")).centres == {}
