"""Registered queries do the operators' whole job."""

import inspect

import pytest

from lexivane.operators import cluster, factorization, synthetic
from lexivane.plans import registry


class Called(Exception):
    pass


@pytest.mark.parametrize(
    "name, module, operator, want",
    [
        ("spherical_kmeans", cluster, "spherical_kmeans", {"k": 20, "rounds": 20}),
        ("synthetic_interactions", synthetic, "synthetic_ratings", {"n_users": 1000, "ratings": 40}),
        ("mf_fit", factorization, "fit", {"settings": factorization.Settings()}),
        ("mf_recommend", factorization, "fit", {"settings": factorization.Settings()}),
    ],
)
def test_production_defaults(spark, monkeypatch, name, module, operator, want):
    signature = inspect.signature(getattr(module, operator))

    def record(*args, **kw):
        bound = signature.bind(*args, **kw)
        bound.apply_defaults()
        raise Called({k: bound.arguments[k] for k in want})

    monkeypatch.setattr(module, operator, record)
    with pytest.raises(Called) as found:
        registry.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert found.value.args[0] == want


def test_users_with_test_ratings_only_get_recommendations(spark, tmp_path):
    lines = [(u, i) for u in range(1, 6) for i in range(1, 9)] + [(10, 5), (10, 10)]  # user 10: (user + item) % 5 = 0 only
    spark.createDataFrame([(n, u) for n, (u, _) in enumerate(lines)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(n, i, 10.0 + n) for n, (_, i) in enumerate(lines)], "l_orderkey long, l_partkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(i,) for i in range(1, 31)], "p_partkey long").write.parquet(f"{tmp_path}/part.parquet")
    got = registry.mf_recommend(spark, str(tmp_path)).groupBy("user_id").count().collect()
    assert {r["user_id"]: r["count"] for r in got} == {str(u): registry.K for u in (1, 2, 3, 4, 5, 10)}
