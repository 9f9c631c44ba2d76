import pytest

from twinfold.plans import registry

from .conftest import SMALL

#: Run on the same tables, or to the same end, by tests of their own.
COVERED = {"stacking", "random_subspaces", "feature_correlation", "lda_topics", "word2vec_similarity", "glove_vectors", "saved_models", "pagerank_directed_converged"}


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_same_as_sql(same, name):
    same(registry.QUERIES[name], registry.SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL) - COVERED))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, SMALL).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
