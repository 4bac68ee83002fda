import pytest

import tidemark.operators.pipelines  # noqa: F401
import tidemark.operators.monitor  # noqa: F401
import tidemark.operators.candle_features  # noqa: F401
from tidemark.plans import registry

from compare import same, sql_rows

#: Fitting and planning are run by test_pipelines.
SLOW = {"fit_and_plan"}


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_matches_sql(spark, sf_dir, name):
    same(registry.QUERIES[name](spark, sf_dir).toPandas(), sql_rows(registry.ORACLE_SQL[name], sf_dir))
    spark.catalog.clearCache()


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL) - SLOW))
def test_runs(spark, sf_dir, name):
    assert registry.QUERIES[name](spark, sf_dir).count() > 0
    spark.catalog.clearCache()
