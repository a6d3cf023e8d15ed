"""The package's queries over the smallest tables."""

from __future__ import annotations

from sparkloom.llm import queries


def test_every_query_runs(spark, sf_dir):
    for name, run in queries.queries().items():
        assert run(spark, sf_dir).count() > 0, name
