"""Every registered query runs and equals its SQL twin on the smallest tables."""

from __future__ import annotations

import pytest
from check_oracle import connect, difference
from pyspark.sql import functions as F

from threadline.operators import facts as K
from threadline.plans import registry
from threadline.plans.stats_queries import facts_for


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, sf_dir, con, name):
    df = registry.queries()[name](spark, sf_dir)
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert df.count() >= 0
    else:
        assert difference(df, con, sql) is None


def test_selecting_everything_equals_no_filter(spark, sf_dir):
    f = facts_for(spark, sf_dir)
    labelled = f.session.where("project_label is not null")
    everything = labelled.select("project_label").distinct()
    assert K.core_counts(labelled, K.Scope(labels=everything)).collect() == K.core_counts(labelled).collect()
    spans = K.overlap_days(labelled, f.overlap_day, "Australia/Melbourne", K.Scope(labels=everything))
    assert spans.where("elapsed_hours > 24 or elapsed_hours > summed_hours + 0.001").count() == 0


def test_an_empty_selection_gives_zeros(spark, sf_dir):
    f = facts_for(spark, sf_dir)
    none = f.session.select("project_label").limit(0)
    row = K.core_counts(f.session, K.Scope(labels=none)).first()
    assert (row.files_total, row.engaged_h, row.cost) == (0, 0.0, 0.0)
    days = K.real_days(f.session, K.Scope(labels=none))
    got = K.busiest_day(days, K.overlap_days(f.session, f.overlap_day, "UTC", K.Scope(labels=none))).first()
    assert (got.busiest_day, got.busiest_n, got.peak_concurrent) == (None, 0, None)


def test_child_filters_become_semi_joins(spark, sf_dir):
    from threadline.operators.reports import models
    from threadline.operators.selection import Span

    f = facts_for(spark, sf_dir)
    plan = models(f.turn, f.session, Span("2024-01-05", "2024-01-06"))._jdf.queryExecution().executedPlan().toString()
    assert "LeftSemi" in plan and "PushedFilters: [IsNotNull(is_real)" in plan
    assert f.turn.agg(F.count("*")).first()[0] > 0
