"""Every registered query runs on the smallest tables and agrees with its SQL where it has one."""

import dataclasses
import os

import pytest

import __spark_entry__ as entry
import compare
from panelwise.catalog import QUERIES, fits
from panelwise.operators.models import TreeSizes

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the tables are not here")


@pytest.fixture(scope="module")
def connection():
    return compare.connect(FOLDER)


FULL_SIZE = ["m7_random_forest", "m10_segment_models", "m11_importance_study", "o6_top_importances"]


@pytest.fixture
def small_ensembles():
    """The registered queries fit ensembles of the real sizes; here small ones stand in for them."""
    fits.SETTINGS, kept = dataclasses.replace(fits.SETTINGS, sizes=TreeSizes(8, 5, 32, 4, 3, 64)), fits.SETTINGS
    yield
    fits.SETTINGS = kept


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, connection, small_ensembles, name):
    difference, _, _ = compare.compare(spark, connection, entry.queries()[name], entry.oracle_sql().get(name), FOLDER)
    assert not difference


@pytest.mark.parametrize("name", FULL_SIZE)
def test_query_at_full_size(spark, connection, name):
    """Forests of 300 trees, 30 levels deep."""
    fits.forget()
    difference, _, _ = compare.compare(spark, connection, entry.queries()[name], entry.oracle_sql()[name], FOLDER)
    fits.forget()
    assert not difference


def test_entry(spark):
    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["m13_score_batch", "m16_evaluate_pair", "u5_score_all_models"])
def test_every_candidate_is_fitted(spark, small_ensembles, name):
    """The winner is one of all candidates, and all of them are scored, not only a chosen few."""
    fits.forget()
    entry.queries()[name](spark, FOLDER)
    found = [b.fitted.made for b in fits.trained(spark, FOLDER).frozen if b.kind != "baseline"]
    fits.forget()
    assert found == [True] * 6


def test_all_candidates_are_evaluated(spark, small_ensembles):
    """The rule, regressions, forests and boosting: every frozen candidate has its rows, in code and in SQL."""
    fits.forget()
    found = entry.queries()["m17_evaluate_candidates"](spark, FOLDER).first()
    made = [b.fitted.made for b in fits.trained(spark, FOLDER).frozen if b.kind != "baseline"]
    fits.forget()
    assert found.candidates == found.hits_agree == 7 and made == [True] * 6
    assert "CAST(7 AS BIGINT) AS candidates" in entry.oracle_sql()["m17_evaluate_candidates"]
