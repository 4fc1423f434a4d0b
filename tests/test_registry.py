"""A fast part of the registered queries against DuckDB; tests/run_oracle.py runs them all."""

import pytest

import __spark_entry__ as entry
from sparkscrub.operators.dictionary import Dictionary
from sparkscrub.plans.profile import Profile
from tests.oracle import compare, connect

FAST = ["fn_03_parse_number", "fn_06_rescue_coordinate", "fn_11_alnum_key", "fn_17_normalize_key", "fn_19_one_edit", "det_02_duplicate_rows",
        "det_07_bad_phones", "det_10_bad_formula", "det_15_spelling_variants", "act_10_digit_patches", "act_09_edit_cells", "gui_08_coordinates",
        "gui_13_limits_null", "gui_21_group_median", "jn_01_suggest_keys", "jn_06_outer_join", "jn_08_collapse_by_key", "agg_04_outlier_table",
        "agg_05_correlation_kendall", "mod_03_foreign_key_check", "src_01_delimited_text", "src_07_header_repair"]


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_every_twin_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert {(r["tipo"], r["columna"]) for r in entry.entry(spark).collect()} >= {("faltante", "cantidad"), ("atipico", "cantidad")}


@pytest.mark.parametrize("name", FAST)
def test_twin(spark, sf_dir, con, name):
    assert compare(entry.queries()[name](spark, sf_dir), con, entry.oracle_sql()[name]) == ""


def test_detection_sees_whole_tables(spark, sf_dir, con, monkeypatch):
    """col_08 profiles every customer and every order, the odd ones too."""
    from registry import col
    from registry.fixtures import duck

    seen = []
    monkeypatch.setattr(col, "Profile", lambda df, *a: seen.append(df.count()) or Profile(df, *a))
    found = {(r["nivel"], r["columna"]) for r in entry.queries()["col_08_detect_columns"](spark, sf_dir).collect()}
    whole = [con.execute(duck(t) + f" SELECT count(*) FROM {t}").fetchone()[0] for t in ("dirty_customer", "dirty_orders")]
    assert seen and set(seen) == set(whole) and {("por contenido", "campo_2"), ("fecha", "campo_3")} <= found


def test_data_facts_see_all_columns_of_events(spark, sf_dir, monkeypatch):
    from registry import joins

    seen = []
    monkeypatch.setattr(joins, "Dictionary", lambda df, *a, **k: seen.append(df.columns) or Dictionary(df, *a, **k))
    entry.queries()["dic_10_data_facts"](spark, sf_dir)
    assert spark.read.parquet(f"{sf_dir}/events.parquet").columns in seen
