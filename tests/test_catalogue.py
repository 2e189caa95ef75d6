"""Registered queries against their SQL on the smallest tables, and the entry points."""

import math
import os

import duckdb
import pytest

from quillmark.plans import catalogue, files  # noqa: F401  files registers its queries

from tests.conftest import DATA

SOME = [
    "decision_parse_v1", "decision_parse_v2", "label_extract", "filename_parse", "decision_merge_left", "flip_audit", "chunk_assign", "suffix_sort_rank", "situation_carry", "judge_model_report", "judge_wide_report", "closed_class_parse",
    "clean_accuracy", "meter_pivot", "stitch_layout", "pairs_adjacent_rank", "pairs_intra_topn", "pairs_dedup_priority", "moving_return_10", "discounted_return", "ring_last_n", "uniform_queries", "preference_rational",
    "preference_losses", "ensemble_disagreement", "knn_distance", "multi_factor_nn", "dedup_threshold_median", "centroid_assign", "pc_normalize", "robust_radius", "bin_capacity", "allocate_points", "largest_remainder",
    "tolerance_all_sigmoids", "surface_area", "quat_roundtrip", "body_descendants", "conv_merge_back", "conv_render_prompt",
    "state_entropy", "knn_search", "similarity_dedup", "pairs_duplicate_fill", "quat_of_matrix", "running_moments_steps", "geom_colors", "text_metrics", "text_metric_means", "caption_rating", "control_values", "ball_grip",
    "camera_limits", "natural_sort_key", "sample_scan", "sample_scan_last", "samples_with_views", "judge_scan", "source_scan", "prompt_log", "useful_pairs", "score_labels", "body_geoms", "placed_points", "rewrite_first",
]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.sql(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    return c


def cell(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return "None"
    return repr(x + 0.0) if isinstance(x, float) else str(x)


@pytest.mark.parametrize("name", SOME)
def test_query_gives_the_rows_of_its_sql(spark, duck, name):
    df, sql = catalogue.QUERIES[name](spark, DATA), duck.sql(catalogue.ORACLES[name])
    names = sorted(df.columns)
    assert sorted(sql.columns) == names
    at = [sql.columns.index(c) for c in names]
    assert sorted(tuple(cell(r[c]) for c in names) for r in df.collect()) == sorted(tuple(cell(r[i]) for i in at) for r in sql.fetchall())


def test_entry_points(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 1
    assert set(catalogue.QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())


def test_only_sequential_or_approximate_queries_have_no_sql():
    assert set(catalogue.QUERIES) - set(catalogue.ORACLES) == {
        "text_rouge_l", "embedding_digest", "pairs_usage_cap", "pairs_generate", "pairs_generate_padded", "kcenter", "fps", "fps_groups", "bin_kmeans", "bounded_store", "rebinned_store", "camera_boxes", "kcenter_uncertain",
    }
