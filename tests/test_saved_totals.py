"""Saved totals of several machines come from one pass over the deduplicated requests."""

from usagelens.operators import requests
from usagelens.registry import QUERIES, load_all, q_merge


def test_rows_are_read_once(spark, sf, monkeypatch):
    load_all()
    cubes, seen = [], []
    cube, total = requests.usage_cube, requests.request_totals
    monkeypatch.setattr(requests, "usage_cube", lambda *a, **b: cubes.append(1) or cube(*a, **b))
    monkeypatch.setattr(requests, "request_totals", lambda df, *a, **b: seen.append("message_id" in df.columns) or total(df, *a, **b))
    QUERIES["mg05_merged_cost_and_scan"](spark, sf)
    assert cubes == [1] and seen.count(True) == 1  # the cube alone reads requests
    cubes.clear(), seen.clear()
    q_merge._saved_reports(q_merge.Views(spark, sf))
    assert cubes == [1] and seen.count(True) == 1
