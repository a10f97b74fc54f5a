"""Tables of components grow with the entries: none is broadcast, at any size."""

from usagelens.operators import identity


def test_no_table_of_entries_is_broadcast(spark, tmp_path, monkeypatch):
    plans, cut = [], identity.cut_lineage

    def spy(df, label="step"):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return cut(df, label)

    monkeypatch.setattr(identity, "cut_lineage", spy)
    keyed = [(i, f"a:{i // 3}") for i in range(60)] + [(i, f"b:{i // 5}") for i in range(60) if i % 5 < 2]
    store = identity.ComponentStore(spark, str(tmp_path / "c"))
    for part in range(3):
        store.add(spark.createDataFrame([k for j, k in enumerate(keyed) if j % 3 == part], "entry long, key string"))
    plans.append(store.components()._jdf.queryExecution().executedPlan().toString())
    assert sum("Join" in p for p in plans) > 10
    assert not [p for p in plans if "Broadcast" in p]
    # a plain union-find over the same keys
    up = list(range(60))
    for _ in range(60):
        by_key = {}
        for e, k in keyed:
            by_key[k] = min(by_key.get(k, 99), up[e])
        for e, k in keyed:
            up[e] = min(up[e], by_key[k])
    assert {r["entry"]: r["component"] for r in store.components().collect()} == dict(enumerate(up))
