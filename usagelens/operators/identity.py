"""Entries that share any key are the same thing: connected components over shared keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage


def repo_keys(repos: DataFrame, entry: str = "entry", remote: str = "remote", roots: str = "root_commits",
              root_key: str = "root_key", path: str = "path") -> DataFrame:
    """`(entry, key)` rows: the remote and every root commit; without those the root key, else the path."""
    strong = F.array_union(
        F.array_compact(F.array(F.concat(F.lit("remote:"), F.nullif(F.col(remote), F.lit(""))))),
        F.coalesce(F.transform(F.col(roots), lambda r: F.concat(F.lit("root:"), r)), F.array().cast("array<string>")),
    )
    weak = F.array_compact(F.array(F.coalesce(
        F.concat(F.lit("rootkey:"), F.col(root_key)), F.concat(F.lit("path:"), F.col(path))
    )))
    keys: Column = F.when(F.size(strong) > 0, strong).otherwise(weak)
    return repos.select(entry, F.explode(keys).alias("key"))


def shared_key_components(keyed: DataFrame, entry: str = "entry", key: str = "key") -> DataFrame:
    """`(entry, component)`: entries sharing a key, directly or through others, get the lowest entry as label.

    Every key becomes a star around its lowest entry, so a key held by a third of all entries adds one edge
    per entry and never a pair of entries. All tables here grow with the entries, so joins are merges at every size: a
    broadcast would send them through the driver in every round. Labels then spread by hooking and pointer jumping (FastSV: Zhang,
    Azad and Hu, 2020), which needs about log(diameter) rounds. Each round is written to the shared folder,
    and the loop stops when no label changed; that test fetches one row.
    """
    pairs = keyed.select(F.col(entry).alias("v"), F.col(key).alias("k")).distinct()
    hubs = pairs.groupBy("k").agg(F.min("v").alias("hub"))  # combined map-side: a hot key is no problem
    star = pairs.join(hubs.hint("merge"), "k").filter(F.col("v") != F.col("hub")).select(F.col("v").alias("a"), F.col("hub").alias("b"))
    edges = cut_lineage(star.unionByName(star.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    parents = cut_lineage(pairs.select("v").distinct().withColumn("f", F.col("v")), "labels")

    while True:
        grand = parents.join(
            parents.select(F.col("v").alias("f"), F.col("f").alias("gf")).hint("merge"), "f"
        ).select("v", "f", "gf")
        # smallest grandparent among the neighbours of every entry
        offers = (
            edges.join(grand.select(F.col("v").alias("b"), F.col("gf").alias("offer")).hint("merge"), "b")
            .groupBy(F.col("a").alias("v")).agg(F.min("offer").alias("offer"))
        )
        known = grand.join(offers.hint("merge"), "v", "left").withColumn("offer", F.least("offer", "gf"))
        # the offer goes to the entry itself and to its parent; both keep the smallest they are given
        hooked = known.select("v", F.col("offer").alias("f")).unionByName(
            known.groupBy(F.col("f").alias("v")).agg(F.min("offer").alias("f"))
        ).groupBy("v").agg(F.min("f").alias("f"))
        updated = cut_lineage(hooked, "labels")
        changed = updated.join(parents.withColumnRenamed("f", "old").hint("merge"), "v").filter(F.col("f") != F.col("old")).limit(1)
        done = changed.isEmpty()
        parents = updated
        if done:
            break
    return parents.select(F.col("v").alias(entry), F.col("f").alias("component"))


class ComponentStore:
    """Components that grow by report: a report is joined against the roots of what is stored, not against its entries.

    Below `path`, one folder per batch: the labels of new entries, the root under which a new key was filed, and the
    forest, which says under which root an earlier root is now (one row per root that was ever joined to another, so far
    smaller than the labels). An entry's component is its label, or where the forest has taken that. Joins are merges at
    every size, as in `shared_key_components`.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _batches(self, name: str) -> list[tuple[int, str]]:
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        folder = hadoop.Path(f"{self.path}/{name}")
        store = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not store.exists(folder):
            return []
        found = [f.getPath() for f in store.listStatus(folder)]
        return sorted((int(p.getName().split("=")[1]), p.toString()) for p in found if store.exists(hadoop.Path(p, "_SUCCESS")))

    def committed(self) -> int:
        """Number of the last whole batch; the forest is written last."""
        return max((n for n, _ in self._batches("forest")), default=0)

    def _read(self, name: str, last: int) -> DataFrame | None:
        paths = [p for n, p in self._batches(name) if n <= last]
        return self.spark.read.parquet(*(paths[-1:] if name == "forest" else paths)) if paths else None

    def _rooted(self, df: DataFrame, column: str, last: int) -> DataFrame:
        """`df` with the present root in `column`."""
        forest = self._read("forest", last)
        if forest is None:
            return df
        now = df.join(forest.select(F.col("root").alias("_root"), "parent").hint("merge"), F.col(column) == F.col("_root"), "left")
        return now.withColumn(column, F.coalesce("parent", column)).drop("_root", "parent")

    def add(self, keyed: DataFrame, entry: str = "entry", key: str = "key") -> int:
        """Take in the `(entry, key)` rows of a report and commit them; returns the number of the batch."""
        last = self.committed()
        pairs = cut_lineage(keyed.select(F.col(entry).alias("entry"), F.col(key).alias("key")).distinct(), "report-pairs")
        labels, keys = self._read("labels", last), self._read("keys", last)
        nodes, graph = pairs.withColumn("v", F.col("entry")), None
        fresh_entries, fresh_keys = pairs.select("entry").distinct(), pairs.select("key").distinct()
        if labels is not None and keys is not None:
            known = self._rooted(labels.join(fresh_entries.hint("merge"), "entry", "left_semi"), "component", last)
            met = self._rooted(keys.join(fresh_keys.hint("merge"), "key", "left_semi"), "root", last)
            known, met = cut_lineage(known, "known-entries"), cut_lineage(met, "known-keys")
            nodes = pairs.join(known.hint("merge"), "entry", "left").withColumn("v", F.coalesce("component", "entry"))
            graph = met.select(F.col("root").alias("v"), "key")
            fresh_entries, fresh_keys = fresh_entries.join(known.hint("merge"), "entry", "left_anti"), fresh_keys.join(met.hint("merge"), "key", "left_anti")
        graph = nodes.select("v", "key") if graph is None else nodes.select("v", "key").unionByName(graph)
        joined = cut_lineage(shared_key_components(graph, "v", "key"), "joined")
        at = nodes.select("entry", "key", "v").join(joined.hint("merge"), "v")
        batch = last + 1
        at.join(fresh_entries.hint("merge"), "entry", "left_semi").groupBy("entry").agg(F.min("component").alias("component")).write.mode("overwrite").parquet(f"{self.path}/labels/batch={batch}")
        at.join(fresh_keys.hint("merge"), "key", "left_semi").groupBy("key").agg(F.min("component").alias("root")).write.mode("overwrite").parquet(f"{self.path}/keys/batch={batch}")
        moved = joined.where("v <> component").select(F.col("v").alias("root"), F.col("component").alias("parent"))
        before = self._read("forest", last)
        if before is not None:
            under = moved.select(F.col("root").alias("_root"), F.col("parent").alias("_parent"))
            old = before.join(under.hint("merge"), F.col("parent") == F.col("_root"), "left").select("root", F.coalesce("_parent", "parent").alias("parent"))
            moved = old.unionByName(moved.join(before.select("root").hint("merge"), "root", "left_anti"))
        moved.write.mode("overwrite").parquet(f"{self.path}/forest/batch={batch}")
        return batch

    def components(self) -> DataFrame | None:
        """`(entry, component)` of all reports, as a run over all of them gives it."""
        last = self.committed()
        labels = self._read("labels", last)
        return None if labels is None else self._rooted(labels, "component", last).select("entry", "component")
