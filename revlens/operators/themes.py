"""Theme clustering (I1-I7): average linkage on cosine distance within
(session, category, sentiment), cut below a distance threshold.

For unit vectors the mean pairwise cosine distance of clusters A and B is
``1 - (S_A / n_A) . (S_B / n_B)`` with S the sum of member unit vectors, so a
cluster is just (sum vector, size).  Average linkage is reducible: a merged
cluster is no nearer to a third one than the nearer of its parts.  So

* merging every reciprocal-nearest-neighbour pair below the threshold in a round
  gives the same clusters as merging one pair at a time;
* a cluster keeps its nearest neighbour until that one merges, so only merged
  clusters and those whose neighbour merged look again;
* a cluster whose nearest neighbour is at the threshold or beyond is final, for
  itself and for all others, and leaves the table.

A round therefore compares the few clusters that look again with the clusters
still open in their group.  Both are dealt to bounded blocks by hash, every two
blocks meet in a tile (the shuffle key) and matrix products of a part of the askers
at a time yield each one's best partner in it; no cluster pairs are emitted and a large group
spreads over many tasks.  The table is written to the shared folder each round;
the merges it records are followed to their ends at the end.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.functions.exprs import ranked
from revlens.functions.tiles import dealt, tile_groups
from revlens.session import cut_lineage
from revlens.types import (CLUSTER_DISTANCE_THRESHOLD, MIN_CATEGORY_SIZE_FOR_THEMES, MIN_REVIEWS_FOR_THEMES,
                           MIN_THEME_SIZE)

GROUP = ["session_id", "category", "sentiment"]
#: vectors of a block, and askers compared with a block at a time
BLOCK, PART = 8192, 512


def _norm(c):
    return F.sqrt(F.aggregate(c, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def _unit(c):
    """The unit vector, null for a zero one.  The array of one holds the norm: named inside the inner function it would be made once an element."""
    return F.transform(F.array(_norm(c)), lambda norm: F.when(norm > 0, F.transform(c, lambda x: x.cast("double") / norm)))[0]


def _best(aid: np.ndarray, am: np.ndarray, bid: np.ndarray, bm: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(id, distance) of the nearest other row of ``b`` for every row of ``a`` (ties: smaller id; distance inf: none), PART rows at a time."""
    order = np.argsort(bid, kind="stable")
    bid, bm = bid[order], bm[order]
    nn, dist = np.empty(len(aid), bid.dtype), np.empty(len(aid))
    for at in range(0, len(aid), PART):
        own = aid[at:at + PART]
        d = am[at:at + PART] @ bm.T
        np.subtract(1.0, d, out=d)
        lo, n = np.searchsorted(bid, own), np.searchsorted(bid, own, "right")
        n = np.where(own == own, n - lo, 0)  # a null id equals none
        d[np.repeat(np.arange(len(own)), n), np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())] = np.inf
        first = d.argmin(axis=1)
        nn[at:at + PART], dist[at:at + PART] = bid[first], d[np.arange(len(own)), first]
    return nn, dist


def _nearest(clusters: DataFrame, block: int) -> DataFrame:
    """GROUP + cid -> (nn, dist) of the clusters that ask (``_asks``): nearest other cluster of the same group (ties: smaller id)."""
    fan = clusters.groupBy(*GROUP).agg(F.ceil(F.count_if("_asks") / block).alias("_fa"), F.ceil(F.count(F.lit(1)) / block).alias("_fc")).filter("_fa > 0")
    d = clusters.join(fan, GROUP)

    def places(mine: str, others: str, right: bool):
        own = F.expr(f"pmod(xxhash64(cid), {mine})")
        each = F.sequence(F.lit(0).cast("long"), F.col(others) - 1)
        i, j = (lambda o: o, lambda o: own) if right else (lambda o: own, lambda o: o)
        return F.transform(each, lambda o: F.struct(i(o).alias("_i"), j(o).alias("_j"), F.lit(right).alias("_right")))

    none = F.array().cast("array<struct<_i:bigint,_j:bigint,_right:boolean>>")
    at = F.concat(places("_fc", "_fa", True), F.when(F.col("_asks"), places("_fa", "_fc", False)).otherwise(none))
    tile = [*GROUP, "_i", "_j"]
    tiles = dealt(d.select(*GROUP, "cid", "n", "s", F.inline(at)), tile)
    types = dict(clusters.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in GROUP) + ", cid long, nn long, dist double"

    def run(batches):
        for g in tile_groups(batches, tile):
            head = g.iloc[0]
            sides = [g[~g["_right"]], g[g["_right"]]]
            if min(map(len, sides)) == 0:
                continue
            (aid, am), (bid, bm) = [(x["cid"].to_numpy(), np.stack(x["s"].to_list()) / x["n"].to_numpy()[:, None]) for x in sides]
            nn, best = _best(aid, am, bid, bm)
            ok = np.isfinite(best)
            out = pd.DataFrame({"cid": aid[ok], "nn": nn[ok], "dist": best[ok]})
            for k in GROUP:
                out.insert(0, k, head[k])
            yield out[[*GROUP, "cid", "nn", "dist"]]

    found = tiles.mapInPandas(run, schema)
    best = found.groupBy(*GROUP, "cid").agg(F.min(F.struct("dist", "nn")).alias("m"))
    return best.select(*GROUP, "cid", "m.nn", "m.dist")


def _merged(state: DataFrame) -> DataFrame:
    """The clusters after one round: reciprocal neighbours merge; ``nn`` is null for clusters that look again.

    ``gone`` names the cluster that a merged one took in.
    """
    link = state.select(*GROUP, "cid", "nn")
    back = link.select(*GROUP, F.col("nn").alias("cid"), F.col("cid").alias("nn"), F.lit(True).alias("_mutual"))
    seen = state.join(back, [*GROUP, "cid", "nn"], "left").withColumn("_mutual", F.coalesce("_mutual", F.lit(False)))
    merging = seen.filter("_mutual")
    keep, gone = merging.filter("cid < nn"), merging.filter("cid > nn")
    sums = gone.select(*GROUP, F.col("nn").alias("cid"), F.col("cid").alias("gone"), F.col("n").alias("_n"), F.col("s").alias("_s"))
    out = keep.drop("gone").join(sums, [*GROUP, "cid"]).select(
        *GROUP, "cid", (F.col("n") + F.col("_n")).alias("n"), F.zip_with("s", "_s", lambda p, q: p + q).alias("s"),
        F.lit(None).cast("long").alias("nn"), F.lit(None).cast("double").alias("dist"), "gone")
    lost = merging.select(*GROUP, F.col("cid").alias("nn"), F.lit(True).alias("_lost"))
    rest = seen.filter("NOT _mutual").join(lost, [*GROUP, "nn"], "left")
    rest = rest.select(*GROUP, "cid", "n", "s", F.when(F.col("_lost").isNull(), F.col("nn")).alias("nn"),
                       F.when(F.col("_lost").isNull(), F.col("dist")).alias("dist"), F.lit(None).cast("long").alias("gone"))
    return out.unionByName(rest)


def average_linkage(items: DataFrame, threshold: float = CLUSTER_DISTANCE_THRESHOLD, block: int = BLOCK,
                    watch: Callable[[int, int], None] | None = None) -> DataFrame:
    """Final cluster id per item.

    ``items``: GROUP keys + ``item`` (long, unique in its group) + ``vec`` (array).  Zero vectors stay singletons.
    Returns GROUP + item + cid (the cluster's smallest item).  ``watch`` is told of each round
    how many clusters look again and how many are open.
    """
    # a group's rows come from a join by its key, all in one task
    tasks = 2 * int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    it = items.repartition(tasks, *GROUP, "item").filter(_norm(F.col("vec")) > 0).withColumn("u", _unit(F.col("vec")))
    open_ = cut_lineage(it.select(
        *GROUP, F.col("item").alias("cid"), F.lit(1).cast("long").alias("n"), F.col("u").alias("s"),
        F.lit(None).cast("long").alias("nn"), F.lit(None).cast("double").alias("dist"), F.lit(None).cast("long").alias("gone")))
    merges, fresh = [], True
    while True:
        if watch is not None:
            watch(open_.filter("nn IS NULL").count(), open_.count())
        found = _nearest(open_.withColumn("_asks", F.col("nn").isNull()), block)
        found = found.withColumnRenamed("nn", "_nn").withColumnRenamed("dist", "_dist")
        state = cut_lineage(open_.join(found, [*GROUP, "cid"], "left").select(
            *GROUP, "cid", "n", "s", F.coalesce("nn", "_nn").alias("nn"), F.coalesce("dist", "_dist").alias("dist")).filter(F.col("dist") < threshold))
        if state.isEmpty():
            break
        open_ = cut_lineage(_merged(state))
        step = open_.filter("gone IS NOT NULL")
        if step.isEmpty():
            # without a merge and with all neighbours just looked up none is left below the threshold;
            # kept ones can differ from it by rounding alone, so look all up once more
            if fresh:
                break
            open_, fresh = state.select("*", F.lit(None).cast("long").alias("gone")).withColumns(
                {"nn": F.lit(None).cast("long"), "dist": F.lit(None).cast("double")}), True
            continue
        merges.append(step.select(*GROUP, "gone", F.col("cid").alias("keep")))
        fresh = False
    members = items.select(*GROUP, "item", F.col("item").alias("cid"))
    if not merges:
        return members
    log = merges[0]
    for m in merges[1:]:
        log = log.unionByName(m)
    log = cut_lineage(log)  # gone -> keep, each cluster gone once
    for _ in range(math.ceil(math.log2(len(merges)))):  # a chain has a merge per round at most; every step doubles how far one points
        onward = log.select(*GROUP, F.col("gone").alias("keep"), F.col("keep").alias("_to"))
        log = cut_lineage(log.join(onward, [*GROUP, "keep"], "left").select(*GROUP, "gone", F.coalesce("_to", "keep").alias("keep")))
    return cut_lineage(members.join(log.withColumnRenamed("gone", "cid"), [*GROUP, "cid"], "left")
                       .select(*GROUP, "item", F.coalesce("keep", "cid").alias("cid")))


def theme_inputs(results: DataFrame) -> DataFrame:
    """I1 gates: sessions with fewer than 15 reviews are skipped; categories under 4 reviews are all unique.

    ``results``: session_id, review_id, review, category, sentiment, urgency, vec.
    """
    c_tot = results.groupBy("session_id", "category").agg(F.count(F.lit(1)).alias("category_total"))
    s_tot = c_tot.groupBy("session_id").agg(F.sum("category_total").alias("session_total")).filter(F.col("session_total") >= MIN_REVIEWS_FOR_THEMES)
    return results.join(c_tot.join(s_tot, "session_id"), ["session_id", "category"])


def cluster_themes(results: DataFrame, threshold: float = CLUSTER_DISTANCE_THRESHOLD) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(themes, theme_members, unique_reviews).  ``review_id`` is unique in its session."""
    r = theme_inputs(results).withColumn("item", F.col("review_id").cast("long"))
    own, cluster = [*GROUP, "item"], [*GROUP, "cid"]
    clusterable = r.filter(F.col("category_total") >= MIN_CATEGORY_SIZE_FOR_THEMES)
    members = average_linkage(clusterable.select(*GROUP, "item", "vec"), threshold)
    sizes = members.groupBy(*cluster).agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") >= MIN_THEME_SIZE)
    in_theme = members.join(sizes, cluster).join(r.select(*GROUP, "item", "review_id", "review", "urgency", "vec"), own)
    # I3 representative: highest cosine to the mean raw vector (zero norm -> 1e-12), first on tie
    dims = in_theme.select(*cluster, F.posexplode("vec").alias("d", "x")).groupBy(*cluster, "d") \
        .agg(F.avg(F.col("x").cast("double")).alias("mx"))
    centroid = dims.groupBy(*cluster).agg(F.array_sort(F.collect_list(F.struct("d", "mx"))).alias("c")) \
        .select(*cluster, F.transform("c", lambda z: z["mx"]).alias("centroid"))
    dot = F.aggregate(F.zip_with(F.col("vec"), F.col("centroid"), lambda p, q: p.cast("double") * q),
                      F.lit(0.0), lambda acc, v: acc + v)
    nv = F.sqrt(F.aggregate(F.col("vec"), F.lit(0.0), lambda acc, v: acc + v.cast("double") * v.cast("double")))
    nc = F.sqrt(F.aggregate(F.col("centroid"), F.lit(0.0), lambda acc, v: acc + v * v))
    den = F.when(nv * nc == 0, F.lit(1e-12)).otherwise(nv * nc)
    scored = in_theme.join(centroid, cluster).withColumn("sim", dot / den)
    themes = scored.groupBy(*cluster).agg(
        F.count(F.lit(1)).alias("count"),
        F.count_if(F.lower("urgency") == "critical").alias("critical_count"),
        F.max_by("review", F.struct(F.col("sim"), -F.col("review_id"))).alias("theme_quote"),
        F.max_by("review_id", F.struct(F.col("sim"), -F.col("review_id"))).alias("quote_review_id"))
    themes = themes.withColumnRenamed("sentiment", "dominant_sentiment")
    themes = ranked(themes, ["session_id", "category"],
                    [F.col("count").desc(), F.col("critical_count").desc(), F.col("cid").asc()], "rank")
    theme_members = in_theme.select("session_id", "category", "cid", "review_id")
    unique = (r.join(in_theme.select(*own), own, "left_anti")
              .select("session_id", "category", F.col("review").alias("quote"), "review_id", "urgency", "sentiment"))
    return themes, theme_members, unique


def reconcile(themes: DataFrame, unique: DataFrame, results: DataFrame) -> DataFrame:
    """Per category, clustered + unique must equal the total; critical reviews must not be lost.

    Returns one row per (session, category) with ``ok``; callers raise on any false.
    """
    tot = theme_inputs(results).groupBy("session_id", "category").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.lower("urgency") == "critical").alias("critical_total"))
    cl = themes.groupBy("session_id", "category").agg(F.sum("count").alias("clustered"),
                                                      F.sum("critical_count").alias("critical_clustered"))
    un = unique.groupBy("session_id", "category").agg(F.count(F.lit(1)).alias("unique"),
                                                      F.count_if(F.lower("urgency") == "critical").alias("critical_unique"))
    j = tot.join(cl, ["session_id", "category"], "left").join(un, ["session_id", "category"], "left") \
        .na.fill(0, ["clustered", "critical_clustered", "unique", "critical_unique"])
    return j.withColumn("ok", (F.col("clustered") + F.col("unique") == F.col("total"))
                        & (F.col("critical_clustered") + F.col("critical_unique") == F.col("critical_total")))


def themed_categories(themes: DataFrame, categories: DataFrame) -> DataFrame:
    """Categories with at least one theme."""
    return categories.join(themes.select("session_id", "category").distinct(), ["session_id", "category"], "left_semi")


def average_linkage_reference(vecs: list[np.ndarray], threshold: float) -> list[int]:
    """Plain one-merge-at-a-time average linkage on cosine distance (for tests)."""
    units = [v / np.linalg.norm(v) for v in vecs]
    clusters = {i: [i] for i in range(len(vecs))}
    while len(clusters) > 1:
        best = None
        keys = sorted(clusters)
        for x in range(len(keys)):
            for y in range(x + 1, len(keys)):
                a, b = clusters[keys[x]], clusters[keys[y]]
                d = float(np.mean([1.0 - units[i] @ units[j] for i in a for j in b]))
                if best is None or d < best[0]:
                    best = (d, keys[x], keys[y])
        if best is None or best[0] >= threshold:
            break
        _, ka, kb = best
        clusters[ka] = clusters[ka] + clusters.pop(kb)
    label = [0] * len(vecs)
    for k, mem in clusters.items():
        for i in mem:
            label[i] = min(mem)
    return label
