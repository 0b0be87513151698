"""Parent-child links to full hierarchies, by tree contraction.

A forest given as (tree, id, parent) rows is contracted in rounds.  A round first *rakes* every leaf
into its parent, then *compresses* unary chains: of each run of single-child nodes an independent set
(local maxima of a hash drawn anew each round) is spliced out, its child being hung on its parent.
Each removal is recorded.  When nothing is left but roots and self-loops, the records are replayed
backwards: every node then learns its root, depth and number of descendants from the node it was hung
on.  A self-loop is what a cycle contracts to; whatever hangs on one never reaches a root.

Two executions of the same algorithm are used.  Trees of at most ``local_limit`` rows are hashed to
partitions and contracted there with numpy, all trees of a batch at once.  Larger trees, whatever
their size, are contracted by DataFrame rounds, so that no group ever has to fit into one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convolith.shared import materialise

CYCLE = "cycle"
MAX_ROUNDS = 400


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (x.astype(np.uint64) + np.uint64(salt * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(32))


def contract_forest(parent: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Root position (-1: none, the chain of parents never ends), depth and descendants of each node.

    ``parent`` holds positions, -1 for a root.
    """
    n = len(parent)
    par = parent.astype(np.int64).copy()
    own = np.ones(n, np.int64)  # a node and all that was raked into it
    over = np.zeros(n, np.int64)  # what was spliced out of the edge above a node
    up = np.ones(n, np.int64)  # length of that edge
    alive = np.arange(n, dtype=np.int64)
    log: list[tuple] = []
    for step in range(MAX_ROUNDS):
        kids = np.bincount(par[alive][par[alive] >= 0], minlength=n)
        leaf = (kids[alive] == 0) & (par[alive] >= 0)
        idx = alive[leaf]
        if len(idx):
            np.add.at(own, par[idx], own[idx] + over[idx])
            log.append(("rake", idx, par[idx], up[idx].copy()))
            alive = alive[~leaf]
            kids = np.bincount(par[alive][par[alive] >= 0], minlength=n)
        child = np.full(n, -1, np.int64)
        has = alive[par[alive] >= 0]
        child[par[has]] = has
        unary = np.zeros(n, bool)
        unary[alive] = (kids[alive] == 1) & (par[alive] >= 0) & (par[alive] != alive)
        cand = alive[unary[alive]]
        if len(cand):
            key = _mix(np.arange(n), step + 1)
            p, c = par[cand], child[cand]
            take = (~unary[p] | (key[cand] > key[p])) & (~unary[c] | (key[cand] > key[c]))
            v, c, p = cand[take], c[take], p[take]
            log.append(("splice", v, c, p, up[v].copy(), over[c].copy()))
            over[c] += own[v] + over[v]
            up[c] += up[v]
            par[c] = p
            gone = np.zeros(n, bool)
            gone[v] = True
            alive = alive[~gone[alive]]
        elif not len(idx):
            break
    else:
        raise RuntimeError("tree contraction did not end")
    root, depth, total = np.full(n, -1, np.int64), np.full(n, -1, np.int64), own.copy()
    top = alive[par[alive] < 0]
    root[top], depth[top] = top, 0
    for kind, *rec in reversed(log):
        if kind == "rake":
            v, p, w = rec
        else:
            v, c, p, w, between = rec
            total[v] = own[v] + between + total[c]
        root[v] = root[p]
        depth[v] = np.where(root[p] >= 0, depth[p] + w, -1)
    return root, depth, np.where(root >= 0, total - 1, -1)


def _solve_batch(pdf: pd.DataFrame, with_path: bool) -> pd.DataFrame:
    node = pd.MultiIndex.from_arrays([pdf["tree"], pdf["id"]])
    parent = node.get_indexer(pd.MultiIndex.from_arrays([pdf["tree"], pdf["parent"]])) if len(pdf) else np.empty(0, np.int64)
    parent = np.where(pdf["parent"].isna().to_numpy(), -1, parent)
    root, depth, below = contract_forest(parent)
    ids = pdf["id"].to_numpy(object)
    out = {"tree": pdf["tree"], "id": ids, "root_id": np.where(root >= 0, ids[root], None), "depth": depth, "n_below": below}
    if with_path:
        path: list = [None] * len(ids)
        for i in np.argsort(depth, kind="stable"):
            if depth[i] >= 0:
                path[i] = [ids[i]] if depth[i] == 0 else path[parent[i]] + [ids[i]]
        out["path"] = path
    return pd.DataFrame(out)


def _solver(with_path: bool, rows: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Whole trees are gathered up to ``rows``; the input is clustered by tree."""
        held: list[pd.DataFrame] = []
        n = 0
        for pdf in batches:
            held.append(pdf)
            n += len(pdf)
            if n < rows:
                continue
            whole = pd.concat(held, ignore_index=True)
            last = whole["tree"].iloc[-1]
            cut = int((whole["tree"] != last).to_numpy().nonzero()[0].max(initial=-1)) + 1
            if cut:
                yield _solve_batch(whole.iloc[:cut].reset_index(drop=True), with_path)
            held = [whole.iloc[cut:]]
            n = len(held[0])
        if n:
            yield _solve_batch(pd.concat(held, ignore_index=True), with_path)

    return run


def _local(nodes: DataFrame, with_path: bool, rows: int) -> DataFrame:
    schema = "tree string, id string, root_id string, depth long, n_below long" + (", path array<string>" if with_path else "")
    return nodes.repartition(F.col("tree")).sortWithinPartitions("tree").mapInPandas(_solver(with_path, rows), schema)


def _distributed(nodes: DataFrame, with_path: bool) -> DataFrame:
    """The same contraction as DataFrame rounds; state and records live in the shared folder."""
    node = F.xxhash64("tree", "id")  # seeds the coin of each round; equality is always on (tree, id)
    parents = nodes.select(F.col("tree").alias("pt"), F.col("id").alias("pi"))
    linked = nodes.join(parents, (nodes["tree"] == F.col("pt")) & (nodes["parent"] == F.col("pi")), "left")
    state = materialise(linked.select("tree", "id", F.col("pi").alias("p"), F.lit(1).cast("long").alias("own"), F.lit(0).cast("long").alias("over"), F.array().cast("array<string>").alias("via") if with_path else F.lit(1).cast("long").alias("via"), node.alias("h")), "hierarchy")
    longer: Column = F.concat("v_via", F.array("v_id"), "via") if with_path else F.col("via") + F.col("v_via")
    records: list[tuple[str, DataFrame]] = []
    for step in range(MAX_ROUNDS):
        kids = state.where("p is not null").groupBy("tree", F.col("p").alias("id")).agg(F.count("*").alias("kids"), F.min("id").alias("child"))
        seen = state.join(kids, ["tree", "id"], "left")
        leaves = seen.where("kids is null and p is not null").drop("kids", "child")
        raked = materialise(leaves.select("tree", "id", "p", "own", "via", "over"), f"rake{step}")
        n_raked = raked.count()
        if n_raked:
            records.append(("rake", raked))
            gain = raked.groupBy("tree", F.col("p").alias("id")).agg(F.sum(F.col("own") + F.col("over")).alias("gain"))
            state = state.join(raked.select("tree", "id"), ["tree", "id"], "left_anti").join(gain, ["tree", "id"], "left").withColumn("own", F.col("own") + F.coalesce("gain", F.lit(0))).drop("gain")
            state = materialise(state, f"state{step}")
            kids = state.where("p is not null").groupBy("tree", F.col("p").alias("id")).agg(F.count("*").alias("kids"), F.min("id").alias("child"))
            seen = state.join(kids, ["tree", "id"], "left")
        key = F.xxhash64("h", F.lit(step))
        unary = materialise(seen.where("kids = 1 and p is not null and p <> id").select("tree", "id", "p", "child", "own", "over", "via", key.alias("key")), f"unary{step}")
        if unary.isEmpty():
            if not n_raked:
                break
            continue
        other = unary.select("tree", F.col("id").alias("o"), F.col("key").alias("ok"))
        chosen = unary.alias("u")
        for end in ("p", "child"):
            chosen = chosen.join(other.select(F.col("tree").alias("ot"), F.col("o").alias(f"o_{end}"), F.col("ok").alias(f"k_{end}")), (F.col("tree") == F.col("ot")) & (F.col(end) == F.col(f"o_{end}")), "left").drop("ot")
        # ties of the hash are broken by the id, so that exactly one of two neighbours is the larger
        beats = lambda end: F.col(f"o_{end}").isNull() | (F.struct("key", "id") > F.struct(f"k_{end}", f"o_{end}"))
        chosen = materialise(chosen.where(beats("p") & beats("child")).select("tree", F.col("id").alias("v_id"), F.col("p").alias("v_p"), F.col("child"), F.col("own").alias("v_own"), F.col("over").alias("v_over"), F.col("via").alias("v_via")), f"chosen{step}")
        below = chosen.select("tree", F.col("child").alias("id"), "v_id", "v_p", "v_own", "v_over", "v_via")
        moved = state.join(below, ["tree", "id"], "left")
        records.append(("splice", materialise(moved.where("v_id is not null").select("tree", F.col("v_id").alias("id"), F.col("v_p").alias("p"), F.col("id").alias("c"), F.col("v_own").alias("own"), F.col("over").alias("between"), F.col("v_via").alias("via")), f"splice{step}")))
        hit = F.col("v_id").isNotNull()
        state = (
            moved.withColumn("via", F.when(hit, longer).otherwise(F.col("via")))
            .withColumn("over", F.when(hit, F.col("over") + F.col("v_own") + F.col("v_over")).otherwise(F.col("over")))
            .withColumn("p", F.when(hit, F.col("v_p")).otherwise(F.col("p")))
            .select("tree", "id", "p", "own", "over", "via", "h")
            .join(chosen.select("tree", F.col("v_id").alias("id")), ["tree", "id"], "left_anti")
        )
        state = materialise(state, f"next{step}")
    else:
        raise RuntimeError("tree contraction did not end")
    is_root = F.col("p").isNull()
    first = F.array("id") if with_path else F.lit(0).cast("long")
    done = state.select("tree", "id", F.when(is_root, F.col("id")).alias("root_id"), F.when(is_root, first).alias("trail"), F.col("own").alias("total"))
    extend = F.concat("p_trail", "via", F.array("id")) if with_path else F.col("p_trail") + F.col("via")
    for k, (kind, rec) in enumerate(reversed(records)):
        up = done.select("tree", F.col("id").alias("p"), F.col("root_id"), F.col("trail").alias("p_trail"))
        got = rec.join(up, ["tree", "p"], "left")
        if kind == "splice":
            got = got.join(done.select("tree", F.col("id").alias("c"), F.col("total").alias("c_total")), ["tree", "c"], "left").withColumn("total", F.col("own") + F.col("between") + F.col("c_total"))
        else:
            got = got.withColumn("total", F.col("own"))
        done = materialise(done.unionByName(got.select("tree", "id", "root_id", extend.alias("trail"), "total")), f"replay{k}")
    ended = F.col("root_id").isNotNull()
    depth = F.size("trail").cast("long") - 1 if with_path else F.col("trail")
    out = done.select("tree", "id", "root_id", F.when(ended, depth).otherwise(-1).cast("long").alias("depth"), F.when(ended, F.col("total") - 1).otherwise(-1).cast("long").alias("n_below"), *([F.col("trail").alias("path")] if with_path else []))
    return out


def hierarchies(df: DataFrame, tree: str, id: str, parent: str, with_path: bool = False, local_limit: int = 50_000, batch_rows: int = 200_000) -> DataFrame:
    """Root, depth, number of descendants (and path) of each node of the forests in ``df``.

    Returns ``tree, id, root_id, depth, n_below`` and, if asked, ``path`` (array of ids, root first).
    A node whose chain of parents never ends has root_id ``cycle``, depth and n_below -1, path null.

    Defined cases: rows with a null id are no nodes and are left out; a null tree is a tree of its own;
    a parent that is null or names no id of the same tree makes a root; an id equal to its own parent is
    a cycle; several rows with the same (tree, id) count as one node, with the least non-null parent;
    an empty table gives an empty result; extra columns are ignored.  The sizes of trees are counted
    first: those above ``local_limit`` rows are contracted by distributed rounds.
    """
    nodes = df.select(F.coalesce(F.concat(F.lit("="), F.col(tree).cast("string")), F.lit("null")).alias("tree"), F.col(id).cast("string").alias("id"), F.col(parent).cast("string").alias("parent")).where("id is not null")
    nodes = nodes.groupBy("tree", "id").agg(F.min("parent").alias("parent"))
    sizes = nodes.groupBy("tree").agg(F.count("*").alias("n")).where(F.col("n") > local_limit).select("tree")
    big = materialise(sizes, "big_trees")
    if big.isEmpty():
        out = _local(nodes, with_path, batch_rows)
    else:
        out = _local(nodes.join(big, "tree", "left_anti"), with_path, batch_rows).unionByName(_distributed(nodes.join(big, "tree", "left_semi"), with_path))
    original = F.when(F.col("tree") == "null", F.lit(None)).otherwise(F.expr("substring(tree, 2)")).cast(df.schema[tree].dataType)
    return out.withColumn("tree", original).withColumn("root_id", F.coalesce("root_id", F.lit(CYCLE))).withColumnRenamed("tree", tree)


def descendants(df: DataFrame, tree: str, id: str, parent: str, **options) -> DataFrame:
    """All (ancestor_id, id, distance) rows, one for each node below another; cycles have none."""
    full = hierarchies(df, tree, id, parent, with_path=True, **options)
    step = full.select(tree, "id", "depth", F.posexplode("path").alias("at", "ancestor_id"))
    return step.where("at < depth").select(tree, "ancestor_id", "id", (F.col("depth") - F.col("at")).alias("distance"))


