"""Random forests on weighted cells, as tables.

Rows are counted once into cells: equal binned features make one cell with a count per class. Binning bounds the cells,
whatever the number of rows, and a fold's training set is the total less the fold's own cells, so that no fold reads the
rows again. Where a fold's cells fit a task, its trees grow in tasks, some at a time, and small folds of a group together. Beyond that all trees of all folds grow together,
level by level: one histogram (node, feature, bin) by a grouped aggregate, prefix sums along the bins, the best split of every
node, and a join that sends the cells on to the children. Both give the same trees.

Draws are functions of md5, as in the sampling operators: a cell of n rows is drawn Poisson(n) times into a tree, which is
what drawing each of its rows with replacement gives; a node looks at the features that come first in its own hashed order. So a
model is the same in any engine and under any layout, and it is a table (fold, tree, node, feature, bin, counts of the
children, gain): children of node i are 2i and 2i + 1, and what is not split is a leaf.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.operators.ranking import global_index, running_total
from cohortlens.operators.tree_growth import BLOCK_ENTRIES, EXACT_POISSON, MIN_RISE, boosted_margins, grow_classes, poisson_draws, poisson_ends, votes_of
from cohortlens.session import drop_stored, stored

#: Cells of a fold up to which one task grows a tree of it; larger ones grow by jobs over all cells, with the same result.
TASK_CELLS = 200_000
#: Groups of a fold's trees that are grown by a task each, at least, while there are trees enough.
TREE_GROUPS = 200
#: Cells of the folds that a task handles together, where there are folds enough for ``TREE_GROUPS`` tasks.
GROUP_CELLS = 8_000
#: Cells of a task of many groups, about.
SHUFFLED_CELLS = 500_000
#: Leaf shares and votes are whole numbers of this unit, so that their sums have no order.
UNIT = 1_000_000


def feature_thresholds(df: DataFrame, features: Sequence[str], max_bins: int) -> list[list[float]]:
    """Upper ends of all bins but the last, per feature: bin = number of ends below the value.

    A feature of up to ``max_bins`` values has a bin for each; another one has bins of about equal counts, where a value
    belongs to bin floor(max_bins * rows below it / rows). The driver receives up to ``max_bins`` numbers a feature.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("f"), F.col(f"`{c}`").cast("double").alias("v")) for i, c in enumerate(features)]))
    counts = stored(df.select(pairs.alias("x")).select("x.f", "x.v").where("v is not null").groupBy("f", "v").agg(F.count(F.lit(1)).alias("n")), "values")
    sizes = {r["f"]: (r["c"], r["n"]) for r in counts.groupBy("f").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("n")).collect()}
    few = [i for i, (c, _) in sizes.items() if c <= max_bins]
    out: list[list[float]] = [[] for _ in features]
    for r in counts.where(F.col("f").isin(few)).select("f", "v").collect():
        out[r["f"]].append(r["v"])
    for i, (c, n) in sizes.items():
        if c > max_bins:
            ordered = global_index(counts.where(F.col("f") == i).select("v", "n"), ["v"], "at")
            upto = running_total(ordered, "at", ["n"])
            of = F.floor((F.col("n_cum") - F.col("n")) * F.lit(max_bins) / F.lit(n))
            out[i] = [r[0] for r in upto.groupBy(of.alias("b")).agg(F.max("v").alias("v")).select("v").collect()]
    drop_stored(counts)
    return [sorted(v)[:-1] for v in out]


def binned(df: DataFrame, features: Sequence[str], ends: Sequence[Sequence[float]]) -> DataFrame:
    """Add the bins ``b0``, ``b1``, ... of the features; a null counts as below all values."""
    def place(c, e):
        value = F.col(f"`{c}`").cast("double")
        return F.size(F.filter(F.array(*[F.lit(float(x)) for x in e]), lambda t: t < value)) if e else F.lit(0)
    return df.withColumns({f"b{i}": place(c, e).cast("int") for i, (c, e) in enumerate(zip(features, ends))})


def bin_columns(n: int) -> list[str]:
    return [f"b{i}" for i in range(n)]


def count_cells(df: DataFrame, n_features: int, label: Column, by: Sequence[str] = ()) -> DataFrame:
    """(by, bins, n0, n1): rows of class 0 and 1 of every cell, one pass."""
    return df.groupBy(*by, *bin_columns(n_features)).agg(F.count_if(label == 0).alias("n0"), F.count_if(label == 1).alias("n1"))


def leave_one_out(cells: DataFrame, n_features: int, fold_col: str, folds: DataFrame) -> DataFrame:
    """(folds, bins, n0, n1, t0, t1): every fold's training counts, all cells less its own, and its own (test) counts.

    ``folds`` has a row for each ``fold`` (int), and may have other columns, which stay.
    """
    keys = bin_columns(n_features)
    total = stored(cells.groupBy(*keys).agg(F.sum("n0").alias("a0"), F.sum("n1").alias("a1")), "total")
    # The folds are spread, so that their cells are not made by the one task that holds the totals.
    each = folds.repartition(max(1, min(TREE_GROUPS, folds.count())), "fold").crossJoin(total)
    own = (cells.withColumn("fold", F.col(fold_col).cast("int")).join(folds.select("fold"), "fold", "left_semi")
           .select("fold", *keys, F.col("n0").alias("t0"), F.col("n1").alias("t1")))
    c = lambda x: F.coalesce(x, F.lit(0))
    return each.join(own, ["fold", *keys], "left").select(
        *folds.columns, *keys, (F.col("a0") - c("t0")).alias("n0"), (F.col("a1") - c("t1")).alias("n1"), c("t0").alias("t0"), c("t1").alias("t1"))


def poisson_draw(n: Column, digest: Column) -> Column:
    """How often a cell of ``n`` rows is drawn, by an md5 digest: Poisson(n), normal above ``EXACT_POISSON``."""
    unit = lambda at: (F.conv(F.substring(digest, at, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(16 ** 13))
    table = F.array(*[F.array(*[F.lit(x) for x in poisson_ends(k)]) for k in range(1, EXACT_POISSON + 1)])

    def draw(u: Column) -> Column:
        exact = F.size(F.filter(F.get(table, (n - 1).cast("int")), lambda end: u["a"] >= end))
        z = F.sqrt(F.lit(-2.0) * F.ln(u["a"])) * F.cos(F.lit(2.0 * math.pi) * u["b"])
        wide = F.greatest(F.lit(0), n + F.round(F.sqrt(n.cast("double")) * z).cast("long"))
        return F.when(n <= 0, F.lit(0)).when(n <= EXACT_POISSON, exact).otherwise(wide).cast("long")

    # As the variable of a lambda the two uniforms are computed once, not once for each entry of the table.
    return F.get(F.transform(F.array(F.struct(unit(1).alias("a"), unit(14).alias("b"))), draw), F.lit(0))


def subset_size(strategy: str, n_features: int, n_trees: int) -> int:
    """Number of features a node looks at, for the strategies auto, all, sqrt, log2 and onethird of a classification."""
    sizes = {"all": n_features, "sqrt": math.ceil(math.sqrt(n_features)), "log2": max(1, math.ceil(math.log2(n_features))),
             "onethird": math.ceil(n_features / 3)}
    sizes["auto"] = sizes["sqrt"] if n_trees > 1 else n_features
    return sizes[strategy]


SPLITS = "fold int, tree int, node int, feature int, bin int, l0 long, l1 long, r0 long, r1 long, gain double"


def fold_sizes(cells: DataFrame) -> tuple[int, int]:
    """The cells of the largest fold, and the number of folds."""
    of = cells.groupBy("fold").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n"), F.count(F.lit(1)).alias("folds")).first()
    return of["n"] or 0, of["folds"]


def _group_of(largest: int, folds: int) -> tuple[Column, int]:
    """The group of a fold, and in how many tasks of about equal work the groups go."""
    together = max(1, min(GROUP_CELLS // max(1, largest), folds // TREE_GROUPS))
    groups = max(1, -(-folds // together))
    return F.expr(f"fold div {together}"), max(1, min(groups, max(TREE_GROUPS, largest * folds // SHUFFLED_CELLS)))


def _grow_in_tasks(cells: DataFrame, n_features: int, num_trees: int, max_depth: int, chosen: int, seed: int, sizes: tuple[int, int]) -> DataFrame:
    """Each fold's trees, some at a time: as many groups of trees a fold as give ``TREE_GROUPS`` tasks' worth in all."""
    keys = bin_columns(n_features)
    parts = max(1, min(num_trees, -(-TREE_GROUPS // max(1, sizes[1]))))
    group, tasks = _group_of(*sizes)

    def one(key, frame):
        import numpy as np
        import pandas as pd

        part = key[1]
        folds, place = np.unique(frame["fold"].to_numpy(np.int64), return_inverse=True)
        bins, n0, n1 = frame[keys].to_numpy(np.int64), frame["n0"].to_numpy(np.int64), frame["n1"].to_numpy(np.int64)
        ends = [(":" + ":".join(map(str, b))).encode() for b in bins.tolist()]
        mine = list(range(part, num_trees, parts))
        some = max(1, BLOCK_ENTRIES // max(1, len(bins)))
        made = []
        for lo in range(0, len(mine), some):
            block = mine[lo:lo + some]
            w0, w1 = [], []
            for t in block:
                heads = [f"{f}:{t}".encode() for f in folds.tolist()]
                names = [heads[i] + e for i, e in zip(place.tolist(), ends)]
                w0.append(poisson_draws(n0, names, f":0:{seed}".encode()))
                w1.append(poisson_draws(n1, names, f":1:{seed}".encode()))
            w0, w1 = np.array(w0, np.float64).ravel(), np.array(w1, np.float64).ravel()
            # The trees of the block, each in every fold.
            owner = (np.arange(len(block))[:, None] * len(folds) + place).ravel()
            drawn = w0 + w1 > 0
            found = grow_classes(np.tile(bins, (len(block), 1))[drawn], w0[drawn], w1[drawn], max_depth, chosen,
                                 [f"{f}:{t}" for t in block for f in folds.tolist()], seed, owner[drawn])
            some_rows = pd.DataFrame(dict(zip(names_of[1:], found)))
            rooted = np.unique(owner[drawn])  # A tree that drew no cell has no root.
            zeros = np.zeros(len(rooted), np.int64)
            roots = pd.DataFrame({"tree": rooted, "node": zeros, "feature": -1, "bin": -1, "l0": zeros, "l1": zeros, "r0": np.bincount(owner, w0)[rooted],
                                  "r1": np.bincount(owner, w1)[rooted], "gain": 0.0})
            rows = pd.concat([some_rows, roots]).astype({c: "int64" for c in names_of[1:-1]})
            tree, fold = np.divmod(rows["tree"].to_numpy(), len(folds))
            rows["tree"] = np.array(block)[tree]
            rows.insert(0, "fold", folds[fold])
            made.append(rows)
        out = pd.concat(made).astype({"feature": "Int32", "bin": "Int32"})
        out.loc[out["node"] == 0, ["feature", "bin"]] = None
        return out

    names_of = [c.split()[0] for c in SPLITS.split(", ")]
    part = F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    rows = cells.select("fold", *keys, "n0", "n1", group.alias("_group"), part.alias("_part")).repartition(tasks * parts, "_group", "_part")
    return rows.groupBy("_group", "_part").applyInPandas(one, SPLITS)


def boosted_predictions(cells: DataFrame, n_features: int, iterations: int, max_depth: int, step: float) -> DataFrame:
    """Add ``prediction`` by boosted trees per fold, small folds of a group in one task: for folds of up to ``TASK_CELLS`` cells."""
    keys = bin_columns(n_features)
    group, tasks = _group_of(*fold_sizes(cells))

    def one(frame):
        import numpy as np

        # Sums then have the same order however the cells arrive.
        frame = frame.sort_values(["fold", *keys], ignore_index=True).drop(columns="_group")
        place = np.unique(frame["fold"].to_numpy(np.int64), return_inverse=True)[1]
        n0, n1 = frame["n0"].to_numpy(np.float64), frame["n1"].to_numpy(np.float64)
        margin = boosted_margins(frame[keys].to_numpy(np.int64), n0, n1, iterations, max_depth, step, place)
        return frame.assign(prediction=(margin > 0).astype(np.float64))

    kinds = dict(cells.dtypes)
    return (cells.withColumn("_group", group).repartition(tasks, "_group").groupBy("_group")
            .applyInPandas(one, ", ".join(f"{c} {kinds[c]}" for c in cells.columns) + ", prediction double"))


def grow_forest(cells: DataFrame, n_features: int, num_trees: int = 50, max_depth: int = 8, subset: str = "auto", seed: int = 5043,
                task_cells: int = TASK_CELLS) -> DataFrame:
    """The splits (fold, tree, node, feature, bin, l0, l1, r0, r1, gain) of ``num_trees`` trees per fold; stored.

    ``cells`` has fold, bins and training counts n0 and n1. Values in bins up to ``bin`` go left. The gain is the decrease
    of gini impurity times the node's weight. Ties go to the first feature, then the lowest bin. The root's counts are in a row of
    node 0, whose right child it is.
    """
    keys = bin_columns(n_features)
    chosen = subset_size(subset, n_features, num_trees)
    sizes = fold_sizes(cells)
    if sizes[0] <= task_cells:
        return stored(_grow_in_tasks(cells, n_features, num_trees, max_depth, chosen, seed, sizes), "forest")
    tree = F.explode(F.sequence(F.lit(0), F.lit(num_trees - 1)))
    key = F.concat_ws(":", "fold", "tree", *keys)
    draw = lambda c, tag: poisson_draw(F.col(c), F.md5(F.concat(key, F.lit(f":{tag}:{seed}"))))
    rows = (cells.select("fold", *keys, "n0", "n1").withColumn("tree", tree)
            .select("fold", "tree", *keys, draw("n0", 0).alias("w0"), draw("n1", 1).alias("w1"), F.lit(1).alias("node")).where("w0 + w1 > 0"))
    rows = stored(rows, "tree-rows")
    none = F.lit(None).cast("int")
    made = [stored(rows.groupBy("fold", "tree").agg(F.sum("w0").alias("r0"), F.sum("w1").alias("r1"))
                   .select("fold", "tree", F.lit(0).alias("node"), none.alias("feature"), none.alias("bin"), F.lit(0).cast("long").alias("l0"),
                           F.lit(0).cast("long").alias("l1"), "r0", "r1", F.lit(0.0).alias("gain")), "roots")]
    at = ["fold", "tree", "node"]
    for _ in range(max_depth):
        places = F.explode(F.array(*[F.struct(F.lit(i).alias("feature"), F.col(b).alias("bin")) for i, b in enumerate(keys)]))
        hist = (rows.select(*at, places.alias("x"), "w0", "w1").groupBy(*at, "x.feature", "x.bin")
                .agg(F.sum("w0").alias("w0"), F.sum("w1").alias("w1")))
        along = Window.partitionBy(*at, "feature").orderBy("bin")
        whole = Window.partitionBy(*at, "feature")
        cut = hist.select(*at, "feature", "bin", F.sum("w0").over(along).alias("l0"), F.sum("w1").over(along).alias("l1"),
                          F.sum("w0").over(whole).alias("a0"), F.sum("w1").over(whole).alias("a1"))
        cut = cut.select("*", (F.col("a0") - F.col("l0")).alias("r0"), (F.col("a1") - F.col("l1")).alias("r1")).where("r0 + r1 > 0 and a0 > 0 and a1 > 0")
        squares = lambda s: ((F.col(f"{s}0").cast("double") * F.col(f"{s}0") + F.col(f"{s}1").cast("double") * F.col(f"{s}1"))
                             / (F.col(f"{s}0") + F.col(f"{s}1")).cast("double"))
        scored = cut.select("*", (squares("l") + squares("r")).alias("score"), squares("a").alias("parent"))
        # The features of a node: the first in an order of its own.
        order = F.md5(F.concat_ws(":", *at, "feature", F.lit(seed)))
        top = scored.groupBy(*at, "feature").agg(F.max(F.struct("score", (-F.col("bin")).alias("b"), "l0", "l1", "r0", "r1", "parent")).alias("s"))
        every = hist.select(*at, "feature").distinct().withColumn("rank", F.row_number().over(Window.partitionBy(*at).orderBy(order)))
        best = (top.join(every.where(F.col("rank") <= chosen), [*at, "feature"])
                .groupBy(*at).agg(F.max(F.struct(F.col("s.score").alias("score"), (-F.col("feature")).alias("f"), "s")).alias("m"))
                .where(F.col("m.score") > F.col("m.s.parent") * MIN_RISE)
                .select(*at, (-F.col("m.f")).alias("feature"), (-F.col("m.s.b")).alias("bin"), "m.s.l0", "m.s.l1", "m.s.r0", "m.s.r1",
                        (F.col("m.score") - F.col("m.s.parent")).alias("gain")))
        best = stored(best, "splits")
        if best.isEmpty():
            break
        made.append(best)
        value = F.get(F.array(*keys), F.col("feature"))
        after = stored(rows.join(best.select(*at, "feature", "bin"), at)
                       .select("fold", "tree", *keys, "w0", "w1", (2 * F.col("node") + (value > F.col("bin")).cast("int")).alias("node")), "tree-rows")
        drop_stored(rows)
        rows = after
    out = made[0]
    for more in made[1:]:
        out = out.unionByName(more)
    out = stored(out, "forest")
    for part in [rows, *made]:
        drop_stored(part)
    return out


def forest_votes(splits: DataFrame, cells: DataFrame, n_features: int, max_depth: int, task_cells: int = TASK_CELLS) -> DataFrame:
    """Add ``votes``, the trees' shares of class 1 in millionths, and ``prediction`` to cells of (fold, bins); a tie is class 0.

    Folds of up to ``task_cells`` cells meet their forest in a task, small ones of a group together; larger ones go down the trees by
    a join a level.
    """
    share = lambda s: F.when(F.col(f"{s}0") + F.col(f"{s}1") > 0, F.expr(f"{s}1 * {UNIT} div ({s}0 + {s}1)")).otherwise(0).cast("long").alias(s)
    model = splits.select("fold", "tree", "node", "feature", "bin", share("l"), share("r"))
    n_trees = splits.where("node = 0").groupBy("fold").agg(F.count(F.lit(1)).alias("_trees"))
    sizes = fold_sizes(cells)
    if sizes[0] <= task_cells:
        voted = _votes_in_tasks(model, cells, n_features, max_depth, sizes)
    else:
        voted = _votes_by_joins(model, cells, n_features, max_depth)
    return voted.join(stored(n_trees, "sizes"), "fold").withColumn("prediction", (2 * F.col("votes") > F.col("_trees") * UNIT).cast("double")).drop("_trees")


def _votes_in_tasks(model: DataFrame, cells: DataFrame, n_features: int, max_depth: int, sizes: tuple[int, int]) -> DataFrame:
    keys = bin_columns(n_features)
    group, tasks = _group_of(*sizes)

    def one(frame, splits):
        import numpy as np

        folds, place = np.unique(frame["fold"].to_numpy(np.int64), return_inverse=True)
        splits = splits[splits["fold"].isin(folds)]
        columns = [splits[c].fillna(-1).to_numpy(np.int64) for c in ("tree", "node", "feature", "bin", "l", "r")]
        forests = np.searchsorted(folds, splits["fold"].to_numpy(np.int64))
        return frame.drop(columns="_group").assign(votes=votes_of(frame[keys].to_numpy(np.int64), place, forests, *columns, max_depth))

    kinds = dict(cells.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in cells.columns) + ", votes long"
    grouped = lambda df: df.withColumn("_group", group).repartition(tasks, "_group").groupBy("_group")
    return grouped(cells).cogroup(grouped(model)).applyInPandas(one, schema)


def _votes_by_joins(model: DataFrame, cells: DataFrame, n_features: int, max_depth: int) -> DataFrame:
    keys = bin_columns(n_features)
    model = stored(model, "model")
    roots = model.where("node = 0").select("fold", "tree", F.col("r").alias("p"))
    rows = cells.select("fold", *keys).join(roots, "fold").withColumn("node", F.lit(1))
    for _ in range(max_depth):
        down = rows.join(model.where("node > 0"), ["fold", "tree", "node"], "left")
        right = F.get(F.array(*keys), F.col("feature")) > F.col("bin")
        # A leaf has no further split: its cells stay at a node that no split has.
        rows = down.select("fold", "tree", *keys, F.when(right, F.col("r")).when(~right, F.col("l")).otherwise(F.col("p")).alias("p"),
                           (2 * F.col("node") + F.coalesce(right, F.lit(False)).cast("int")).alias("node"), F.col("feature").isNull().alias("_leaf"))
        rows = rows.withColumn("node", F.when(F.col("_leaf"), F.lit(-1)).otherwise(F.col("node"))).drop("_leaf")
    votes = rows.groupBy("fold", *keys).agg(F.sum("p").alias("votes"))
    return cells.join(votes, ["fold", *keys])


def forest_importances(splits: DataFrame, features: Sequence[str]) -> DataFrame:
    """(fold, feature, importance): each tree's gains as shares of its own sum, averaged over its forest's trees, as shares of one."""
    of = Window.partitionBy("fold", "tree")
    gains = splits.where("node > 0").groupBy("fold", "tree", "feature").agg(F.sum("gain").alias("g"))
    shares = gains.select("fold", "feature", (F.col("g") / F.sum("g").over(of)).alias("s")).groupBy("fold", "feature").agg(F.sum("s").alias("s"))
    shares = shares.select("fold", "feature", (F.col("s") / F.sum("s").over(Window.partitionBy("fold"))).alias("importance"))
    names = F.array(*[F.lit(f) for f in features])
    every = splits.select("fold").distinct().withColumn("feature", F.explode(F.sequence(F.lit(0), F.lit(len(features) - 1))))
    return (every.join(shares, ["fold", "feature"], "left")
            .select("fold", F.get(names, F.col("feature")).alias("feature"), F.coalesce("importance", F.lit(0.0)).alias("importance")))
