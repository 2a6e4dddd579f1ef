"""Boosted trees as DataFrame aggregates: every fold and stage of a model grows in the same jobs.

A ``Problem`` is one model: a label, a loss, the rows that it learns from. All
problems share one table of binned features, and a tree level of all of them is one
job: every task adds its rows' gradients by (problem, node, feature, bin) as arrays,
one ``groupBy`` adds the tasks' sums, then come running sums over the bins, and the
best split of each node. What is shuffled grows with tasks and bins, not with rows
times problems times features. The driver sees a row for each node, never one for
each row or bin.

* Numbers are binned between quantiles of a mergeable sketch, one aggregate for all.
* A category's bins are ordered in each node by their mean gradient, so a split takes
  any set of categories that is best by that order; their names have no part in it.
* Missing values, and categories that training never saw, have a bin of their own,
  and each split learns the side they go to.
* ``rising`` features never lower a prediction: a split that would is no candidate,
  and the middle of its sides bounds all leaves below.
* Quantile problems follow the pinball loss; a leaf's step is the nearest quantile of
  the residuals in it, from a mergeable sketch.

Gradients are summed as integers (in units of 2^-30 of the label's range), so trees
do not depend on how rows are partitioned, nor on lost executors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import clip
from ..operators.lineage import settled

#: Gradients are summed in units of this share of the labels' range.
UNIT = 2.0**-30
#: Relative error of sketched quantiles.
ACCURACY = 10_000


@dataclass(frozen=True)
class Problem:
    """One model: ``rows`` train it, ``held`` (not of them) may choose its number of rounds."""

    name: str
    label: str
    rows: Column
    quantile: float | None = None
    rising: tuple[str, ...] = ()
    held: Column | None = None


@dataclass
class Design:
    """How features become bins: ends between numeric bins, and the categories known."""

    edges: dict[str, list[float]] = field(default_factory=dict)
    known: dict[str, list[str]] = field(default_factory=dict)

    @property
    def features(self) -> list[str]:
        return [*self.edges, *self.known]

    @property
    def sizes(self) -> list[int]:
        """The number of each feature's bins, that of missing values included."""
        return [*(len(e) + 2 for e in self.edges.values()), *(len(c) + 1 for c in self.known.values())]

    def bins(self) -> Column:
        """An array with each feature's bin: 0 for missing, numbers from 1 in their order, categories from 1."""
        numbers = F.array(*[F.col(c).cast("double") for c in self.edges]).cast("array<double>")
        places = [F.array_position(F.array(*map(F.lit, known)).cast("array<string>"), F.col(c).cast("string")) for c, known in self.known.items()]
        codes = F.array(*[F.coalesce(p.cast("int"), F.lit(0)) for p in places]).cast("array<int>")
        ends, width = [np.sort(np.array(e, float)) for e in self.edges.values()], len(self.features)

        def run(numbers: pa.Array, codes: pa.Array) -> pa.Array:
            rows = len(numbers)
            x = numbers.flatten().to_numpy(zero_copy_only=False).reshape(rows, len(ends))
            bins = np.empty((rows, width), np.int32)
            for j, e in enumerate(ends):
                bins[:, j] = np.where(np.isnan(x[:, j]), 0, 1 + np.searchsorted(e, x[:, j]))
            bins[:, len(ends) :] = codes.flatten().to_numpy(zero_copy_only=False).reshape(rows, width - len(ends))
            return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * width), pa.array(bins.ravel()))

        return F.arrow_udf(run, "array<int>")(numbers, codes)


def fit_design(train: DataFrame, numeric: Sequence[str], categories: Sequence[str] = (), bins: int = 32, most: int = 1_000) -> Design:
    """Bin ends at ``bins`` quantiles of each number (its own values where there are few), and the categories of ``train``."""
    design = Design()
    if numeric:
        levels = [k / bins for k in range(1, bins)]
        usable = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
        row = train.agg(*[F.percentile_approx(usable(c), levels, ACCURACY).alias(c) for c in numeric]).first()
        design.edges = {c: sorted(set(row[c] or [])) for c in numeric}
    for c in categories:
        known = sorted(r[0] for r in train.select(F.col(c).cast("string")).where(F.col(c).isNotNull()).distinct().limit(most + 1).collect())
        if len(known) > most:
            raise ValueError(f"{c} has more than {most} values")
        design.known[c] = known
    return design


def _descent(sizes: Sequence[int]) -> tuple[Callable, Callable]:
    """How rows go down a tree: ``ready`` (its nodes) gives their splits and values, ``place`` the nodes of bins (feature, row) at a level, node ``n`` having children ``2 n`` and ``2 n + 1``."""

    def ready(nodes: list[dict]) -> tuple[list[tuple[int, np.ndarray | None]], np.ndarray]:
        splits = []
        for n in nodes:
            right = np.ones(sizes[n["j"]], np.int32) if n["j"] >= 0 else None
            if right is not None:
                right[n["left"]] = 0
            splits.append((n["j"], right))
        return splits, np.array([n["v"] for n in nodes])

    def place(splits: list[tuple[int, np.ndarray | None]], bins: np.ndarray, levels: int) -> np.ndarray:
        at = np.ones(bins.shape[1], np.int32)
        for n in range(1, 2**levels):
            j, right = splits[n - 1]
            if j < 0:
                continue
            if n < 4:  # most rows of a level: taking all is faster than finding them
                side = right.take(bins[j])
                side += 2 * n
                at = side if n == 1 else np.where(at == n, side, at)
            else:
                here = np.flatnonzero(at == n)
                at[here] = 2 * n + right[bins[j, here]]
        return at

    return ready, place


def _predicted(model: Model, every: bool = False) -> Callable[[Column, Column], Column]:
    """A function of bins and an array of problems' numbers: their predictions (null for a null number), or with ``every`` those of the only number after 0, 1, ... rounds.

    Tasks get the trees as arrays and a batch of rows goes down a tree at once.
    """
    (ready, place), depth, width, start = _descent(model.design.sizes), model.depth, len(model.design.features), model.start
    rounds = [[ready(tree) for tree in trees] for trees in model.rounds]

    def run(bins: pa.Array, numbers: pa.Array) -> pa.Array:
        rows = len(bins)
        all_bins = np.ascontiguousarray(bins.flatten().to_numpy(zero_copy_only=False).reshape(rows, width).T)
        flat = numbers.flatten()
        ks = flat.fill_null(-1).to_numpy(zero_copy_only=False).reshape(rows, -1 if rows else 1)
        each = len(rounds) + 1 if every else ks.shape[1]
        out = np.zeros((rows, each))
        for i in range(ks.shape[1]):
            for k in np.unique(ks[ks[:, i] >= 0, i]):
                mine = np.flatnonzero(ks[:, i] == k)
                b, total = all_bins[:, mine], np.full(len(mine), start[k] if every else 0.0)
                for r, trees in enumerate(rounds):
                    if every:
                        out[mine, r] = total
                    splits, values = trees[k]
                    total = total + values.take(place(splits, b, depth) - 1)
                out[mine, -1 if every else i] = total if every else start[k] + total
        offsets = pa.array(np.arange(rows + 1, dtype=np.int32) * each)
        return pa.ListArray.from_arrays(offsets, pa.array(out.ravel(), mask=None if every else (ks < 0).ravel()))

    return F.arrow_udf(run, "array<double>")


@dataclass
class Model:
    design: Design
    problems: list[Problem]
    start: list[float]
    depth: int
    rounds: list[list[list[dict]]] = field(default_factory=list)
    gains: dict[tuple[str, str], float] = field(default_factory=dict)

    def used(self, rounds: dict[str, int]) -> Model:
        """The model with only the first rounds of each problem."""
        still = [{"j": -1, "left": [], "v": 0.0}] * 2 ** (self.depth + 1)
        kept = [[tree if r < rounds.get(p.name, len(self.rounds)) else still for p, tree in zip(self.problems, trees, strict=True)] for r, trees in enumerate(self.rounds)]
        return Model(self.design, self.problems, self.start, self.depth, kept, self.gains)

    def predict(self, df: DataFrame, columns: dict[str, Column | str]) -> DataFrame:
        """``df`` with predictions: for each column the name of its problem, or a column of such names (null: null)."""
        place = F.create_map(*[F.lit(x) for i, p in enumerate(self.problems) for x in (p.name, i)])
        if not columns:
            return df
        numbers = F.array(*[place[F.lit(p) if isinstance(p, str) else p] for p in columns.values()])
        out = df.withColumn("__predicted", _predicted(self)(self.design.bins(), numbers))
        return out.withColumns({name: F.get("__predicted", F.lit(i)) for i, name in enumerate(columns)}).drop("__predicted")

    def importances(self, problem: str, top: int = 20) -> list[tuple[str, float]]:
        """Features with the greatest sums of split gains."""
        own = [(f, g) for (p, f), g in self.gains.items() if p == problem]
        return sorted(own, key=lambda x: (-x[1], x[0]))[:top]


def split_candidates(sums: DataFrame, units: Sequence[float], categorical: Sequence[int], rising: Sequence[tuple[int, int]], bounds: Sequence[tuple[int, int, float, float]] = (), least: int = 30, ridge: float = 5.0) -> DataFrame:
    """Every admissible split of every node and feature.

    ``units`` turn a problem's integer sums into gradients; ``categorical`` are
    features, ``rising`` pairs of problem and feature; ``bounds`` (problem, node,
    least and greatest leaf value). ``least`` is the fewest rows of a side,
    ``ridge`` the weight that pulls leaf values to 0. Columns: ``k, node, j, at``
    (the last bin on the left), ``set`` (bins on the left by a category's order),
    ``absent_left, nl, nr, wl, wr, gain``.
    """
    feature = Window.partitionBy("k", "node", "j")
    is_set = F.col("j").isin(*categorical) if categorical else F.lit(False)
    place = F.when(F.col("bin") == 0, float("-inf")).when(is_set, F.col("g") / F.col("n")).otherwise(F.col("bin").cast("double"))
    upto = feature.orderBy("place", "n", "bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    here, absent = F.col("bin") > 0, F.col("bin") == 0
    known = sums.withColumn("place", place).select(
        "k", "node", "j", "bin",
        F.coalesce(F.sum(F.when(here, F.col("g"))).over(upto), F.lit(0)).alias("gc"),
        F.coalesce(F.sum(F.when(here, F.col("n"))).over(upto), F.lit(0)).alias("nc"),
        F.coalesce(F.sum(F.when(absent, F.col("g"))).over(feature), F.lit(0)).alias("g0"),
        F.coalesce(F.sum(F.when(absent, F.col("n"))).over(feature), F.lit(0)).alias("n0"),
        F.sum("g").over(feature).alias("gt"),
        F.sum("n").over(feature).alias("nt"),
        F.when(is_set, F.collect_list(F.when(here, F.col("bin"))).over(upto)).alias("set"),
    )
    # with no missing values the larger side would take them
    sides = F.when(F.col("n0") > 0, F.array(F.lit(True), F.lit(False))).otherwise(F.array(2 * F.col("nc") >= F.col("nt")))
    split = known.where(here).withColumn("absent_left", F.explode(sides))
    unit = F.get(F.array(*map(F.lit, units)), F.col("k"))
    left = lambda c, c0: F.col(c) + F.when(F.col("absent_left"), F.col(c0)).otherwise(0)
    split = split.withColumns({"nl": left("nc", "n0"), "gl": left("gc", "g0") * unit, "gt": F.col("gt") * unit})
    split = split.withColumns({"nr": F.col("nt") - F.col("nl"), "gr": F.col("gt") - F.col("gl")}).where((F.col("nl") >= least) & (F.col("nr") >= least))
    if bounds:
        given = sums.sparkSession.createDataFrame(list(bounds), "k int, node int, low double, high double")
        split = split.join(F.broadcast(given), ["k", "node"])
    else:
        split = split.withColumns({"low": F.lit(float("-inf")), "high": F.lit(float("inf"))})
    value = lambda g, n: F.greatest(F.col("low"), F.least(F.col("high"), -F.col(g) / (F.col(n) + ridge)))
    split = split.withColumns({"wl": value("gl", "nl"), "wr": value("gr", "nr"), "wt": value("gt", "nt")})
    lost = lambda g, n, w: 2 * F.col(g) * F.col(w) + (F.col(n) + ridge) * F.col(w) * F.col(w)
    gain = lost("gt", "nt", "wt") - lost("gl", "nl", "wl") - lost("gr", "nr", "wr")
    split = split.withColumn("gain", gain).where(F.col("gain") > 0)
    if rising:
        limited = F.struct("k", "j").isin(*[F.struct(F.lit(k), F.lit(j)) for k, j in rising])
        split = split.where(~limited | (F.col("wl") <= F.col("wr")))
    return split.select("k", "node", "j", F.col("bin").alias("at"), "set", "absent_left", "nl", "nr", "wl", "wr", "gain")


def best_splits(candidates: DataFrame, by: Sequence[str] = ("k", "node")) -> DataFrame:
    """The split with the greatest gain; of equal ones the first feature, the larger left side, missing values on the left."""
    order = F.struct("gain", (-F.col("j")).alias("first"), "nl", "absent_left", (-F.col("at")).alias("lowest"))
    return candidates.groupBy(*by).agg(F.max_by(F.struct(*[c for c in candidates.columns if c not in by]), order).alias("s")).select(*by, "s.*")


def _passes(model: Model, labels: Sequence[int], done: int, own: list[list[dict]] | None = None, levels: int = 0, only: set[int] | None = None) -> Callable[[pa.RecordBatch], Iterator[tuple]]:
    """A function that gives, problem by problem, ``k``, the rows' numbers, their bins (feature, row), what the rounds from ``done`` on add, gaps (prediction less label) and nodes in the tree of ``own``, of a batch ``bins, y, uses`` and, unless they are still the model's start, ``scores``.

    Problems that learn from the same rows share one copy of their bins. Tasks get it whole: it needs nothing of this package.
    """
    sizes, depth = model.design.sizes, model.depth
    ready, place = _descent(sizes)
    start, small = model.start, np.min_scalar_type(max(sizes, default=0))
    earlier = [[ready(tree) for tree in trees] for trees in model.rounds[done:]]
    growing = [ready(tree)[0] for tree in own or ()]

    def each(batch: pa.RecordBatch) -> Iterator[tuple]:
        flat = lambda c: batch.column(c).flatten().to_numpy(zero_copy_only=False)
        rows = batch.num_rows
        bins = np.ascontiguousarray(flat("bins").reshape(rows, len(sizes)).T.astype(small))
        y, uses = flat("y").reshape(rows, -1), flat("uses").astype(np.min_scalar_type(len(labels)))
        scores = flat("scores").reshape(rows, -1) if "scores" in batch.schema.names else None
        row = np.repeat(np.arange(rows), np.diff(batch.column("uses").offsets.to_numpy()))
        order = np.argsort(uses, kind="stable")
        ends = np.searchsorted(uses[order], np.arange(len(labels) + 1))
        shared = {}
        for k, label in enumerate(labels):
            mine = row[order[ends[k] : ends[k + 1]]]
            if not len(mine) or only is not None and k not in only:
                continue
            alike = shared.setdefault((len(mine), mine[0], mine[-1]), [])
            b = next((b for rows, b in alike if np.array_equal(rows, mine)), None)
            if b is None:
                b = bins[:, mine]
                alike.append((mine, b))
            total = np.zeros(len(mine))
            for trees in earlier:
                splits, values = trees[k]
                total += values.take(place(splits, b, depth) - 1)
            gap = (start[k] if scores is None else scores[mine, k]) + total - y[mine, label]
            if not np.isfinite(gap).all():
                raise ValueError("labels must be finite")
            yield k, mine, b, total, gap, place(growing[k], b, levels) if growing else np.ones(len(mine), np.int64)

    return each


@dataclass
class _Run:
    """What the rounds of one run share: the table of binned rows, the model so far, and how gradients are formed."""

    state: DataFrame
    model: Model
    units: list[float]
    quantiles: list[float]
    rising: list[tuple[int, int]]
    labels: list[int]

    @property
    def categorical(self) -> range:
        return range(len(self.model.design.edges), len(self.model.design.features))

    def rows(self, done: int) -> DataFrame:
        """The table as passes read it: scores are left out while they are the same in every row."""
        return self.state if done else self.state.drop("scores")

    def sums(self, done: int, own: list[list[dict]] | None = None, level: int = 0) -> DataFrame:
        """``k, node, j, bin, g`` (integer gradients) ``, n`` of the nodes of a level; a task sends a row for each bin that it met."""
        each, sizes, units = _passes(self.model, self.labels, done, own, level), self.model.design.sizes, self.units
        alphas = [p.quantile for p in self.model.problems]
        starts = np.r_[0, np.cumsum(sizes)].astype(np.int64)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            first, width, found = 2**level, int(starts[-1]), {}
            for batch in batches:
                for k, _, bins, _, gap, node in each(batch):
                    x = gap if alphas[k] is None else np.where(gap < 0, -alphas[k], 1 - alphas[k])
                    x = x / units[k]
                    whole = np.trunc(x)
                    q = whole + np.sign(x) * (np.abs(x - whole) >= 0.5)
                    if (node < first).any():
                        kept = node >= first
                        bins, q, node = bins[:, kept], q[kept], node[kept]
                    if k not in found:
                        found[k] = np.zeros((first, width), np.int64), np.zeros((first, width), np.int64)
                    for j, size in enumerate(sizes):
                        place, own = (node - first) * size + bins[j], slice(starts[j], starts[j + 1])
                        # a batch's sums of integers stay below 2^53, so they are exact
                        found[k][0][:, own] += np.bincount(place, q, first * size).astype(np.int64).reshape(first, size)
                        found[k][1][:, own] += np.bincount(place, minlength=first * size).reshape(first, size)
            for k, (g, n) in found.items():
                g, n = g.ravel(), n.ravel()
                at = np.flatnonzero(n)
                node, place = first + at // max(width, 1), at % max(width, 1)
                j = np.searchsorted(starts, place, side="right") - 1
                whole = lambda v: pa.array(v.astype(np.int32))
                yield pa.RecordBatch.from_arrays([whole(np.full(len(at), k)), whole(node), whole(j), whole(place - starts[j]), pa.array(g[at]), pa.array(n[at])], ["k", "node", "j", "bin", "g", "n"])

        parts = self.rows(done).mapInArrow(run, "k int, node int, j int, bin int, g bigint, n bigint")
        return parts.groupBy("k", "node", "j", "bin").agg(F.sum("g").alias("g"), F.sum("n").alias("n"))

    def residuals(self, done: int, own: list[list[dict]]) -> DataFrame:
        """``k, node`` (the leaf in ``own``) ``, residual`` of quantile problems' rows."""
        of = {k for k, p in enumerate(self.model.problems) if p.quantile is not None}
        each = _passes(self.model, self.labels, done, own, self.model.depth, of)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k, _, _, _, gap, node in each(batch):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(gap), k, np.int32)), pa.array(node.astype(np.int32)), pa.array(-gap)], ["k", "node", "residual"])

        return self.rows(done).mapInArrow(run, "k int, node int, residual double")

    def scored(self, done: int) -> DataFrame:
        """The table with the rounds from ``done`` on in the stored scores."""
        each = _passes(self.model, self.labels, done)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                scores = batch.column("scores")
                new = scores.flatten().to_numpy().reshape(batch.num_rows, -1).copy()
                for k, rows, _, total, _, _ in each(batch):
                    new[rows, k] += total
                offsets = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * new.shape[1])
                yield batch.set_column(batch.schema.get_field_index("scores"), "scores", pa.ListArray.from_arrays(offsets, pa.array(new.ravel())))

        return self.state.mapInArrow(run, self.state.schema)


def _begin(df: DataFrame, design: Design, problems: Sequence[Problem], depth: int) -> _Run:
    """Bins, labels and uses of the training rows, settled; each problem starts at its mean or quantile."""
    problems = list(problems)
    labels = list(dict.fromkeys(p.label for p in problems))
    places = [labels.index(p.label) for p in problems]
    label = F.get(F.array(*map(F.lit, places)), F.col("k"))
    uses = F.array(*[F.when(p.rows & F.col(p.label).isNotNull(), F.lit(k)) for k, p in enumerate(problems)])
    state = df.select(design.bins().alias("bins"), F.array(*[F.col(c).cast("double") for c in labels]).alias("y"), F.array_compact(uses).alias("uses"))
    # few bytes a row but much work: an even share of rows for every core
    state = settled(state.where(F.size("uses") > 0).repartition(df.sparkSession.sparkContext.defaultParallelism))
    quantiles = sorted({p.quantile for p in problems if p.quantile is not None})
    shape = [F.avg("y").alias("mean"), (F.max("y") - F.min("y")).alias("range"), *([F.percentile_approx("y", quantiles, ACCURACY).alias("q")] if quantiles else [])]
    long = state.select(F.explode("uses").alias("k"), "y").select("k", F.get("y", label).alias("y"))
    found = {r["k"]: r for r in long.groupBy("k").agg(*shape).collect()}  # a row a problem

    def start(k: int, p: Problem) -> float:
        return 0.0 if k not in found else float(found[k]["mean"] if p.quantile is None else found[k]["q"][quantiles.index(p.quantile)])

    def unit(k: int, p: Problem) -> float:
        """Pinball gradients are 1 at most, others the labels' range."""
        return UNIT * (1.0 if p.quantile is not None else float(found[k]["range"] if k in found else 0.0) or 1.0)

    model = Model(design, problems, [start(k, p) for k, p in enumerate(problems)], depth)
    rising = [(k, design.features.index(f)) for k, p in enumerate(problems) for f in p.rising if f in design.features]
    return _Run(state.withColumn("scores", F.array(*map(F.lit, model.start))), model, [unit(k, p) for k, p in enumerate(problems)], quantiles, rising, places)


def root_splits(df: DataFrame, design: Design, problems: Sequence[Problem], least: int = 30, ridge: float = 5.0) -> DataFrame:
    """``k, node, j`` and the best split of every feature at the root of every problem's first tree."""
    run = _begin(df, design, problems, 1)
    return best_splits(split_candidates(run.sums(0), run.units, run.categorical, run.rising, (), least, ridge), ["k", "node", "j"])


def boosted(
    df: DataFrame,
    design: Design,
    problems: Sequence[Problem],
    rounds: int = 50,
    depth: int = 3,
    rate: float = 0.1,
    least: int = 30,
    ridge: float = 5.0,
    settle: int = 10,
) -> Model:
    """A model of all ``problems``, ``rounds`` trees each. Rows with a null label don't train; every ``settle`` rounds the predictions so far are stored."""
    run, done = _begin(df, design, problems, depth), 0
    model = run.model
    for r in range(rounds):
        grown = _grow(run, done, least, ridge, rate)
        if run.quantiles:
            _nearest_steps(run, done, grown, rate)
        model.rounds.append([t["nodes"] for t in grown])
        if r + 1 < rounds and len(model.rounds) - done >= settle:
            run.state, done = settled(run.scored(done)), len(model.rounds)
    return model


def _grow(run: _Run, done: int, least: int, ridge: float, rate: float) -> list[dict]:
    """One tree a problem: nodes with their splits and steps, and the bounds of their steps."""
    model, depth = run.model, run.model.depth
    trees = [{"nodes": [{"j": -1, "left": [], "v": 0.0} for _ in range(2 ** (depth + 1))], "bounds": {1: (float("-inf"), float("inf"))}} for _ in model.problems]
    numbers = len(model.design.edges)
    for level in range(depth):
        open_ = [(k, n, *t["bounds"][n]) for k, t in enumerate(trees) for n in t["bounds"] if n >= 2**level]
        if not open_:
            break
        sums = run.sums(done, [t["nodes"][1:] for t in trees], level)
        found = best_splits(split_candidates(sums, run.units, run.categorical, run.rising, open_, least, ridge))
        for s in found.collect():  # a row a node
            tree, node = trees[s["k"]], s["node"]
            left = (s["set"] if s["j"] >= numbers else list(range(1, s["at"] + 1))) + ([0] if s["absent_left"] else [])
            tree["nodes"][node] |= {"j": s["j"], "left": left}
            low, high = tree["bounds"][node]
            middle = (s["wl"] + s["wr"]) / 2 if (s["k"], s["j"]) in run.rising else None
            for child, w in ((2 * node, s["wl"]), (2 * node + 1, s["wr"])):
                tree["nodes"][child]["v"] = rate * w
                tree["bounds"][child] = (low, high) if middle is None else ((low, min(high, middle)) if child == 2 * node else (max(low, middle), high))
            key = model.problems[s["k"]].name, model.design.features[s["j"]]
            model.gains[key] = model.gains.get(key, 0.0) + s["gain"]
    for t in trees:
        t["nodes"] = t["nodes"][1:]  # node 1 is the first element
    return trees


def _nearest_steps(run: _Run, done: int, grown: list[dict], rate: float) -> None:
    """Give the leaves of quantile problems the nearest quantile of their residuals, within the leaves' bounds."""
    problems, quantiles = run.model.problems, run.quantiles
    placed = run.residuals(done, [t["nodes"] for t in grown])
    for r in placed.groupBy("k", "node").agg(F.percentile_approx("residual", list(quantiles), ACCURACY).alias("q")).collect():  # a row a leaf
        tree = grown[r["k"]]
        low, high = tree["bounds"][r["node"]]
        if r["node"] > 1:
            tree["nodes"][r["node"] - 1]["v"] = rate * min(high, max(low, r["q"][quantiles.index(problems[r["k"]].quantile)]))


def tuned_rounds(model: Model, df: DataFrame, default: int, least_train: int = 200, least_held: int = 50) -> dict[str, int]:
    """The number of rounds of each problem whose error on its ``held`` rows is least, all rounds in one pass; ``default`` where too few rows tell."""
    out = {p.name: default for p in model.problems}
    counts = df.agg(*[F.count(F.when(p.rows & F.col(p.label).isNotNull(), 1)).alias(f"t{k}") for k, p in enumerate(model.problems)], *[F.count(F.when(p.held & F.col(p.label).isNotNull(), 1)).alias(f"h{k}") for k, p in enumerate(model.problems) if p.held is not None]).first()
    able = [k for k, p in enumerate(model.problems) if p.held is not None and counts[f"t{k}"] >= least_train and counts[f"h{k}"] >= least_held]
    if not able or not model.rounds:
        return out
    uses = F.array_compact(F.array(*[F.when(model.problems[k].held & F.col(model.problems[k].label).isNotNull(), F.struct(F.lit(k).alias("k"), F.col(model.problems[k].label).cast("double").alias("y"))) for k in able]))
    rows = df.select(model.design.bins().alias("bins"), F.explode(uses).alias("u")).select("bins", "u.*")
    scores = _predicted(model, every=True)(F.col("bins"), F.array("k"))
    alpha = F.get(F.array(*[F.lit(p.quantile).cast("double") for p in model.problems]), F.col("k"))
    over = lambda s: s - F.col("y")
    loss = F.transform(scores, lambda s: F.when(alpha.isNull(), over(s) * over(s)).when(over(s) < 0, -alpha * over(s)).otherwise((1 - alpha) * over(s)))
    errors = rows.select("k", F.posexplode(loss).alias("rounds", "loss")).groupBy("k", "rounds").agg(F.avg("loss").alias("loss"))
    for r in errors.groupBy("k").agg(F.min_by("rounds", F.struct(F.round("loss", 9), "rounds")).alias("best")).collect():
        out[model.problems[r["k"]].name] = max(1, r["best"])
    return out
