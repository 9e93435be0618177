"""Second-order gradient boosting on binned features, many models in one pass.

``binned`` turns every feature into a byte once (quantile cuts, MISSING for no value) and writes the rows to the shared
folder.  All models of one table (targets, horizons, folds) then grow in step: a tree level is one scan, which adds up
gradients and Hessians by (model, node, feature, bin) in each task before the shuffle; behind the shuffle each part finds
its best split.  A node's split gains

    1/2 * (GL^2 / (HL + l2) + GR^2 / (HR + l2) - G^2 / (H + l2))

and a leaf's weight is -rate * G / (H + l2).  Rows are drawn per tree by a hash of the row, columns by the tree's number, so neither depends on
partitions, and a lost executor's part is made again alike.  Margins are written every KEEP trees; in between
tasks add the newest trees.  Only splits (one per node and model) and cuts reach the driver.
"""

from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor
from copy import copy
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ohmwatch.config import KEY, TIME
from ohmwatch.session import run_dir

BINS = 64
MISSING = 255
#: Trees between two written tables of margins; bytes of sums that a task may hold; features of one part behind the shuffle.
KEEP, HELD, PART = 10, 64 << 20, 128
#: Rows of a table that are worth a task; groups of models that grow side by side.
TASK_ROWS, PARALLEL = 1 << 16, 8
#: Rows of a task of a large table, whose tasks each hand on sums of all nodes; rows whose sums are taken at once.
WIDE_TASK_ROWS, AT_ONCE = 1 << 18, 1 << 16
ROW, CODES, MARGINS = "__row", "__codes", "__margins"


@dataclass(frozen=True)
class Spec:
    """One model: its label column, inputs, size, and the rows it learns from (fold below ``below`` if given)."""

    name: str
    label: str
    inputs: tuple[str, ...]
    objective: str = "squared"
    trees: int = 100
    depth: int = 6
    rate: float = 0.05
    row_share: float = 1.0
    column_share: float = 1.0
    l2: float = 1.0
    least_weight: float = 1.0
    seed: int = 42
    fold: str | None = None
    below: int | None = None


@dataclass
class Ensemble:
    """Trees in the order of their growth; node i has the children 2i + 1 and 2i + 2."""

    inputs: list[str]
    objective: str
    base: float
    cuts: dict[str, list[float]]
    trees: list[dict[str, np.ndarray]] = field(default_factory=list)

    def margins(self, codes: np.ndarray, first: int = 0) -> np.ndarray:
        """What the trees from ``first`` on add up to; one column of codes per input."""
        out = np.zeros(len(codes))
        row = np.arange(len(codes))
        for tree in self.trees[first:]:
            out += tree["value"][walk(tree, codes, row)]
        return out

    def predict(self, codes: np.ndarray) -> np.ndarray:
        margin = self.base + self.margins(codes)
        return 1 / (1 + np.exp(-margin)) if self.objective == "logistic" else margin

    def codes(self, columns: list[np.ndarray]) -> np.ndarray:
        return np.stack([encode(x, np.array(self.cuts[c])) for c, x in zip(self.inputs, columns)], axis=1)

    def transform(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        """``df`` with the prediction (for a logistic model the probability) of every row."""
        at = [df.columns.index(c) for c in self.inputs]
        schema = T.StructType([*df.schema.fields, T.StructField(name, T.DoubleType())])

        def run(batches):
            for batch in batches:
                columns = [np.asarray(batch.column(i).to_numpy(zero_copy_only=False), float) for i in at]
                made = self.predict(self.codes(columns)) if batch.num_rows else np.zeros(0)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made)], names=[*batch.schema.names, name])

        return df.mapInArrow(run, schema)

    def save(self, spark: SparkSession, path: str) -> None:
        """One row of settings and one per node."""
        head = json.dumps({"inputs": self.inputs, "objective": self.objective, "base": self.base, "cuts": self.cuts})
        rows = [
            (t, i, int(tree["feature"][i]), int(tree["bin"][i]), float(tree["value"][i]))
            for t, tree in enumerate(self.trees)
            for i in range(len(tree["feature"]))
        ]
        spark.createDataFrame([(head,)], "head string").coalesce(1).write.mode("overwrite").parquet(f"{path}/head")
        kind = "tree int, node int, feature int, bin int, value double"
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("overwrite").parquet(f"{path}/trees")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Ensemble:
        made = cls(**json.loads(spark.read.parquet(f"{path}/head").first().head))
        nodes = spark.read.parquet(f"{path}/trees").orderBy("tree", "node").toArrow()
        columns = {c: nodes[c].to_numpy() for c in nodes.column_names}
        starts = np.flatnonzero(columns["node"] == 0)
        for at, end in zip(starts, [*starts[1:], len(columns["node"])]):
            made.trees.append({c: columns[c][at:end] for c in ("feature", "bin", "value")})
        return made


def encode(values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Codes of values: how many cuts lie below; MISSING for NaN."""
    return np.where(np.isnan(values), MISSING, np.searchsorted(cuts, values, "left")).astype(np.uint8)


def walk(tree: dict[str, np.ndarray], codes: np.ndarray, row: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
    """The leaf (or unsplit node) of each row; ``at``: the columns of ``codes`` that are the tree's inputs, if not all."""
    node = np.zeros(len(row), np.int64)
    while True:
        feature = tree["feature"][node]
        inner = np.flatnonzero(feature >= 0)
        if not len(inner):
            return node
        column = feature[inner] if at is None else at[feature[inner]]
        right = codes[row[inner], column] > tree["bin"][node[inner]]
        node[inner] = 2 * node[inner] + 1 + right


def quantile_cuts(df: DataFrame, inputs: list[str], bins: int = BINS) -> dict[str, list[float]]:
    """Up to bins - 1 cuts per feature, from a sketch of its quantiles (bins numbers per feature)."""
    shares = [i / bins for i in range(1, bins)]
    found = df.approxQuantile(inputs, shares, 1 / (8 * bins))
    return {c: sorted(set(x)) for c, x in zip(inputs, found)}


def binned(df: DataFrame, inputs: list[str], keep: list[str], cuts: dict[str, list[float]]) -> DataFrame:
    """(ROW, CODES, ``keep`` as doubles) written to the shared folder; ROW is a hash of the keys."""
    edges = [np.array(cuts[c]) for c in inputs]
    row = F.xxhash64(*[c for c in (KEY, TIME) if c in df.columns]).alias(ROW)
    tasks = max(1, -(-df.count() // TASK_ROWS))
    chosen = df.select(row, *[F.col(c).cast("double").alias(c) for c in [*keep, *inputs]])
    kind = pa.schema([(ROW, pa.int64()), (CODES, pa.binary()), *[(c, pa.float64()) for c in keep]])

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                own = [np.asarray(batch.column(1 + len(keep) + i).to_numpy(zero_copy_only=False), float) for i in range(len(inputs))]
                codes = np.stack([encode(x, e) for x, e in zip(own, edges)], axis=1)
                raw = pa.array([r.tobytes() for r in codes], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0), raw, *batch.columns[1 : 1 + len(keep)]], schema=kind)

    ddl = f"{ROW} long, {CODES} binary, " + ", ".join(f"`{c}` double" for c in keep)
    # Every task hands on sums for all nodes, so few rows should not be spread over many tasks.
    return _written(chosen.mapInArrow(run, ddl).coalesce(tasks), "binned")


def _written(df: DataFrame, label: str) -> DataFrame:
    path = run_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _drawn(row: np.ndarray, share: float, seed: int, tree: int) -> np.ndarray:
    """Which rows a tree sees: a hash of the row's key and the tree."""
    if share >= 1:
        return np.ones(len(row), bool)
    h = row.view(np.uint64) ^ np.uint64((seed * 0x9E3779B97F4A7C15 + tree * 0xD1B54A32D192ED03) % (1 << 64))
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (h ^ (h >> np.uint64(31))) < np.uint64(int(share * ((1 << 64) - 1)))


def _columns(spec: Spec, tree: int) -> np.ndarray:
    """Inputs that a tree may use."""
    n = len(spec.inputs)
    if spec.column_share >= 1:
        return np.arange(n)
    most = max(1, round(n * spec.column_share))
    return np.sort(np.random.default_rng([spec.seed, tree]).permutation(n)[:most])


def _matrix(column: pa.Array, kind: str, n: int) -> np.ndarray:
    """The values of a column of equally long byte strings, a row for each."""
    raw = column.cast(pa.binary()) if column.type != pa.binary() else column
    starts = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + n + 1]
    return np.frombuffer(raw.buffers()[2], np.uint8)[starts[0] : starts[-1]].view(kind).reshape(n, -1)


class _Rows:
    """Arrays of a batch, and what of it concerns one model."""

    def __init__(self, batch: pa.RecordBatch, width: int):
        names = batch.schema.names
        self.n = batch.num_rows
        self.row = batch.column(0).to_numpy()
        self.codes = _matrix(batch.column(1), "u1", self.n).reshape(self.n, width)
        self.by_column = np.ascontiguousarray(self.codes.T)
        self.columns = {c: batch.column(i) for i, c in enumerate(names)}
        self.complete: dict[bytes, np.ndarray] = {}

    def values(self, name: str) -> np.ndarray:
        return np.asarray(self.columns[name].to_numpy(zero_copy_only=False), float)

    def margins(self, count: int) -> np.ndarray:
        if MARGINS not in self.columns:
            return np.zeros((self.n, count))
        return _matrix(self.columns[MARGINS], "<f8", self.n).reshape(self.n, count)

    def whole(self, at: np.ndarray) -> np.ndarray:
        """Rows whose inputs are all there; found once for all models with these inputs."""
        key = at.tobytes()
        if key not in self.complete:
            some = np.ones(self.n, bool)
            for c in at.tolist():
                some &= self.by_column[c] != MISSING
            self.complete[key] = some
        return self.complete[key]


def _known(rows: _Rows, spec: Spec, at: np.ndarray) -> np.ndarray:
    """Rows whose label and inputs are all there."""
    return ~np.isnan(rows.values(spec.label)) & rows.whole(at)


def _learns(rows: _Rows, spec: Spec, at: np.ndarray) -> np.ndarray:
    some = _known(rows, spec, at)
    return some & (rows.values(spec.fold) < spec.below) if spec.below is not None else some


def _families(specs: list[Spec], at: list[np.ndarray], own: list[int]) -> list[tuple[str | None, list[int]]]:
    """(fold column, models): models that differ in the rows they learn from only, as the folds of a label and its final model."""
    found: dict[tuple, list[int]] = {}
    for i in own:
        s = specs[i]
        found.setdefault((s.label, at[i].tobytes(), s.row_share, s.column_share, s.seed), []).append(i)
    out = []
    for models in found.values():
        folds = [*dict.fromkeys(specs[i].fold for i in models if specs[i].below is not None)] or [None]
        for n, fold in enumerate(folds):
            out.append((fold, [i for i in models if (specs[i].fold == fold if specs[i].below is not None else n == 0)]))
    return out


def _batches(batches, width: int):
    """Rows of many batches at once: a sum over few rows costs mostly its call."""
    held, n = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n >= AT_ONCE:
            yield _Rows(_joined(held), width)
            held, n = [], 0
    if held:
        yield _Rows(_joined(held), width)


def _joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return batches[0] if len(batches) == 1 else pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


class Booster:
    """Grows the models of ``specs`` on one binned table."""

    def __init__(self, table: DataFrame, features: list[str], cuts: dict[str, list[float]], specs: list[Spec], bins: int = BINS):
        self.spark, self.features, self.specs, self.bins = table.sparkSession, features, specs, bins
        # The sums of one task are complete: it finds the splits itself, and a level needs no shuffle.
        rows = table.count()
        self.single = rows <= TASK_ROWS
        # Every task hands on sums for all nodes of all models: no more tasks than keep the executors busy, or than rows ask for.
        enough = min(-(-rows // TASK_ROWS), 2 * self.spark.sparkContext.defaultParallelism)
        self.tasks = 1 if self.single else max(enough, -(-rows // WIDE_TASK_ROWS))
        self.table = table.coalesce(self.tasks)
        place = {c: i for i, c in enumerate(features)}
        self.at = [np.array([place[c] for c in s.inputs]) for s in specs]
        self.models = [Ensemble(list(s.inputs), s.objective, 0.0, {c: cuts[c] for c in s.inputs}) for s in specs]
        self.stored = 0  # trees whose margins are written
        for model, base in zip(self.models, self._bases()):
            model.base = base

    def _run(self, fn, ddl: str) -> DataFrame:
        """``fn(rows)`` over the batches of the table; it returns record batches, and once more with None at the end."""
        width = len(self.features)

        def run(batches):
            work = fn()
            for rows in _batches(batches, width):
                yield from work(rows)
            yield from work(None)

        return self.table.mapInArrow(run, ddl)

    def _bases(self) -> list[float]:
        """Mean label of the squared models' rows, zero for the others."""
        specs, at = self.specs, self.at
        kind = pa.schema([("spec", pa.int64()), ("total", pa.float64()), ("n", pa.int64())])

        def start():
            sums = np.zeros((len(specs), 2))

            def work(rows):
                if rows is not None:
                    for i, s in enumerate(specs):
                        y = rows.values(s.label)[_learns(rows, s, at[i])]
                        sums[i] += (y.sum(), len(y))
                    return
                columns = [pa.array(range(len(specs))), pa.array(sums[:, 0]), pa.array(sums[:, 1].astype(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, schema=kind)

            return work

        found = self._run(start, "spec long, total double, n long").groupBy("spec").agg(F.sum("total").alias("t"), F.sum("n").alias("n"))
        found = found.collect()
        means = {r.spec: r.t / r.n if r.n else 0.0 for r in found}
        self.rows = {r.spec: r.n for r in found}
        return [means.get(i, 0.0) if s.objective == "squared" else 0.0 for i, s in enumerate(self.specs)]

    def grow(self, parallel: int = PARALLEL) -> list[Ensemble]:
        """Groups of models whose sums fit into a task grow side by side, each through its own trees."""
        own = [i for i in range(len(self.specs)) if self.rows.get(i)]
        most = max((len(s.inputs) * self.bins * 16 * 2 ** (s.depth - 1) for s in self.specs), default=1)
        # A table of many tasks fills the cores by itself: as few scans as the sums allow.
        size = max(1, min(HELD // most, -(-len(own) // (parallel if self.single else 1))))
        size = -(-len(own) // -(-len(own) // size)) if own else 1
        groups = [own[lo : lo + size] for lo in range(0, len(own), size)]
        with ThreadPoolExecutor(parallel) as pool:
            list(pool.map(lambda group: self._only(group)._grow(), groups))
        return self.models

    def _only(self, own: list[int]) -> Booster:
        """The same table with some of the models, which stay shared."""
        part = copy(self)
        part.specs, part.at, part.models = ([x[i] for i in own] for x in (self.specs, self.at, self.models))
        return part

    def _grow(self) -> None:
        for t in range(max(s.trees for s in self.specs)):
            if t - self.stored >= KEEP:
                self._keep(t)
            own = [i for i, s in enumerate(self.specs) if t < s.trees]
            for i in own:
                nodes = 2 ** (self.specs[i].depth + 1) - 1
                self.models[i].trees.append({"feature": np.full(nodes, -1), "bin": np.zeros(nodes, np.int64), "value": np.zeros(nodes)})
            for level in range(max(self.specs[i].depth for i in own)):
                growing = [i for i in own if level < self.specs[i].depth]
                if not self._level(growing, t, level):
                    break

    def _keep(self, upto: int) -> None:
        """Write the table again with the margins of the first ``upto`` trees."""
        models, at, first, count = self.models, self.at, self.stored, len(self.specs)
        names = [ROW, CODES, *[c for c in self.table.columns if c not in (ROW, CODES, MARGINS)]]
        types = {f.name: f.dataType.simpleString() for f in self.table.schema.fields}

        def start():
            def work(rows):
                if rows is None:
                    return
                more = np.stack([m.margins(rows.codes[:, at[i]], first) for i, m in enumerate(models)], axis=1)
                raw = pa.array([r.tobytes() for r in rows.margins(count) + more], pa.binary())
                yield pa.RecordBatch.from_arrays([*[rows.columns[c] for c in names], raw], names=[*names, MARGINS])

            return work

        ddl = ", ".join(f"`{c}` {types[c]}" for c in names) + f", {MARGINS} binary"
        table = _written(self._run(start, ddl), "margins")
        self.table, self.stored = table.coalesce(self.tasks), upto

    def _level(self, own: list[int], tree: int, level: int) -> bool:
        """Split the nodes of one level of one tree of each model; false when no node was split."""
        specs, models, at, first, bins, count = self.specs, self.models, self.at, self.stored, self.bins, len(self.specs)
        drawn = {i: _columns(specs[i], tree) for i in own}
        base, nodes = 2**level - 1, 2**level
        kind = pa.schema([("spec", pa.int64()), ("node", pa.int64()), ("part", pa.int64()), ("sums", pa.binary())])
        single = self.single

        families = _families(specs, at, own)

        def add_family(rows, margins, fold, group, held):
            """Sums of the models of a family, whose codes are taken out once.  Rows keep their order, so that sums round alike."""
            s = specs[group[0]]
            some = np.flatnonzero(_known(rows, s, at[group[0]]) & _drawn(rows.row, s.row_share, s.seed, tree))
            folds = None if fold is None else rows.values(fold)[some]
            y = rows.values(s.label)[some]
            places = []
            for i in group:
                s, m = specs[i], models[i]
                seen = np.arange(len(some)) if s.below is None else np.flatnonzero(folds < s.below)
                leaf = walk(m.trees[-1], rows.codes, some[seen], at[i]) - base
                inner = (leaf >= 0) & (leaf < nodes)
                seen, leaf = seen[inner], leaf[inner]
                if not len(seen):
                    continue
                past = np.zeros(len(seen))
                for done in m.trees[first:-1]:
                    past += done["value"][walk(done, rows.codes, some[seen], at[i])]
                margin = m.base + margins[some[seen], i] + past
                if s.objective == "logistic":
                    p = 1 / (1 + np.exp(-margin))
                    g, h = p - y[seen], p * (1 - p)
                else:
                    g, h = margin - y[seen], None
                places.append((seen, leaf * bins, g, h, held.setdefault(i, np.zeros((2, nodes, len(drawn[i]), bins)))))
            for k, c in enumerate(at[group[0]][drawn[group[0]]].tolist() if places else ()):
                codes = rows.by_column[c][some].astype(np.int64)
                for seen, leaf, g, h, sums in places:
                    place = codes[seen]
                    place += leaf
                    sums[0, :, k] += np.bincount(place, g, nodes * bins).reshape(nodes, bins)
                    sums[1, :, k] += np.bincount(place, h, nodes * bins).reshape(nodes, bins)

        def start():
            held: dict[int, np.ndarray] = {}

            def work(rows):
                if rows is None:
                    for i, sums in held.items():
                        if single:
                            nodes_ = np.flatnonzero(sums[1].any(axis=(1, 2))).tolist()
                            rows_ = [best_split(specs[i], i, node, 0, sums[:, node]) for node in nodes_]
                            yield pa.RecordBatch.from_pylist([dict(zip(_SPLITS.names, r)) for r in rows_], schema=_SPLITS)
                            continue
                        for node in np.flatnonzero(sums[1].any(axis=(1, 2))).tolist():
                            for lo in range(0, len(drawn[i]), PART):
                                raw = np.ascontiguousarray(sums[:, node, lo : lo + PART]).tobytes()
                                yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (i, node, lo)] + [pa.array([raw], pa.binary())], schema=kind)
                    return
                margins = rows.margins(count)
                for fold, group in families:
                    add_family(rows, margins, fold, group, held)

            return work

        if single:
            best = self._run(start, _SPLITS_DDL)
        else:
            found = self._run(start, "spec long, node long, part long, sums binary")
            best = found.groupBy("spec", "node", "part").applyInArrow(_group_split({i: specs[i] for i in own}, bins), _SPLITS_DDL)
        chosen: dict[tuple[int, int], dict] = {}
        for r in best.toArrow().to_pylist():
            key = (r["spec"], r["node"])
            if key not in chosen or (-r["gain"], r["feature"]) < (-chosen[key]["gain"], chosen[key]["feature"]):
                chosen[key] = r
        split = False
        for (i, node), r in chosen.items():
            s, made, place = specs[i], models[i].trees[-1], base + node
            if level == 0:
                made["value"][place] = -s.rate * r["g"] / (r["h"] + s.l2)
            if r["gain"] <= 0:
                continue
            split = True
            made["feature"][place], made["bin"][place] = drawn[i][r["feature"]], r["bin"]
            for child, g, h in ((1, r["gl"], r["hl"]), (2, r["g"] - r["gl"], r["h"] - r["hl"])):
                made["value"][2 * place + child] = -s.rate * g / (h + s.l2)
        return split

    def predictions(self, chosen: dict[str, tuple[str, int]] | None = None) -> DataFrame:
        """(model, y_true, prediction): for each model the rows with (fold column, number) of ``chosen``, or all its complete rows."""
        specs, models, at = self.specs, self.models, self.at
        kind = pa.schema([("model", pa.string()), ("y_true", pa.float64()), ("prediction", pa.float64())])

        def start():
            def work(rows):
                if rows is None:
                    return
                for i, (s, m) in enumerate(zip(specs, models)):
                    if chosen is not None and s.name not in chosen:
                        continue
                    some = _known(rows, s, at[i])
                    if chosen is not None:
                        some &= rows.values(chosen[s.name][0]) == chosen[s.name][1]
                    made = m.predict(rows.codes[np.ix_(some, at[i])])
                    yield pa.RecordBatch.from_arrays([pa.array([s.name] * len(made), pa.string()), pa.array(rows.values(s.label)[some]), pa.array(made)], schema=kind)

            return work

        return self._run(start, "model string, y_true double, prediction double")


_SPLITS = pa.schema(
    [("spec", pa.int64()), ("node", pa.int64()), ("gain", pa.float64()), ("feature", pa.int64()), ("bin", pa.int64()),
     ("gl", pa.float64()), ("hl", pa.float64()), ("g", pa.float64()), ("h", pa.float64())]
)
_SPLITS_DDL = "spec long, node long, gain double, feature long, bin long, gl double, hl double, g double, h double"


def best_split(s: Spec, number: int, node: int, part: int, sums: np.ndarray) -> tuple:
    """A row of _SPLITS from the sums of gradients and Hessians by (feature from ``part`` on, bin)."""
    g, h = sums[:, 0].sum(axis=1)
    left = sums.cumsum(axis=2)
    right = np.array([g, h])[:, None, None] - left
    gain = 0.5 * (left[0] ** 2 / (left[1] + s.l2) + right[0] ** 2 / (right[1] + s.l2) - g**2 / (h + s.l2))
    gain = np.where((left[1] >= s.least_weight) & (right[1] >= s.least_weight), gain, 0.0)
    k, b = np.unravel_index(np.argmax(gain), gain.shape)
    return number, node, float(gain[k, b]), part + int(k), int(b), float(left[0, k, b]), float(left[1, k, b]), float(g), float(h)


def _group_split(specs: dict[int, Spec], bins: int):
    """Group function: the tasks' sums of one node's part to its best split."""

    def run(table: pa.Table) -> pa.Table:
        number, node, part = (table.column(i)[0].as_py() for i in range(3))
        sums = sum(np.frombuffer(x.as_py(), "<f8") for x in table.column("sums")).reshape(2, -1, bins)
        row = best_split(specs[number], number, node, part, sums)
        return pa.Table.from_pylist([dict(zip(_SPLITS.names, row))], schema=_SPLITS)

    return run


def fit(df: DataFrame, spec: Spec, bins: int = BINS) -> Ensemble:
    """One model from the rows of ``df``."""
    cuts = quantile_cuts(df, list(spec.inputs), bins)
    keep = [spec.label, *([spec.fold] if spec.fold else [])]
    table = binned(df, list(spec.inputs), keep, cuts)
    return Booster(table, list(spec.inputs), cuts, [spec], bins).grow()[0]
