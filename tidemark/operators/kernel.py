"""Kernel classifier: random Fourier features of a Gaussian kernel and squared-hinge machines, one class against the rest.

The kernel exp(-gamma |x - y|^2) is the mean of products of D random cosines, with a standard error of at most
1 / sqrt(D) per pair.  On these features the machine is linear.  All machines of a search - every candidate, fold and
class - take their steps together: a step is one aggregate over the rows, which returns loss and gradient of every
machine at several step lengths.  The number of jobs depends on neither candidates, folds nor classes, and what a task
hands on depends on the machines only, not on the rows.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from ..session import freeze
from .evaluate import class_scores, macro_scores
from .sampling import folds

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SEED = 56
FEATURES = 256
# lengths tried along a direction in the same pass
LENGTHS = (1.0, 0.25, 1.0 / 16, 1.0 / 256, 4.0)
HISTORY = 10
STEPS = 80
# a machine rests when its gradient has shrunk to this share of the first one
REST = 1e-3
# the driver adds up this many partial sums per candidate, however many tasks there are
MERGERS = 4
# rows whose cosines are held at once
ROWS_AT_ONCE = 2048


@dataclass
class Cosines:
    """Draws of the feature map, for gamma = 1/2; other widths scale the directions."""

    directions: np.ndarray
    phases: np.ndarray

    def of(self, rows: np.ndarray, gamma: float) -> np.ndarray:
        """One column per cosine and a last one of ones."""
        return self.along(rows @ self.directions.T, gamma)

    def along(self, projected: np.ndarray, gamma: float) -> np.ndarray:
        """``of`` for rows that were multiplied by the directions before, which serves every width."""
        out = np.ones((len(projected), len(self.phases) + 1))
        cosines = out[:, :-1]
        np.multiply(projected, np.sqrt(2 * gamma), out=cosines)
        cosines += self.phases
        np.cos(cosines, out=cosines)
        cosines *= np.sqrt(2 / len(self.phases))
        return out


def draw_cosines(inputs: int, count: int = FEATURES, seed: int = SEED) -> Cosines:
    draw = np.random.default_rng(seed)
    return Cosines(draw.standard_normal((count, inputs)), draw.uniform(0, 2 * np.pi, count))


@dataclass
class Machines:
    """Weights (candidate, fold, class, feature) of all machines and the settings of their candidates."""

    settings: list[dict]
    classes: list[int]
    folds: int
    cosines: Cosines
    weights: np.ndarray

    def scores(self, rows: np.ndarray, candidate: int, fold: int) -> np.ndarray:
        return self.cosines.of(rows, self.settings[candidate]["gamma"]) @ self.weights[candidate, fold].T


def _matrix(batch, features: list[str]) -> np.ndarray:
    return np.column_stack([batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in features])


def hinge(signs: np.ndarray, margins: np.ndarray) -> np.ndarray:
    """What a row lacks to the margin of one."""
    return np.maximum(0.0, 1.0 - signs * margins)


def _sums(machines: Machines, along: np.ndarray, lengths: tuple, features: list[str], label: str, going: dict[int, list]):
    """Per task and candidate the summed losses and loss gradients of its machines that are ``going``, at all lengths."""
    import pyarrow as pa

    fold_count, classes = machines.folds, np.array(machines.classes)

    def run(batches):
        total = {}
        for batch in batches:
            every = _matrix(batch, features) if batch.num_rows else ()
            for start in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = slice(start, start + ROWS_AT_ONCE)
                rows = every[part]
                truth = batch.column(batch.schema.get_field_index(label)).to_numpy(zero_copy_only=False)[part]
                fold = batch.column(batch.schema.get_field_index("fold")).to_numpy(zero_copy_only=False)[part]
                signs = np.where(truth[:, None] == classes, 1.0, -1.0)
                # with one fold only, all rows teach
                taught = fold[:, None] != np.arange(fold_count) if fold_count > 1 else np.ones((len(fold), 1), dtype=bool)
                projected = rows @ machines.cosines.directions.T
                for c, own in going.items():
                    z = machines.cosines.along(projected, machines.settings[c]["gamma"])
                    f, j = (np.array(x) for x in zip(*own))
                    sign, used = signs[:, j], taught[:, f]
                    margin, change = z @ machines.weights[c, f, j].T, z @ along[c, f, j].T
                    lack = np.stack([np.where(used, hinge(sign, margin + t * change), 0.0) for t in lengths], axis=1)
                    out = np.zeros((len(lengths), len(own), z.shape[1] + 1))
                    out[:, :, 0] = (lack**2).sum(axis=0)
                    pull = (lack * sign[:, None, :]).reshape(len(rows), -1)
                    out[:, :, 1:] = (-2 * pull.T @ z).reshape(len(lengths), len(own), -1)
                    total[c] = total[c] + out if c in total else out
        if total:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(total), pa.int32()), pa.array([part.tobytes() for part in total.values()], pa.binary())],
                names=["candidate", "sums"],
            )

    return run


def _added(key, frame):
    import pandas as pd

    total = sum(np.frombuffer(blob, dtype=np.float64) for blob in frame["sums"])
    return pd.DataFrame({"candidate": [key[0]], "sums": [total.tobytes()]})


def losses(
    rows: DataFrame, features: list[str], label: str, machines: Machines, along: np.ndarray, lengths: tuple,
    resting: set[tuple] = frozenset(),
) -> np.ndarray:
    """(candidate, length, fold, class, 1 + feature): summed squared hinges and their gradients, from one aggregate.

    Machines that are ``resting``, named by candidate, fold and class, cost nothing and stay zero.
    """
    going: dict[int, list] = {}
    for k in np.ndindex(*machines.weights.shape[:3]):
        if k not in resting:
            going.setdefault(k[0], []).append(k[1:])
    partial = rows.select(*[F.col(c).cast("double").alias(c) for c in features], F.col(label).cast("int").alias(label), "fold")
    partial = partial.mapInArrow(_sums(machines, along, lengths, features, label, going), "candidate int, sums binary")
    partial = partial.withColumn("merger", F.pmod(F.spark_partition_id(), F.lit(MERGERS)))
    found = partial.groupBy("candidate", "merger").applyInPandas(_added, "candidate int, sums binary").collect()
    out = np.zeros((len(machines.settings), len(lengths), machines.folds, len(machines.classes), machines.weights.shape[-1] + 1))
    for row in found:
        own = going[row.candidate]
        f, j = (np.array(x) for x in zip(*own))
        out[row.candidate][:, f, j] += np.frombuffer(bytes(row.sums)).reshape(len(lengths), len(own), -1)
    return out


def _direction(gradient: np.ndarray, past: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Limited-memory quasi-Newton direction of one machine."""
    q, held = gradient.copy(), []
    for s, y in reversed(past):
        a = s @ q / (s @ y)
        q -= a * y
        held.append(a)
    if past:
        s, y = past[-1]
        q *= (s @ y) / (y @ y)
    else:
        q /= max(1.0, np.linalg.norm(gradient))
    for (s, y), a in zip(past, reversed(held)):
        q += s * (a - y @ q / (s @ y))
    return -q


def fit(
    rows: DataFrame, features: list[str], label: str, classes: list[int], settings: list[dict], fold_count: int = 1,
    cosines: Cosines | None = None, steps: int = STEPS,
) -> Machines:
    """Machines for every setting (``c``, ``gamma``); with ``fold`` given, one per fold, taught by the other folds.

    Each minimises |w|^2 / 2 + c * sum(hinge^2), the bias free.  Features and labels must not be NULL.
    """
    if fold_count == 1 and "fold" not in rows.columns:
        rows = rows.withColumn("fold", F.lit(0))
    cosines = cosines or draw_cosines(len(features))
    size = len(cosines.phases) + 1
    machines = Machines(settings, classes, fold_count, cosines, np.zeros((len(settings), fold_count, len(classes), size)))
    price = np.array([s["c"] for s in settings])
    penalised = np.ones(size)
    penalised[-1] = 0.0
    along = np.zeros_like(machines.weights)
    keys = list(np.ndindex(*machines.weights.shape[:3]))
    past: dict[tuple, list] = {k: [] for k in keys}
    gradient, value, first = {}, {}, {}
    scale = {k: 1.0 for k in keys}
    resting: set[tuple] = set()
    for step in range(steps + 1):
        lengths = LENGTHS if step else (0.0,)
        found = losses(rows, features, label, machines, along, lengths, resting)
        for k in keys:
            if k in resting:
                continue
            c, f, j = k
            at = [machines.weights[k] + t * along[k] for t in lengths]
            total = [0.5 * (w * penalised) @ w + price[c] * found[c, i, f, j, 0] for i, w in enumerate(at)]
            slope = [w * penalised + price[c] * found[c, i, f, j, 1:] for i, w in enumerate(at)]
            best = int(np.argmin(total))
            if step == 0:
                gradient[k], value[k] = slope[0], total[0]
                first[k] = max(np.linalg.norm(slope[0]), 1e-300)
            elif total[best] < value[k]:
                s, y = at[best] - machines.weights[k], slope[best] - gradient[k]
                if s @ y > 1e-12 * np.linalg.norm(s) * np.linalg.norm(y):
                    past[k] = [*past[k], (s, y)][-HISTORY:]
                machines.weights[k], gradient[k], value[k], scale[k] = at[best], slope[best], total[best], 1.0
            elif past[k]:
                past[k] = []
            else:
                scale[k] /= 1024
            along[k] = scale[k] * _direction(gradient[k], past[k])
            if np.linalg.norm(gradient[k]) <= REST * first[k] or scale[k] < 1e-9:
                resting.add(k)
                along[k] = 0.0
        if len(resting) == len(keys):
            break
    return machines


def predict(rows: DataFrame, features: list[str], machines: Machines, keys: list[str], candidate: int = 0) -> DataFrame:
    """``pred``, the class of the highest score (ties: the first), beside the key columns."""
    classes = np.array(machines.classes)
    slim = rows.select(*keys, *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(features)])
    names = [f"_x{i}" for i in range(len(features))]
    kept = rows.select(*keys)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            found = classes[machines.scores(_matrix(batch, names), candidate, 0).argmax(axis=1)] if batch.num_rows else []
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i in range(len(keys))], pa.array(found, pa.int32())], names=[*keys, "pred"]
            )

    return slim.mapInArrow(run, kept.withColumn("pred", F.lit(0)).schema)


def _votes(machines: Machines, features: list[str], label: str):
    """Rows per candidate, fold, true and predicted class, each row judged by the machines that did not see it."""
    import pyarrow as pa

    classes = np.array(machines.classes)

    def run(batches):
        cells = np.zeros((len(machines.settings), machines.folds, len(classes), len(classes)), dtype=np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = _matrix(batch, features)
            truth = np.searchsorted(classes, batch.column(batch.schema.get_field_index(label)).to_numpy(zero_copy_only=False))
            fold = batch.column(batch.schema.get_field_index("fold")).to_numpy(zero_copy_only=False)
            projected = rows @ machines.cosines.directions.T
            for c, setting in enumerate(machines.settings):
                for f in range(machines.folds):
                    mine = fold == f
                    if mine.any():
                        scores = machines.cosines.along(projected[mine], setting["gamma"]) @ machines.weights[c, f].T
                        np.add.at(cells[c, f], (truth[mine], scores.argmax(axis=1)), 1)
        at = np.argwhere(cells)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(at[:, 0], pa.int32()), pa.array(at[:, 1], pa.int32()), pa.array(classes[at[:, 2]], pa.int32()),
                pa.array(classes[at[:, 3]], pa.int32()), pa.array(cells[tuple(at.T)], pa.int64()),
            ],
            names=["candidate", "fold", "label", "pred", "n"],
        )

    return run


def random_settings(count: int, seed: int = SEED) -> list[dict]:
    """Random prices and widths, both exponentially distributed."""
    draw = np.random.default_rng(seed)
    return [{"c": float(draw.exponential(100)), "gamma": float(draw.exponential(0.1))} for _ in range(count)]


def search(
    df: DataFrame, features: list[str], key: str, settings: list[dict], label: str = "label", k: int = 3,
    cosines: Cosines | None = None, steps: int = STEPS // 2,
) -> DataFrame:
    """Mean and deviation of the macro F1 of every setting over stratified folds; NULL labels take no part."""
    folded = freeze(folds(df.where(F.col(label).isNotNull()).select(key, label, *features), label, key, k))
    # the classes that the caller tells apart
    classes = sorted(r[0] for r in folded.select(label).distinct().collect())
    machines = fit(folded, features, label, classes, settings, k, cosines, steps)
    slim = folded.select(*[F.col(c).cast("double").alias(c) for c in features], F.col(label).cast("int").alias(label), "fold")
    cells = slim.mapInArrow(_votes(machines, features, label), "candidate int, fold int, label int, pred int, n long")
    scored = macro_scores(class_scores(cells, "label", "pred", ["candidate", "fold"], "n"), ["candidate", "fold"])
    means = scored.groupBy("candidate").agg(F.avg("f1").alias("score"), F.stddev_pop("f1").alias("deviation"))
    stated = df.sparkSession.createDataFrame(
        [(i, s["c"], s["gamma"]) for i, s in enumerate(settings)], "candidate int, c double, gamma double"
    )
    return stated.join(F.broadcast(means), "candidate").select("candidate", "c", "gamma", "score", "deviation")


def feature_map(rows: DataFrame, features: list[str], keys: list[str], cosines: Cosines, gamma: float) -> DataFrame:
    """``cosines``, the random features of every row, beside the key columns."""
    slim = rows.select(*keys, *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(features)])
    names = [f"_x{i}" for i in range(len(features))]
    schema = rows.select(*keys, F.array(F.lit(0.0)).alias("cosines")).schema

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            found = cosines.of(_matrix(batch, names), gamma)[:, :-1] if batch.num_rows else []
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i in range(len(keys))], pa.array(list(found), pa.list_(pa.float64()))],
                names=[*keys, "cosines"],
            )

    return slim.mapInArrow(run, schema)
