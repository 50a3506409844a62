"""Sums over all rows of a numpy function of row batches: the passes of Newton and quasi-Newton solvers."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

#: Task results that one step of the tree adds up.
FAN = 64
#: Rows handed to the function at once.
ROWS = 4096
#: Rows that solvers start from, so that few passes over all rows remain.
START = 20_000


def summed(rows: DataFrame, columns: Sequence[str], function: Callable[[np.ndarray], np.ndarray]) -> np.ndarray | None:
    """The sum of ``function`` (row matrix to a flat array of one length) over all rows, added up by a tree of tasks.

    None for a table without rows. Tasks give one array each, so what meets is bounded by the array, not by the rows.
    """
    columns = list(columns)

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for frame in batches:
            x = frame.to_numpy(float)
            for k in range(0, len(x), ROWS):
                some = np.asarray(function(x[k:k + ROWS]), float)
                total = some if total is None else total + some
        if total is not None:
            yield pd.DataFrame({"part": [TaskContext.get().partitionId()], "v": [total.tobytes()]})

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("part")
        total = sum(np.frombuffer(v) for v in frame["v"])
        return pd.DataFrame({"part": [int(frame["part"].iloc[0]) // FAN], "v": [total.tobytes()]})

    parts = rows.select(*columns).mapInPandas(part, "part int, v binary")
    found = parts.groupBy(F.expr(f"part div {FAN}").alias("p")).applyInPandas(add, "part int, v binary").collect()
    return sum((np.frombuffer(r["v"]) for r in sorted(found, key=lambda r: r["part"])), np.zeros(len(found[0]["v"]) // 8)) if found else None


def summed_here(x: np.ndarray, function: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """What ``summed`` gives for the few rows of ``x``."""
    return sum(np.asarray(function(x[k:k + ROWS]), float) for k in range(0, len(x), ROWS))


def beginning(rows: DataFrame, columns: Sequence[str], n: int, seed: int = 42) -> np.ndarray:
    """Some ``START`` of the ``n`` rows (all, if there are fewer), from which a solver starts that ends on all rows."""
    some = rows.select(*columns)
    if n > START:
        some = some.sample(fraction=START / n, seed=seed)
    return some.toPandas().to_numpy(float)


def lbfgs(evaluate: Callable[[list[np.ndarray]], list[tuple[float, np.ndarray]]], start: np.ndarray, iterations: int, memory: int = 10, tolerance: float = 1e-6, still: float = 1e-9) -> np.ndarray:
    """The point that limited-memory BFGS reaches from ``start``.

    ``evaluate`` gives (loss, gradient) of several points from one pass, so the steps of a line search cost one pass together.
    The end is a gradient below ``tolerance``, or a step that lowers the loss by no more than the share ``still``.
    """
    x, ((loss, gradient),) = start, evaluate([start])
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(iterations):
        if np.abs(gradient).max() < tolerance:
            break
        direction, kept = -gradient, []
        for s, y in reversed(steps):
            a = (s @ direction) / (s @ y)
            direction = direction - a * y
            kept.append(a)
        if steps:
            s, y = steps[-1]
            direction = direction * ((s @ y) / (y @ y))
        else:
            direction = direction / max(1.0, np.abs(gradient).sum())
        for (s, y), a in zip(steps, reversed(kept)):
            direction = direction + (a - (y @ direction) / (s @ y)) * s
        slope = gradient @ direction
        if slope >= 0:
            direction, steps, slope = -gradient, [], -(gradient @ gradient)
        size, found = 1.0, None
        while found is None and size > 1e-10:
            sizes = [size, size / 4, size / 16]
            tried = evaluate([x + t * direction for t in sizes])
            good = [(value, t, g) for t, (value, g) in zip(sizes, tried) if value <= loss + 1e-4 * t * slope]
            found = min(good, key=lambda r: r[0]) if good else None
            size /= 64
        if found is None:
            break
        value, t, new = found
        s, y = t * direction, new - gradient
        if s @ y > 1e-12 * np.sqrt((s @ s) * (y @ y)):
            steps = [*steps, (s, y)][-memory:]
        done = loss - value <= still * max(1.0, abs(loss))
        x, loss, gradient = x + s, value, new
        if done:
            break
    return x


def newton(
    evaluate: Callable[[np.ndarray], tuple[float, np.ndarray, np.ndarray]], losses: Callable[[list[np.ndarray]], np.ndarray], start: np.ndarray, iterations: int = 30,
    tolerance: float = 1e-7, enough: float = 0.0,
) -> np.ndarray:
    """The minimum of a convex function from (loss, gradient, Hessian) of a point; ``losses`` gives those of a line search's points from one pass.

    A whole step that lowers the loss is taken as it is, so it costs one pass. The end is a gradient below ``tolerance``, or a step
    that promises less than the share ``enough`` of the loss.
    """
    x = start
    loss, gradient, hessian = evaluate(x)
    for left in range(iterations, 0, -1):
        if np.abs(gradient).max() < tolerance:
            break
        step = np.linalg.lstsq(hessian + 1e-10 * np.trace(hessian) / len(x) * np.eye(len(x)), gradient, rcond=None)[0]
        promised = gradient @ step / 2
        if promised < enough * abs(loss):
            break
        ahead = evaluate(x - step)
        if ahead[0] <= loss - max(0.2 * promised, 1e-12 * max(1.0, abs(loss))):
            x, (loss, gradient, hessian) = x - step, ahead
            continue
        sizes = 0.5 ** np.arange(12)
        tried = losses([x - t * step for t in sizes])
        best = int(np.argmin(tried))
        if tried[best] >= loss - 1e-12 * max(1.0, abs(loss)):
            break
        x = x - sizes[best] * step
        if left > 1:
            loss, gradient, hessian = ahead if best == 0 else evaluate(x)
    return x
