"""Passes of a fit over blocks of rows that stay in the executors, and its steps on the driver."""

from __future__ import annotations

import operator
from collections import deque
from collections.abc import Callable, Generator, Iterator, Mapping
from dataclasses import dataclass
from typing import Any

import numpy as np
from pyspark import RDD

from labelloom.threads import one_thread

#: Steps that L-BFGS remembers, values that must have stopped falling, trials of a line search.
MEMORY, STALL, TRIALS = 10, 20, 10

#: Bytes of sums that the driver takes at once.
TO_DRIVER = 64 << 20

Evaluate = Callable[[np.ndarray], tuple[float, np.ndarray]]
#: A fit that gives points and is sent their values and gradients.
Steps = Generator[np.ndarray, tuple[float, np.ndarray], Any]


def shares(blocks: RDD) -> RDD:
    """The blocks as a share for each core, so that a pass moves one sum a core, however many partitions
    there are. ``blocks`` are in the executors already, so that shares are where their blocks are."""
    return blocks.coalesce(min(blocks.getNumPartitions(), blocks.context.defaultParallelism))


def summed(own: RDD, length: int, work: Callable[[Iterator], np.ndarray]) -> np.ndarray:
    """The sum of what ``work`` makes of each share, in one job. Small ones are added up by the driver, others
    in as many slices as there are shares."""
    slices = own.getNumPartitions()
    if slices * length * 8 <= TO_DRIVER:

        def whole(blocks: Iterator) -> Iterator[np.ndarray]:
            one_thread()
            yield work(blocks)

        return sum(own.mapPartitions(whole).collect())

    def part(blocks: Iterator) -> Iterator[tuple[int, np.ndarray]]:
        one_thread()
        yield from enumerate(np.array_split(work(blocks), slices))

    total = own.mapPartitions(part).reduceByKey(operator.add, slices)
    try:
        sums = dict(total.collect())
    finally:
        # else a copy of the sum for each core would stay on disk after every pass
        total.cleanShuffleDependencies()
    return np.concatenate([sums[k] for k in range(slices)])


class _NoStep(ArithmeticError):
    """The line search found no point that satisfies its conditions."""


@dataclass
class _Point:
    """A point on the line: how far, where, its value and gradient, and the slope along the line."""

    t: float
    x: np.ndarray
    value: float
    slope: np.ndarray
    along: float


def _between(a: _Point, b: _Point) -> float:
    """The least point of the cubic through both (Nocedal and Wright, 3.59), a tenth off either end."""
    low, high = (a, b) if a.t <= b.t else (b, a)
    d1 = low.along + high.along - 3 * (low.value - high.value) / (low.t - high.t)
    with np.errstate(invalid="ignore", divide="ignore"):
        d2 = np.sqrt(np.float64(d1 * d1 - low.along * high.along))
        t = high.t - (high.t - low.t) * (high.along + d2 - d1) / (high.along - low.along + 2 * d2)
    return float(np.clip(t, low.t + 0.1 * (high.t - low.t), low.t + 0.9 * (high.t - low.t)))


def _search(start: _Point, way: np.ndarray, t: float) -> Steps:
    """A point with strong Wolfe conditions (Nocedal and Wright, 3.5 and 3.6)."""

    def at(t: float) -> Steps:
        x = start.x + t * way
        value, slope = yield x
        return _Point(t, x, value, slope, float(slope @ way))

    def high(p: _Point) -> bool:
        return p.value > start.value + 1e-4 * p.t * start.along

    def flat(p: _Point) -> bool:
        return abs(p.along) <= 0.9 * abs(start.along)

    def zoom(low: _Point, far: _Point) -> Steps:
        for _ in range(TRIALS):
            p = yield from at(_between(low, far))
            if high(p) or p.value >= low.value:
                far = p
                continue
            if flat(p):
                return p
            if p.along * (far.t - low.t) >= 0:
                far = low
            low = p
        raise _NoStep

    low = start
    if start.along > 0:
        raise _NoStep
    for k in range(TRIALS):
        p = yield from at(t)
        if not np.isfinite(p.value):
            t /= 2
            continue
        if high(p) or (k and p.value >= low.value):
            return (yield from zoom(low, p))
        if flat(p):
            return p
        if p.along >= 0:
            return (yield from zoom(p, low))
        low, t = p, t * 1.5
    raise _NoStep


def steps_of(x: np.ndarray, iterations: int, tolerance: float) -> Steps:
    """L-BFGS. It ends when the value has not fallen for ``STALL`` steps, or the gradient has vanished."""
    value, slope = yield x
    here, first = _Point(0.0, x, value, slope, 0.0), value
    seen, past, failed, steps = deque([np.inf], STALL), deque(maxlen=MEMORY), False, 0
    part = np.empty_like(x)
    while steps < iterations:
        way, shares = -here.slope, []
        for s, y, both in reversed(past):
            shares.append(float(s @ way) / both)
            way -= np.multiply(y, shares[-1], out=part)
        if past:
            _, y, both = past[-1]
            way *= both / float(y @ y)
        for (s, y, both), share in zip(past, reversed(shares), strict=True):
            way += np.multiply(s, share - float(y @ way) / both, out=part)
        start = _Point(0.0, here.x, here.value, here.slope, float(here.slope @ way))
        try:
            there = yield from _search(start, way, 1.0 if steps else 1.0 / np.linalg.norm(way))
            if there.t * np.linalg.norm(here.slope) < 1e-10:
                raise _NoStep
        except _NoStep:
            if failed:
                break
            failed = True
            past.clear()
            continue
        failed, steps = False, steps + 1
        s, y = there.x - here.x, there.slope - here.slope
        past.append((s, y, float(s @ y)))
        here = there
        seen.append(here.value)
        if abs(here.value - max(seen)) <= tolerance * first:
            break
        if np.linalg.norm(here.slope) <= max(tolerance * here.value, 1e-8):
            break
    return here.x


def minimise_all(evaluate: Callable[[Mapping[Any, np.ndarray]], Mapping[Any, tuple[float, np.ndarray]]], fits: Mapping[Any, Steps]) -> dict:
    """The ends of all ``fits``, taken side by side: one call evaluates the points of all that go on."""
    fits, points, found = dict(fits), {}, {}

    def go(name: Any, sent: tuple[float, np.ndarray] | None) -> None:
        try:
            points[name] = fits[name].send(sent)
        except StopIteration as end:
            points.pop(name, None)
            found[name] = end.value

    for name in fits:
        go(name, None)
    while points:
        for name, sent in evaluate(points).items():
            go(name, sent)
    return found


def minimise(evaluate: Evaluate, x: np.ndarray, iterations: int, tolerance: float) -> np.ndarray:
    """The point with the least value that L-BFGS finds from ``x``."""
    return minimise_all(lambda points: {0: evaluate(points[0])}, {0: steps_of(x, iterations, tolerance)})[0]
