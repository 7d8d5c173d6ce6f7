"""Language-model scores of whole texts (operator 1).

The model is log-bilinear: the vectors of the two words before, each scaled by the weights of its
place, add up to a predicted vector, and the score of a word is its product with the word's vector
plus a bias. It is trained in numpy by noise-contrastive estimation. The most frequent tokens, 65,536
or more, are outcomes of their own, as contexts too; all others share one outcome and are told apart
within it by their smoothed counts. Probabilities are exact in two levels, the class of an outcome and
the outcome in its class, each normalised over all its scores by a batched matrix product. Classes
are runs of the outcomes by frequency, cut so that both levels cost about the same.

Counts cover all training tokens and never leave the cluster, but for a bounded head. Training text is
dealt out to parts of about ``PART_TOKENS`` tokens by a hash of its rows, in order of the hash, and each
part trains a model on all of its text. Parts are trained in two rounds, the second one from the average
of the first. So the model follows from the rows alone, not from files, tasks or their order.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.llm.blocks import BASE, UNBASE, Block, blocks, id_and_text, mix, powers, real_id, words
from labelloom.llm.threads import one_thread
from labelloom.session import settle

#: Tokens with vectors of their own, whose counts go to every task: so many, or so many times the root of the number of distinct ones.
HEAD = 1 << 16
HEAD_ROOT = 16
SIZE = 24
NOISE = 16
BATCH = 8192
#: Targets of a batch that share their noise, at most.
LOT = 2048
RATE = 0.1
#: Tokens scored at once, and rows of a model averaged at once.
SLICE = 1 << 17
ROWS = 1024
#: Cells of a matrix product of the scoring, about.
CELLS = 1 << 17
#: Values of a row that are added one by one, at most.
FEW = 8
SEED = 11
#: Training tokens of a part, about; rounds of parts; parts whose models are added up at once.
PART_TOKENS = 1 << 22
ROUNDS = 2
FAN = 64
_LETTERS = np.random.default_rng(SEED).integers(0, 1 << 64, 256, dtype=np.uint64)


def token_hashes(types: pa.Array) -> np.ndarray:
    """64 bits for each distinct word: a polynomial over random numbers for its bytes, scrambled with its length."""
    wide = pa.types.is_large_binary(types.type)
    ends = np.frombuffer(types.buffers()[1], dtype=np.int64 if wide else np.int32)[types.offset : types.offset + len(types) + 1].astype(np.int64)
    if not len(types):
        return np.zeros(0, dtype=np.uint64)
    data = np.frombuffer(types.buffers()[2], dtype=np.uint8)[: ends[-1]]
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_LETTERS[data] * powers(BASE, len(data))[: len(data)], out=total[1:])
    back = powers(UNBASE, len(data) + 1)
    return mix((total[ends[1:]] - total[ends[:-1]]) * back[ends[:-1]] + np.diff(ends).astype(np.uint64))


#: The token after the last word. No word is a blank, so no word has its hash.
END = int(token_hashes(pa.array([b" "]))[0])
LN10 = float(np.log(10))


@dataclass
class Head:
    """The most frequent tokens by hash, with their counts and outcomes (by frequency; -1: the shared one),
    the number of all training tokens and of distinct ones."""

    hash: np.ndarray
    count: np.ndarray
    outcome: np.ndarray
    total: int
    distinct: int

    @property
    def outcomes(self) -> int:
        """Outcomes of their own; the shared one has this number, the place before a text the next."""
        return int((self.outcome >= 0).sum())


def _tokens(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each distinct token, the last one being END; token numbers of all texts, each with its end; first token of each)."""
    w = words(block)
    types = np.r_[token_hashes(w.types), np.uint64(END)]
    ends = w.first[1:]
    return types, np.insert(w.code, ends, len(types) - 1), w.first + np.arange(len(w.first))


def token_counts(docs: DataFrame) -> DataFrame:
    """(h, n): how often each token of all texts occurs, ends included. Counts are combined in each block."""

    def run(batches: Iterator[pa.RecordBatch]):
        for block in blocks(batches, lower=True):
            types, code, _ = _tokens(block)
            n = np.bincount(code, minlength=len(types))
            yield pa.RecordBatch.from_pydict({"h": types.view(np.int64), "n": n})

    return id_and_text(docs).mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def head_of(counts: DataFrame, outcomes: int | None = None, size: int | None = None) -> Head:
    """The ``size`` most frequent tokens at most, all of them outcomes if no number is given; about twice as many reach the driver.

    Frequencies fall into classes of about 9 %. Whole classes come first, and of the class that does not fit, the
    tokens of least hash. (A sort with a limit would send ``size`` tokens of each partition to the driver.)
    """
    total = counts.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()
    if size is None:
        size = max(HEAD, int(HEAD_ROOT * math.sqrt(total["v"])))
    outcomes = size if outcomes is None else outcomes
    level = F.floor(F.log2("n") * 8)
    room, whole, part, slot = size, -1, -1, 0
    if total["v"] > size:
        for row in sorted(counts.groupBy(level.alias("level")).count().collect(), reverse=True):
            whole, part = row["level"] + 1, row["level"]
            if row["count"] > room:
                # hashes are uniform: so many of the 2**63 slots hold about twice the tokens that are wanted
                slot = min((2 * room + 64) * (1 << 63) // row["count"], (1 << 63) - 1)
                break
            room -= row["count"]
    wanted = (F.col("level") >= whole) | ((F.col("level") == part) & (F.shiftrightunsigned("h", 1) <= slot))
    found = counts.withColumn("level", level).filter(wanted).select("h", "n", "level").toArrow()
    h, n, at = (found.column(c).to_numpy().astype(np.int64) for c in ("h", "n", "level"))
    more = np.flatnonzero(at < whole)
    more = more[np.argsort(h[more].view(np.uint64))][:room]
    keep = np.r_[np.flatnonzero(at >= whole), more]
    keep = keep[np.lexsort((h[keep], -n[keep]))]
    n, h = n[keep], h[keep].view(np.uint64)
    by = np.argsort(h)
    own = np.arange(len(h))
    own[outcomes:] = -1
    return Head(h[by], n[by], own[by], total["n"] or 0, total["v"])


def _looked_up(head: Head, types: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(outcome, count) of hashes; the count is -1 outside the head."""
    if not len(head.hash):
        return np.full(len(types), 0), np.full(len(types), -1)
    at = np.minimum(np.searchsorted(head.hash, types), len(head.hash) - 1)
    same = head.hash[at] == types
    outcome = np.where(same & (head.outcome[at] >= 0), head.outcome[at], head.outcomes)
    return outcome, np.where(same, head.count[at], -1)


def _history(outcome: np.ndarray, first: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """The outcomes one and two tokens before each; ``start`` before a text."""
    one = np.r_[start, outcome[:-1]]
    one[first[:-1]] = start
    two = np.r_[start, one[:-1]]
    two[first[:-1]] = start
    return one, two


@dataclass
class Model:
    """Word vectors of contexts and of targets, place weights, biases; vectors and biases of the classes. Class ``c`` has
    the outcomes from ``edge[c]`` to ``edge[c + 1] - 1``; the shared outcome is the last class."""

    context: np.ndarray
    target: np.ndarray
    place: np.ndarray
    bias: np.ndarray
    group: np.ndarray
    group_bias: np.ndarray
    edge: np.ndarray

    def arrays(self) -> list[np.ndarray]:
        return [self.context, self.target, self.place, self.bias, self.group, self.group_bias]

    def copy(self) -> Model:
        return Model(*(a.copy() for a in self.arrays()), self.edge)

    def rows(self) -> np.ndarray:
        """All numbers as one matrix, a bias beside each vector."""
        parts = ((self.context, None), (self.target, self.bias), (self.group, self.group_bias), (self.place, None))
        return np.concatenate([np.c_[a, np.zeros(len(a), dtype=a.dtype) if b is None else b] for a, b in parts])

    def from_rows(self, rows: np.ndarray) -> Model:
        cuts = np.cumsum([len(self.context), len(self.target), len(self.group)])
        context, target, group, place = np.split(rows.astype(np.float32), cuts)
        parts = (context[:, :-1], target[:, :-1], place[:, :-1], target[:, -1], group[:, :-1], group[:, -1])
        return Model(*map(np.ascontiguousarray, parts), self.edge)

    def classes(self, outcome: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.edge, outcome, side="right") - 1


def noise_of(head: Head) -> np.ndarray:
    """Unigram chances of the outcomes, the shared one last."""
    k = head.outcomes
    n = np.zeros(k + 1)
    own = head.outcome >= 0
    n[head.outcome[own]] = head.count[own]
    n[k] = max(head.total - n[:k].sum(), 0) + 1
    return n / n.sum()


def class_edges(noise: np.ndarray) -> np.ndarray:
    """Where classes of outcomes begin, and the end. Runs of equal sums of the roots of the chances make the number of
    classes plus the mean size of a target's class least where the sum is 1."""
    at = np.floor(np.cumsum(np.sqrt(noise[:-1])) - np.sqrt(noise[:-1]) / 2)
    return np.r_[np.flatnonzero(np.r_[True, at[1:] != at[:-1]][: len(at)]), len(noise) - 1, len(noise)]


def fresh(head: Head, size: int = SIZE) -> Model:
    """Small fixed vectors, and the unigram model as biases."""
    rng, k = np.random.default_rng(SEED), head.outcomes
    noise = noise_of(head)
    edge = class_edges(noise)
    return Model(
        rng.normal(0, 0.1, (k + 2, size)).astype(np.float32),
        rng.normal(0, 0.1, (k + 1, size)).astype(np.float32),
        np.array([[1.0], [0.5]], dtype=np.float32).repeat(size, axis=1),
        np.log(noise).astype(np.float32),
        rng.normal(0, 0.1, (len(edge) - 1, size)).astype(np.float32),
        np.log(np.add.reduceat(noise, edge[:-1])).astype(np.float32),
        edge,
    )


def _order(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the stable order of row numbers, the rows in it). Numbers that hold their places too need no stable sort."""
    bits = np.int64(max(1, len(rows) - 1).bit_length())
    key = np.sort((rows.astype(np.int64) << bits) | np.arange(len(rows)))
    return key & ((np.int64(1) << bits) - 1), key >> bits


def _sums(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct rows, the sum of the values of each, how many it has), those with most values first.

    Rows of few values, nearly all, are added value by value for all of them at once, in ``reduceat``'s order:
    the first one to the sum of the others.
    """
    by, rows = _order(rows)
    starts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
    n = np.diff(np.r_[starts, len(rows)])
    most = _order(len(rows) - n)[0]
    starts, n = starts[most], n[most]
    # more[k]: the rows of more than k values
    more = np.searchsorted(-n, -np.arange(FEW + 1))
    out = np.empty((len(starts), values.shape[1]), dtype=values.dtype)
    long = more[FEW]
    if long:
        first = np.cumsum(n[:long]) - n[:long]
        at = np.repeat(starts[:long] - first, n[:long]) + np.arange(n[:long].sum())
        out[:long] = np.add.reduceat(values.take(by[at], axis=0), first, axis=0)
    rest = values.take(by[starts[long : more[1]] + 1], axis=0)
    for k in range(2, FEW):
        rest[: more[k] - long] += values.take(by[starts[long : more[k]] + k], axis=0)
    out[long:] = values.take(by[starts[long:]], axis=0)
    out[long : more[1]] += rest
    return rows[starts], out, n


def _put(table: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
    """``table[rows] = values``, each row copied in one piece."""
    piece = np.dtype((np.void, table.itemsize * table.shape[1]))
    table.view(piece)[:, 0][rows] = np.ascontiguousarray(values, dtype=table.dtype).view(piece)[:, 0]


def _sure(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(np.clip(x, -30, 30)))


class Trainer:
    """Noise-contrastive estimation with AdaGrad at both levels. Targets of a lot share the noise for classes, and those of
    one class in it the noise within the class; both are drawn anew. Only rows that a batch meets are changed."""

    def __init__(self, model: Model, noise: np.ndarray, seed: int) -> None:
        self.model, self.noise, self.rng = model, noise, np.random.default_rng(seed)
        self.seen = [np.full(a.shape, 1.0, dtype=np.float32) for a in model.arrays()]
        self.met = np.zeros(len(model.context) + len(model.target), dtype=np.float32)
        self.tokens = 0
        chance = np.add.reduceat(noise, model.edge[:-1])
        self.log_class = np.log(NOISE * chance).astype(np.float32)
        self.log_noise = np.log(NOISE * noise / np.repeat(chance, np.diff(model.edge))).astype(np.float32)
        self.steps, self.class_steps = np.r_[0.0, noise.cumsum()], chance.cumsum()

    def _step(self, k: int, rows, grad: np.ndarray) -> None:
        table, past = self.model.arrays()[k], self.seen[k]
        if table.ndim == 1 or isinstance(rows, slice):
            seen = past[rows] + grad * grad
            past[rows] = seen
            table[rows] += RATE * grad / np.sqrt(seen)
            return
        seen = past.take(rows, axis=0)
        seen += grad * grad
        _put(past, rows, seen)
        change = RATE * grad
        change /= np.sqrt(seen, out=seen)
        change += table.take(rows, axis=0)
        _put(table, rows, change)

    @staticmethod
    def _against(starts: np.ndarray, hidden: np.ndarray, wrong: np.ndarray, bias: np.ndarray) -> np.ndarray:
        """Scores of the noise of each run for the targets of that run."""
        out = np.empty((len(hidden), NOISE), dtype=np.float32)
        for k, (lo, hi) in enumerate(zip(starts.tolist(), [*starts[1:].tolist(), len(hidden)])):
            np.matmul(hidden[lo:hi], wrong[k].T, out=out[lo:hi])
        out += bias.repeat(np.diff(starts, append=len(hidden)), axis=0)
        return out

    @staticmethod
    def _back(starts: np.ndarray, hidden: np.ndarray, wrong: np.ndarray, dx: np.ndarray, dy: np.ndarray, dh: np.ndarray) -> np.ndarray:
        """Adds the noise's part to ``dh``; the gradients of the real rows and then of the noise rows, those of the biases last, as
        ``hidden`` ends in a one."""
        n, width = hidden.shape
        every = np.empty((n + len(starts) * NOISE, width), dtype=np.float32)
        np.multiply(dx[:, None], hidden, out=every[:n])
        out = every[n:].reshape(len(starts), NOISE, width)
        more = np.empty_like(dh)
        for k, (lo, hi) in enumerate(zip(starts.tolist(), [*starts[1:].tolist(), n])):
            d = dy[lo:hi]
            np.matmul(d, wrong[k], out=more[lo:hi])
            np.matmul(d.T, hidden[lo:hi], out=out[k])
        dh += more
        return every

    def batch(self, one: np.ndarray, two: np.ndarray, target: np.ndarray) -> None:
        """One step."""
        m, n = self.model, len(target)
        by, target = _order(target)
        one, two = one[by], two[by]
        own = m.classes(target)
        a, b = m.context.take(one, axis=0), m.context.take(two, axis=0)
        wide = np.ones((n, a.shape[1] + 1), dtype=np.float32)
        hidden = wide[:, :-1]
        np.multiply(a, m.place[0], out=hidden)
        hidden += b * m.place[1]
        # classes; targets of a lot share their noise
        lots = np.arange(0, n, LOT)
        drawn = np.minimum(np.searchsorted(self.class_steps, self.rng.random((len(lots), NOISE))), len(m.group) - 1)
        real, wrong = m.group.take(own, axis=0), m.group.take(drawn, axis=0)
        x = np.einsum("ij,ij->i", hidden, real) + m.group_bias[own] - self.log_class[own]
        y = self._against(lots, hidden, wrong, m.group_bias[drawn] - self.log_class[drawn])
        dx, dy = _sure(x), -_sure(-y)  # 1 - P(real), -P(noise taken for real)
        dh = dx[:, None] * real
        g_rows, g_values = np.r_[own, drawn.ravel()], self._back(lots, wide, wrong, dx, dy, dh)
        # outcomes within their classes; a run is a lot's targets of one class, and classes of one outcome have no run
        some = np.flatnonzero(m.edge[own + 1] - m.edge[own] > 1)
        t_rows, t_values = None, None
        if len(some):
            wide, t, c = wide.take(some, axis=0), target[some], own[some]
            h = wide[:, :-1]
            runs = np.flatnonzero(np.r_[True, (c[1:] != c[:-1]) | (some[1:] // LOT != some[:-1] // LOT)])
            first, end = m.edge[c[runs]][:, None], m.edge[c[runs] + 1][:, None]
            at = self.steps[first] + self.rng.random((len(runs), NOISE)) * (self.steps[end] - self.steps[first])
            drawn = np.clip(np.searchsorted(self.steps, at, side="right") - 1, first, end - 1)
            real, wrong = m.target.take(t, axis=0), m.target.take(drawn, axis=0)
            u = np.einsum("ij,ij->i", h, real) + m.bias[t] - self.log_noise[t]
            v = self._against(runs, h, wrong, m.bias[drawn] - self.log_noise[drawn])
            du, dv = _sure(u), -_sure(-v)
            back = du[:, None] * real
            t_rows, t_values = np.r_[t, drawn.ravel()], self._back(runs, wide, wrong, du, dv, back)
            back += dh.take(some, axis=0)
            _put(dh, some, back)
        both = np.empty((2 * n, dh.shape[1]), dtype=np.float32)
        np.multiply(dh, m.place[0], out=both[:n])
        np.multiply(dh, m.place[1], out=both[n:])
        rows, values, met = _sums(np.r_[one, two], both)
        a *= dh
        b *= dh
        place = np.stack([a.sum(axis=0), b.sum(axis=0)]) / n
        self._step(0, rows, values)
        self.met[rows] += met
        if t_rows is not None:
            rows, values, met = _sums(t_rows, t_values)
            self._step(1, rows, values[:, :-1])
            self._step(3, rows, values[:, -1])
            self.met[len(m.context) + rows] += met
        self._step(2, slice(None), place)
        rows, values, _ = _sums(g_rows, g_values)
        self._step(4, rows, values[:, :-1])
        self._step(5, rows, values[:, -1])
        self.tokens += n

    def weights(self) -> np.ndarray:
        """For each of the model's rows how often it was met; all tokens for those that all share."""
        return np.r_[self.met, np.full(len(self.model.group) + len(self.model.place), self.tokens)].astype(np.float32)


def _by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Sorted rows in batches of one part each."""
    for batch in batches:
        part = batch.column("part").to_numpy()
        cut = np.flatnonzero(np.diff(part, prepend=-1) != 0).tolist()
        for a, b in zip(cut, [*cut[1:], len(part)]):
            yield int(part[a]), batch.slice(a, b - a).select(["doc_id", "text"])


def _added(table: pa.Table) -> pa.Table:
    """Models of several parts as one: sums in order of the parts, so that they are always the same."""
    table = table.sort_by("part")
    x, w = (sum(np.frombuffer(v.as_buffer(), dtype=np.float32).astype(np.float64) for v in table.column(c)) for c in ("x", "w"))
    part = pa.array([table.column("part")[0].as_py() // FAN], pa.int64())
    return pa.table({"i": table.column("i")[:1], "part": part, "x": [x.astype(np.float32).tobytes()], "w": [w.astype(np.float32).tobytes()]})


def train(docs: DataFrame, head: Head, size: int = SIZE, part_tokens: int = PART_TOKENS) -> Model:
    """The mean of the models that the parts of ``docs`` train, each row weighted by how often a part met it; two rounds.

    The number of parts follows from the number of tokens, the rows of a part and their order from a
    hash of id and text. Models are added up ``FAN`` parts at a time.
    """
    parts = max(1, -(-head.total // part_tokens))
    rounds = min(ROUNDS, parts)
    h = F.xxhash64(F.lit(SEED), "doc_id", "text")
    rows = id_and_text(docs).withColumn("h", h).withColumn("part", F.pmod("h", F.lit(parts)))
    model, noise = fresh(head, size), noise_of(head)
    for number in range(rounds):
        mine = rows.filter(F.col("part") % rounds == number)
        width = -(-(parts - number) // rounds)
        dealt = mine.repartitionById(width, F.floor(F.col("part") / rounds).cast("int")).sortWithinPartitions("part", "h")
        model = _trained(dealt, model, noise, head, width * rounds)
    return model


def _trained(rows: DataFrame, start: Model, noise: np.ndarray, head: Head, parts: int) -> Model:
    """One round: the average of the models that each part makes of ``start``."""

    def run(batches: Iterator[pa.RecordBatch]):
        one_thread()
        for part, own in groupby(_by_part(batches), key=lambda x: x[0]):
            trainer = Trainer(start.copy(), noise, SEED + part)
            for block in blocks((b for _, b in own), lower=True):
                types, code, first = _tokens(block)
                target = _looked_up(head, types)[0][code]
                one, two = _history(target, first, head.outcomes + 1)
                # texts differ in kind; mixed batches keep the steps even
                order = np.random.default_rng(len(code)).permutation(len(code))
                for a in range(0, len(code), BATCH):
                    at = order[a : a + BATCH]
                    trainer.batch(one[at], two[at], target[at])
            rows, weight = trainer.model.rows(), trainer.weights()
            for a in range(0, len(rows), ROWS):
                w = weight[a : a + ROWS]
                if w.any():
                    x = (rows[a : a + ROWS] * w[:, None]).astype(np.float32)
                    yield pa.RecordBatch.from_pydict({"i": pa.array([a], pa.int64()), "part": pa.array([part], pa.int64()), "x": [x.tobytes()], "w": [w.tobytes()]})

    schema = "i long, part long, x binary, w binary"
    sums = rows.mapInArrow(run, schema)
    while parts > FAN:
        sums = sums.groupBy("i", F.floor(F.col("part") / FAN)).applyInArrow(_added, schema)
        parts = -(-parts // FAN)
    sums = sums.groupBy("i").applyInArrow(_added, schema).toArrow()
    out = start.rows()
    for i, x, w in zip(*(sums.column(c) for c in ("i", "x", "w"))):
        own, met = out[i.as_py() : i.as_py() + ROWS], np.frombuffer(w.as_buffer(), dtype=np.float32)
        mean = np.frombuffer(x.as_buffer(), dtype=np.float32).reshape(own.shape) / np.maximum(met, 1)[:, None]
        own[met > 0] = mean[met > 0]
    return start.from_rows(out)


def _with(vectors: np.ndarray, last: np.ndarray) -> np.ndarray:
    return np.concatenate([vectors, last[:, None]], axis=1).astype(np.float32)


def _chances(hidden: np.ndarray, vectors: np.ndarray, at: np.ndarray, small: bool) -> np.ndarray:
    """Log chances of the outcomes ``at`` (from 0) among all of ``vectors``, which end in their biases as ``hidden`` ends in
    ones; ``small``: no exponent needs a shift.

    Products have twice the digits of their factors: in single precision that of a row would depend on its place among the rows.
    """
    out = np.empty(len(at))
    step = max(1, CELLS // len(vectors))
    wide = np.ascontiguousarray(vectors.T, dtype=np.float64)
    room = np.empty((min(step, len(at)), len(vectors)))
    exps = np.empty(room.shape, dtype=np.float32)
    for a in range(0, len(at), step):
        goal = at[a : a + step]
        score, exp = room[: len(goal)], exps[: len(goal)]
        np.matmul(hidden[a : a + step].astype(np.float64), wide, out=score)
        own = score[np.arange(len(goal)), goal]
        if not small:
            top = score.max(axis=1)
            score -= top[:, None]
            own -= top
        exp[:] = score
        np.exp(exp, out=exp)
        out[a : a + step] = own - np.log(np.einsum("ij->i", exp))
    return out


class Scorer:
    """Normalised log10 chances of outcomes. That of a token follows from the model and the two tokens before it alone, whatever
    else is scored with it."""

    def __init__(self, model: Model) -> None:
        self.model = m = model
        one = np.ones(len(m.context), dtype=np.float32)
        self.one, self.two = _with(m.context * m.place[0], one), _with(m.context * m.place[1], one - 1)
        self.group, self.target = _with(m.group, m.group_bias), _with(m.target, m.bias)
        # no score can be larger than the product of the lengths and the bias; then exponents need no shift
        length = [float(np.sqrt((x[:, :-1] ** 2).sum(axis=1).max())) for x in (self.one, self.two, self.group, self.target)]
        bias = max(float(np.abs(m.group_bias).max()), float(np.abs(m.bias).max()))
        self.small = (length[0] + length[1]) * max(length[2:]) + bias < 70

    def __call__(self, one: np.ndarray, two: np.ndarray, target: np.ndarray) -> np.ndarray:
        m, out = self.model, np.empty(len(target))
        for z in range(0, len(target), SLICE):
            by = z + _order(target[z : z + SLICE])[0]
            goal = target[by]
            hidden = self.one.take(one[by], axis=0)
            hidden += self.two.take(two[by], axis=0)
            own = m.classes(goal)
            chance = _chances(hidden, self.group, own, self.small)
            starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            for lo, hi in zip(starts, np.r_[starts[1:], len(own)]):
                first, end = m.edge[own[lo]], m.edge[own[lo] + 1]
                if end - first > 1:
                    chance[lo:hi] += _chances(hidden[lo:hi], self.target[first:end], goal[lo:hi] - first, self.small)
            out[by] = chance
        return out / LN10


def score_texts(
    docs: DataFrame, training: Column, outcomes: int | None = None, head_size: int | None = None, size: int = SIZE, part_tokens: int = PART_TOKENS
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, n_known, train_tokens, base_score, score.

    Learns from the rows where ``training`` holds (null counts as yes). Tokens are words, A-Z in lower
    case, and one end for each text, so a null or empty text is its end alone. ``base_score`` is the
    add-one unigram score. Null and repeated ids come back as they are; without training rows every
    token is unknown; an empty table gives an empty one; other columns are ignored. Scores follow from
    the rows, however they lie in files and tasks. Tokens are told apart by 64-bit hashes. Beyond the head, counts meet tokens in a join by token.
    """
    learn = docs.filter(F.coalesce(training, F.lit(True)))
    counts = settle(token_counts(learn))
    head = head_of(counts, outcomes, head_size)
    model = train(learn, head, size, part_tokens)
    own = head.count[head.outcome >= 0].sum()
    rest_tokens, rest_types = int(head.total - own), head.distinct - head.outcomes

    def run(batches: Iterator[pa.RecordBatch]):
        one_thread()
        scorer = Scorer(model)
        row = TaskContext.get().partitionId() << 40
        for block in blocks(batches, lower=True):
            types, code, first = _tokens(block)
            outcome, count = _looked_up(head, types)
            target = outcome[code]
            one, two = _history(target, first, head.outcomes + 1)
            chance = scorer(one, two, target)
            known = count >= 0
            log = np.log10(np.maximum(count, 0) + 1.0)
            shared = outcome == head.outcomes
            each = [np.add.reduceat(v, first[:-1]) for v in (chance, log[code], np.where(shared, log, 0.0)[code], shared[code].astype(np.int64), known[code].astype(np.int64))]
            far = np.flatnonzero(~known[code])
            cuts = np.searchsorted(far, first)
            tail = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(types[code[far]].view(np.int64)))
            n = len(block)
            yield pa.RecordBatch.from_arrays(
                [pa.array(row + np.arange(n)), pa.array(block.ids), pa.array(np.diff(first)), *map(pa.array, each), tail],
                names=["row", "doc_id", "n_tokens", "chance", "log", "shared_log", "n_shared", "n_known", "tail"],
            )
            row += n

    schema = "row long, doc_id long, n_tokens long, chance double, log double, shared_log double, n_shared long, n_known long, tail array<long>"
    rows = settle(id_and_text(docs).mapInArrow(run, schema))
    far = rows.select("row", F.explode("tail").alias("h")).join(counts, "h")
    far = far.groupBy("row").agg(F.sum(F.log10(F.col("n") + 1)).alias("far_log"), F.count(F.lit(1)).alias("far_known"))
    more = F.coalesce("far_log", F.lit(0.0))
    every = rows.drop("tail").join(far, "row", "left")
    base = float(np.log10(head.total + head.distinct + 1))
    within = float(np.log10(rest_tokens + rest_types + 1))
    return every.select(
        real_id().alias("doc_id"),
        "n_tokens",
        (F.col("n_known") + F.coalesce("far_known", F.lit(0))).alias("n_known"),
        F.lit(head.total).cast("long").alias("train_tokens"),
        (F.col("log") + more - F.col("n_tokens") * base).alias("base_score"),
        (F.col("chance") + F.col("shared_log") + more - F.col("n_shared") * within).alias("score"),
    )
