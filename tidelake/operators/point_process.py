"""Point-process models of event sequences, trained on all executors at once.

Sequences (marks, times, features and labels of a key's events, cut at ``width``) are written once. In each step every
task sums the loss and its gradient over padded batches of its sequences; the sums are added up in a second, narrower
stage, and the driver, which holds nothing but the parameters, takes an Adam step. So one step reads all sequences
once, whatever their number, and moves a few times the parameters' size.

Two models: a gated recurrent net whose state gives the probability that an event is unsafe, and one in continuous
time, whose cell decays between events and also gives the intensity at which events come. The latter's integral
between events is estimated at points drawn from a hash of sequence, event and sample, one in each stratum, so a loss
is the same however the data are dealt.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelake.operators.autodiff import Node, gradients
from tidelake.session import checkpointed

#: Sequences of a padded batch, and partial sums that the driver gets at most.
BATCH, SUMS = 128, 32


def sequences(rows: DataFrame, key: str, order: list[str], ts: str, mark: Column, features: list[str], label: Column, width: int = 128) -> DataFrame:
    """One row for each ``width`` events of a key in order: key, seq, ids (first order column), marks, waits (ms), features, labels.

    ``mark`` counts from 1; 0 is for padding. A list holds at most ``width`` events.
    """
    by = Window.partitionBy(key).orderBy(*order)
    placed = rows.withColumns({"_n": F.row_number().over(by) - 1, "_wait": F.greatest(F.coalesce(F.col(ts) - F.lag(ts).over(by), F.lit(0)), F.lit(0)).cast("double")})
    event = F.struct(F.col("_n"), F.col(order[0]).cast("long").alias("id"), mark.cast("int").alias("mark"), F.col("_wait").alias("wait"), F.array(*[F.col(f).cast("double") for f in features]).cast("array<double>").alias("f"), label.cast("double").alias("y"))
    cut = placed.groupBy(key, F.floor(F.col("_n") / width).alias("seq")).agg(F.array_sort(F.collect_list(event)).alias("e"))
    return cut.select(key, "seq", F.xxhash64(key, "seq").alias("draw"), *[F.col(f"e.{c}").alias(name) for c, name in (("id", "ids"), ("mark", "marks"), ("wait", "waits"), ("f", "features"), ("y", "labels"))])


@dataclass
class Batch:
    """Padded arrays, sequences by events."""

    marks: np.ndarray
    waits: np.ndarray
    extra: np.ndarray
    labels: np.ndarray
    mask: np.ndarray
    draws: np.ndarray

    @classmethod
    def of(cls, part: pa.RecordBatch, n_features: int) -> Batch:
        marks, waits, features, labels = (part[c].to_pylist() for c in ("marks", "waits", "features", "labels"))
        n, longest = len(marks), max(map(len, marks))
        out = cls(np.zeros((n, longest), np.int64), np.zeros((n, longest)), np.zeros((n, longest, 1 + n_features)), np.zeros((n, longest)), np.zeros((n, longest)), part["draw"].to_numpy(zero_copy_only=False).astype(np.uint64))
        for i, (m, w, f, y) in enumerate(zip(marks, waits, features, labels, strict=True)):
            out.marks[i, : len(m)], out.waits[i, : len(m)], out.labels[i, : len(m)], out.mask[i, : len(m)] = m, w, y, 1
            out.extra[i, : len(m), 0] = np.log1p(w)
            if n_features:
                out.extra[i, : len(m), 1:] = np.nan_to_num(np.array(f, np.float64))
        return out


def _batches(it: Iterator[pa.RecordBatch], n_features: int) -> Iterator[tuple[pa.RecordBatch, Batch]]:
    for batch in it:
        for a in range(0, len(batch), BATCH):
            yield batch.slice(a, BATCH), Batch.of(batch.slice(a, BATCH), n_features)


def _drawn(*shapes: tuple[int, ...], seed: int) -> list[np.ndarray]:
    rng = np.random.default_rng(seed)
    return [rng.normal(0, 1 / np.sqrt(max(1, s[0])), s) for s in shapes]


class Gated:
    """A gated recurrent net: state to probability of an unsafe event."""

    def __init__(self, marks: int, n_features: int = 0, size: int = 16, embed: int = 8, seed: int = 42):
        self.marks, self.n_features, self.size, self.embed, self.seed = marks, n_features, size, embed, seed

    def start(self) -> dict[str, np.ndarray]:
        h, e = self.size, self.embed
        emb, we, wx, u, head = _drawn((self.marks + 1, e), (e, 3 * h), (1 + self.n_features, 3 * h), (h, 3 * h), (h, 1), seed=self.seed)
        return {"emb": emb, "we": we, "wx": wx * 0.1, "u": u, "b": np.zeros((1, 3 * h)), "head": head, "head_b": np.zeros((1, 1))}

    def run(self, p: dict[str, Node], batch: Batch) -> tuple[Node, np.ndarray]:
        """Summed loss over real events, and each event's probability."""
        h, n = self.size, len(batch.marks)
        state, loss, out = Node(np.zeros((n, h))), Node(0.0), np.zeros(batch.mask.shape)
        for t in range(batch.mask.shape[1]):
            real = batch.mask[:, t : t + 1]
            own, old = p["emb"].rows(batch.marks[:, t]) @ p["we"] + Node(batch.extra[:, t]) @ p["wx"] + p["b"], state @ p["u"]
            keep = (own.cols(0, h) + old.cols(0, h)).sigmoid()
            reset = (own.cols(h, 2 * h) + old.cols(h, 2 * h)).sigmoid()
            new = (own.cols(2 * h, 3 * h) + reset * old.cols(2 * h, 3 * h)).tanh()
            state = (new + keep * (state - new)) * real + state * (1 - real)
            logit = state @ p["head"] + p["head_b"]
            loss = loss + ((logit.softplus() - logit * batch.labels[:, t : t + 1]) * real).sum()
            out[:, t] = logit.sigmoid().value[:, 0]
        return loss, out


class Continuous:
    """A cell that decays between events: probability of an unsafe event, and intensity of events, just before each."""

    def __init__(self, marks: int, n_features: int = 0, size: int = 16, embed: int = 8, samples: int = 4, time_ms: float = 1000.0, seed: int = 42):
        self.marks, self.n_features, self.size, self.embed, self.samples, self.time_ms, self.seed = marks, n_features, size, embed, samples, time_ms, seed

    def start(self) -> dict[str, np.ndarray]:
        h, e = self.size, self.embed
        emb, we, wx, u, rate, head = _drawn((self.marks + 1, e), (e, 7 * h), (1 + self.n_features, 7 * h), (h, 7 * h), (h, 1), (h, 1), seed=self.seed)
        return {"emb": emb, "we": we, "wx": wx * 0.1, "u": u, "b": np.zeros((1, 7 * h)), "rate": rate, "rate_b": np.zeros((1, 1)), "head": head, "head_b": np.zeros((1, 1))}

    def points(self, batch: Batch, t: int) -> np.ndarray:
        """(sequences, samples) in [0, 1): one point in each stratum, from a hash."""
        k = np.arange(self.samples, dtype=np.uint64)
        x = batch.draws[:, None] + np.uint64((t + 1) * 0x9E3779B97F4A7C15 % 2**64) + (k + np.uint64(1)) * np.uint64(0xD1B54A32D192ED03)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        return (k + ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) / 2.0**53) / self.samples

    def _intensity(self, p: dict[str, Node], hidden: Node) -> Node:
        return (hidden @ p["rate"] + p["rate_b"]).softplus() + 1e-8

    def run(self, p: dict[str, Node], batch: Batch) -> tuple[Node, np.ndarray]:
        loss, out, _ = self.parts(p, batch)
        return loss, out

    def parts(self, p: dict[str, Node], batch: Batch) -> tuple[Node, np.ndarray, np.ndarray]:
        """Summed loss, probabilities, and each event's share of the intensity's integral."""
        h, n = self.size, len(batch.marks)
        cell = target = gate = Node(np.zeros((n, h)))
        decay, loss = Node(np.ones((n, h))), Node(0.0)
        out, integral = np.zeros(batch.mask.shape), np.zeros(batch.mask.shape)
        for t in range(batch.mask.shape[1]):
            real, wait = batch.mask[:, t : t + 1], batch.waits[:, t : t + 1] / self.time_ms
            at = lambda s: target + (cell - target) * (decay * -s).exp()  # noqa: E731, B023
            now = at(wait)
            hidden = gate * now.tanh()
            rate, logit = self._intensity(p, hidden), hidden @ p["head"] + p["head_b"]
            points, mean = self.points(batch, t), Node(np.zeros((n, 1)))
            for k in range(self.samples):
                mean = mean + self._intensity(p, gate * at(wait * points[:, k : k + 1]).tanh()) * (1 / self.samples)
            passed = mean * wait
            loss = loss + ((logit.softplus() - logit * batch.labels[:, t : t + 1] - rate.log() + passed) * real).sum()
            out[:, t], integral[:, t] = logit.sigmoid().value[:, 0], passed.value[:, 0] * real[:, 0]
            x = p["emb"].rows(batch.marks[:, t]) @ p["we"] + Node(batch.extra[:, t]) @ p["wx"] + hidden @ p["u"] + p["b"]
            into, forget, gate_new, into_target, forget_target = (x.cols(k * h, (k + 1) * h).sigmoid() for k in range(5))
            seen, decay_new = x.cols(5 * h, 6 * h).tanh(), x.cols(6 * h, 7 * h).softplus()
            new = (forget * now + into * seen, forget_target * target + into_target * seen, gate_new, decay_new)
            cell, target, gate, decay = (a * real + b * (1 - real) for a, b in zip(new, (cell, target, gate, decay), strict=True))
        return loss, out, integral


Model = Gated | Continuous


def loss_and_gradient(model: Model, params: dict[str, np.ndarray], batch: Batch) -> tuple[float, dict[str, np.ndarray]]:
    p = {k: Node(x) for k, x in params.items()}
    loss, _ = model.run(p, batch)
    return float(loss.value), gradients(loss, p)


def _flat(grads: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([grads[k].ravel() for k in sorted(grads)])


_SUMS = "loss double, events double, gradient binary"


def _sum_row(loss: float, events: float, gradient: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array([loss]), pa.array([events]), pa.array([gradient.tobytes()], pa.binary())], ["loss", "events", "gradient"])


def total_gradient(seqs: DataFrame, model: Model, params: dict[str, np.ndarray]) -> tuple[float, np.ndarray]:
    """Mean loss per event and its gradient over all sequences."""

    def partial(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loss, events, gradient = 0.0, 0.0, 0.0
        for _, batch in _batches(it, model.n_features):
            own, grads = loss_and_gradient(model, params, batch)
            loss, events, gradient = loss + own, events + batch.mask.sum(), gradient + _flat(grads)
        if events:
            yield _sum_row(loss, events, gradient)

    def added(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loss, events, gradient = 0.0, 0.0, 0.0
        for batch in it:
            for own, n, g in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                loss, events, gradient = loss + own, events + n, gradient + np.frombuffer(g)
        if events:
            yield _sum_row(loss, events, gradient)

    sums = seqs.mapInArrow(partial, _SUMS)
    if seqs.rdd.getNumPartitions() > SUMS:
        sums = sums.repartition(SUMS).mapInArrow(added, _SUMS)
    rows = sums.collect()  # at most SUMS
    events = sum(r["events"] for r in rows)
    if not events:
        raise ValueError("no events to train on")
    return sum(r["loss"] for r in rows) / events, sum(np.frombuffer(r["gradient"]) for r in rows) / events


def fit(seqs: DataFrame, model: Model, steps: int = 30, rate: float = 0.03) -> tuple[dict[str, np.ndarray], list[float]]:
    """Parameters after ``steps`` over all sequences, and the mean loss before each."""
    seqs, params, losses = checkpointed(seqs), model.start(), []
    first, second = 0.0, 0.0
    for step in range(1, steps + 1):
        loss, gradient = total_gradient(seqs, model, params)
        losses.append(loss)
        first, second = 0.9 * first + 0.1 * gradient, 0.999 * second + 0.001 * gradient**2
        move, at = rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8), 0
        for k in sorted(params):
            size = params[k].size
            params[k] = params[k] - move[at : at + size].reshape(params[k].shape)
            at += size
    return params, losses


def scores(seqs: DataFrame, key: str, model: Model, params: dict[str, np.ndarray]) -> DataFrame:
    """key, id and p, the probability that the event is unsafe, of every event."""

    def scored(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, batch in _batches(it, model.n_features):
            _, p = model.run({k: Node(x) for k, x in params.items()}, batch)
            lengths = batch.mask.sum(1).astype(np.int64)
            yield pa.record_batch([part[key].take(pa.array(np.repeat(np.arange(len(lengths)), lengths))), part["ids"].flatten(), pa.array(p[batch.mask > 0])], [key, "id", "p"])

    return seqs.mapInArrow(scored, f"`{key}` {seqs.schema[key].dataType.simpleString()}, id bigint, p double")
