"""Boosted trees whose rounds all run inside one job: tasks hold their rows as bins and add up histograms over sockets.

Spark's own trees take several jobs a tree, which cost more than the work as long as a tree is small.
"""

from __future__ import annotations

import hmac
import json
import socket
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bins of a feature, at most.
BINS = 64
#: L2 term of a leaf, and the least curvature of a leaf.
L2, LEAST = 1.0, 1e-3
#: Rounds without a better loss of the held-out rows that end the training; the best round is kept.
PATIENCE = 50
#: Share of the rows that a tree sees.
BAG = 0.8
#: Gradients are multiples of 1 / UNIT, so their sums are exact and do not depend on how rows are spread.
UNIT = float(1 << 30)
#: Rows from which another task is worth its messages.
TASK_ROWS = 10_000


@dataclass
class Trees:
    """Full binary trees, nodes in breadth-first order: a value above the threshold goes right; ``leaf`` holds log-odds."""

    base: float
    depth: int
    feature: list[list[int]]
    threshold: list[list[float]]
    leaf: list[list[float]]

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(text: str) -> Trees:
        return Trees(**json.loads(text))

    def probability(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of rows of features."""
        n, width = x.shape
        flat, at = np.ascontiguousarray(x).ravel(), np.arange(n) * width
        total = np.full(n, self.base)
        for f, t, v in zip(np.array(self.feature), np.array(self.threshold), np.array(self.leaf), strict=True):
            node = np.zeros(n, np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (flat[at + f[node]] > t[node])
            total += v[node - (2**self.depth - 1)]
        return 1 / (1 + np.exp(-total))

    def column(self, cols: list[str]) -> Column:
        """Probability of a row with the features ``cols``, none of them NULL."""

        @F.arrow_udf("double")
        def score(x: pa.Array) -> pa.Array:
            return pa.array(self.probability(x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), len(cols))))

        return score(F.array(*[F.col(c).cast("double") for c in cols]))


class Group:
    """The tasks that train one model; the first one adds up what all have and tells the others what it decided."""

    def __init__(self, ranks: int, secret: bytes):
        self.rank, self.peers, self.up = 0, [], None
        if ranks == 1:
            return
        context = BarrierTaskContext.get()
        self.rank = context.partitionId()
        host = context.getTaskInfos()[0].address.rsplit(":", 1)[0]
        if self.rank == 0:
            with socket.create_server(("", 0), backlog=ranks) as server:
                context.allGather(str(server.getsockname()[1]))
                server.settimeout(300)
                while len(self.peers) < ranks - 1:
                    peer = server.accept()[0]
                    self._ready(peer)
                    if hmac.compare_digest(self._read(peer, len(secret)), secret):
                        self.peers.append(peer)
        else:
            port = int(context.allGather("")[0])
            self.up = socket.create_connection((host, port), timeout=300)
            self._ready(self.up)
            self.up.sendall(secret)

    @staticmethod
    def _ready(s: socket.socket) -> None:
        s.settimeout(3600)
        s.setsockopt(socket.IPPROTO_TCP, socket.TCP_NODELAY, 1)

    @staticmethod
    def _read(s: socket.socket, size: int) -> bytes:
        out, view = bytearray(size), 0
        while view < size:
            got = s.recv_into(memoryview(out)[view:])
            if not got:
                raise ConnectionError("another task of the training ended")
            view += got
        return bytes(out)

    def add(self, a: np.ndarray) -> np.ndarray:
        """Sum over all tasks, in the first one; the others get their own back."""
        if self.up:
            self.up.sendall(np.ascontiguousarray(a).tobytes())
        for peer in self.peers:
            a = a + np.frombuffer(self._read(peer, a.nbytes), a.dtype).reshape(a.shape)
        return a

    def tell(self, a: np.ndarray) -> np.ndarray:
        """The first task's array, in all; the others pass one of the same shape."""
        for peer in self.peers:
            peer.sendall(np.ascontiguousarray(a).tobytes())
        return np.frombuffer(self._read(self.up, a.nbytes), a.dtype).reshape(a.shape) if self.up else a

    def close(self) -> None:
        for s in (*self.peers, *([self.up] if self.up else [])):
            s.close()


def _bag(key: np.ndarray, t: int, seed: int) -> np.ndarray:
    """Which rows tree ``t`` sees: by their key, whatever the order."""
    z = key ^ np.uint64((seed * 1_000_003 + t + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
    return (z ^ (z >> np.uint64(31))) < np.uint64(int(BAG * 2**64))


def _histogram(x: np.ndarray, slot: np.ndarray, slots: int, g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Sums of ``g`` and ``h`` (2, features, slots, bins) of rows in bins ``x`` (features, rows)."""
    out = np.empty((2, len(x), slots, BINS))
    at = slot * BINS
    for j, bins in enumerate(x):
        i = at + bins
        for k, w in enumerate((g, h)):
            out[k, j] = np.bincount(i, w, slots * BINS).reshape(slots, BINS)
    return out


def _splits(hist: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(feature, bin and smaller side of each node's best split, sums of both children (2, nodes, 2)). Feature -1: none, all rows go left."""
    c = np.cumsum(hist, axis=-1)
    left, total = c, c[..., -1:]
    right = total - left
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = left[0] ** 2 / (left[1] + L2) + right[0] ** 2 / (right[1] + L2) - total[0] ** 2 / (total[1] + L2)
    gain = np.where((left[1] >= LEAST) & (right[1] >= LEAST), gain, -1.0)
    nodes = hist.shape[2]
    best = gain.transpose(1, 0, 2).reshape(nodes, -1)
    at = best.argmax(axis=1)
    f, b, every = at // BINS, at % BINS, np.arange(nodes)
    found = best[every, at] > 1e-6
    # Every feature's bins add up to the same totals: those of the first one serve nodes without a split.
    whole = total[:, 0, :, 0]
    l_sum = np.where(found, left[:, f, every, b], whole)
    r_sum = whole - l_sum
    return np.stack([np.where(found, f, -1), b, (r_sum[1] <= l_sum[1]).astype(np.int64)], axis=1), np.stack([l_sum, r_sum], axis=2)


def boost(x: np.ndarray, y: np.ndarray, valid: np.ndarray, key: np.ndarray, edges: list[np.ndarray], base: float, held_out: bool, rounds: int, depth: int, step: float, seed: int, group: Group) -> Trees:
    """Up to ``rounds`` trees of rows in bins ``x`` (features, rows); complete in the first task of the group.

    Newton steps of the logistic loss; the first tree counts whole, the others by ``step``.
    """
    order = np.argsort(valid, kind="stable")
    x, y, key = np.ascontiguousarray(x[:, order]), y[order], key[order]
    n, seen = len(y), len(y) - int(valid.sum())
    flat, row = x.ravel(), np.arange(n)
    score = np.full(n, base)
    out = Trees(base, depth, [], [], [])
    best, best_t = np.inf, 0
    for t in range(rounds + 1):
        late = score[seen:]
        loss = group.add(np.array([np.rint((np.logaddexp(0, late) - y[seen:] * late) * (1 << 20)).sum()]))[0]
        if loss < best:
            best, best_t = loss, t
        if group.tell(np.array([t == rounds or (held_out and t - best_t >= PATIENCE)]))[0]:
            break
        p = 1 / (1 + np.exp(-score[:seen]))
        bag = np.flatnonzero(_bag(key[:seen], t, seed))
        g, h = (np.rint(v[bag] * UNIT) / UNIT for v in (p - y[:seen], p * (1 - p)))
        xb = x[:, bag]
        node = np.zeros(n, np.int64)
        features, bins = [], []
        hist = small = None
        for level in range(depth):
            nodes = 2**level
            if level == 0:
                hist = group.add(_histogram(xb, node[bag], 1, g, h))
            else:
                at = node[bag]
                pick = np.flatnonzero((at & 1) == small[at >> 1])
                part = group.add(_histogram(xb[:, pick], at[pick] >> 1, nodes // 2, g[pick], h[pick]))
                if group.rank == 0:
                    both = np.empty((*hist.shape[:2], nodes, BINS))
                    i = np.arange(nodes // 2)
                    both[:, :, 2 * i + small], both[:, :, 2 * i + 1 - small] = part, hist - part
                    hist = both
            split, sums = _splits(hist) if group.rank == 0 else (np.empty((nodes, 3), np.int64), None)
            f, b, small = group.tell(split).T
            features.append(f)
            bins.append(b)
            right = (f >= 0)[node] & (flat[np.maximum(f, 0)[node] * n + row] > b[node])
            node = 2 * node + right
        value = np.empty(2**depth)
        if group.rank == 0:
            value = (-sums[0] / (sums[1] + L2)).ravel() * (1.0 if t == 0 else step)
        value = group.tell(value)
        score += value[node]
        f, b = np.concatenate(features), np.concatenate(bins)
        out.feature.append(np.maximum(f, 0).tolist())
        out.threshold.append([float(edges[i][k]) if i >= 0 else np.inf for i, k in zip(f, b, strict=True)])
        out.leaf.append(value.tolist())
    if held_out:
        out.feature, out.threshold, out.leaf = (v[:best_t] for v in (out.feature, out.threshold, out.leaf))
    return out


def slots(spark: SparkSession) -> int:
    """Tasks that can run at the same time. Tasks of a group must; where executors come and go, Spark does not allow it."""
    if (spark.conf.get("spark.dynamicAllocation.enabled", None) or "false").lower() == "true":
        return 1
    sc = spark.sparkContext._jsc.sc()
    return max(1, sc.maxNumConcurrentTasks(sc.resourceProfileManager().defaultResourceProfile()))


def training(edges: list[np.ndarray], base: float, held_out: bool, rounds: int, depth: int, step: float, seed: int, ranks: int, secret: bytes) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What every task does with its batches (the features, then ``_y``, ``_valid``, ``_key``); the first one yields the model."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, rest = [np.empty((len(edges), 0), np.uint8)], [(np.empty(0), np.empty(0, bool), np.empty(0, np.int64))]
        for b in batches:
            x.append(np.stack([np.searchsorted(e, b.column(j).to_numpy(zero_copy_only=False)).astype(np.uint8) for j, e in enumerate(edges)]))
            rest.append(tuple(b.column(c).to_numpy(zero_copy_only=False) for c in ("_y", "_valid", "_key")))
        y, valid, key = (np.concatenate(v) for v in zip(*rest, strict=True))
        bins = np.concatenate(x, axis=1)
        x.clear()
        group = Group(ranks, secret)
        try:
            model = boost(bins, y, valid, key.astype(np.int64).view(np.uint64), edges, base, held_out, rounds, depth, step, seed, group)
        finally:
            group.close()
        if group.rank == 0:
            yield pa.record_batch({"model": [model.to_json()]})

    return run


def trained(rows: DataFrame, work: Callable, ranks: int) -> Trees:
    """The model of ``training`` over ``rows``, in ``ranks`` tasks."""
    got = rows.repartition(ranks).mapInArrow(work, "model string", barrier=ranks > 1).collect()
    return Trees.from_json(got[0]["model"])
