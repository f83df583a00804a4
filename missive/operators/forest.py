"""Random forest as Spark jobs (M7): work and memory follow the rows, not rows times nodes.

Spark's own learner passes over all rows for every few thousand nodes and keeps
every row as a dense array; text trees have nodes in proportion to the rows, so
its time grows with their square. Here rows are held in blocks of binned sparse
entries. Nodes of more than ``NODE_ENTRIES`` entries are split level by level
from sums over all blocks. The rows of each smaller node are gathered once, by
tree and node, and its subtree is grown where they are. Subtrees are a table;
the driver holds the bin borders and the few large nodes.

The learner is the same: bootstrap by Poisson counts, weighted Gini gain, a new
random subset of sqrt(columns) features for each node, at most ``BINS`` bins a
feature, leaves where a node is pure, nothing gains or the depth is reached,
and the probability is the mean over trees of the leaves' weighted class share.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from missive.operators import parts as P
from missive.session import materialise

BINS = 32
#: Entries (features of rows) of a block, of a node that one task finishes, and of the nodes that share a task.
BLOCK_ENTRIES, NODE_ENTRIES = 1_000_000, 4_000_000
#: Large nodes whose sums one job takes.
NODES_AT_ONCE = 1000
#: Share of the rows in a bootstrap, and the least share of a node's weight that counts as some.
BAGGED, SOME = 1 - math.exp(-1), 1e-9

_ROWS = "block int, y binary, w binary, ends binary, at binary, x binary"
_SENT = "bucket int, tree int, slot int, n long, y binary, w binary, ends binary, at binary, x binary"
_SUBTREE = "bucket int, tree int, slot int, feature array<int>, bin array<int>, left array<int>, right array<int>, p array<double>"


def _entries(df: DataFrame) -> DataFrame:
    """``_at`` and ``_x``: the columns and values of ``features``, sparse or dense."""
    v = F.unwrap_udt(F.col("features"))
    dense = F.when(F.size(v.getField("values")) > 0, F.sequence(F.lit(0), F.size(v.getField("values")) - 1)).otherwise(F.array().cast("array<int>"))
    return df.withColumn("_at", F.coalesce(v.getField("indices"), dense)).withColumn("_x", v.getField("values"))


def _flat(table: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each row's entries end, their columns and their values."""
    lists = {c: pa.chunked_array(table[c]) if not isinstance(table[c], pa.ChunkedArray) else table[c] for c in ("_at", "_x")}
    at, x = (np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in lists[k].chunks]) for k in ("_at", "_x"))
    lengths = np.concatenate([np.diff(c.offsets.to_numpy()) for c in lists["_at"].chunks])
    return np.r_[0, np.cumsum(lengths)].astype(np.int64), at, x


def _kind(zero: np.ndarray) -> type:
    """The type of column numbers in binned rows."""
    return np.uint16 if len(zero) <= 1 << 16 else np.int32


def _taken(ends: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The entries of some rows, and where each row's end among them."""
    lengths = (ends[1:] - ends[:-1])[rows]
    new = np.r_[0, np.cumsum(lengths)]
    return np.arange(new[-1]) + np.repeat(ends[:-1][rows] - new[:-1], lengths), new


@dataclass
class _Bins:
    """Borders of the bins of each column; a value is in the bin of the first border that is not less."""
    borders: list[np.ndarray]

    @property
    def zero(self) -> np.ndarray:
        """The bin of the entries that are not there."""
        return np.array([np.searchsorted(b, 0.0) for b in self.borders], np.int64)

    def of(self, at: np.ndarray, x: np.ndarray) -> np.ndarray:
        order = np.argsort(at, kind="stable")
        starts, out = np.searchsorted(at[order], np.arange(len(self.borders) + 1)), np.zeros(len(at), np.uint8)
        for j in np.flatnonzero(starts[1:] > starts[:-1]):
            here = order[starts[j]:starts[j + 1]]
            out[here] = np.searchsorted(self.borders[j], x[here])
        return out


def _points(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Of each column of a block: evenly spaced values from the least to the greatest, and how many each stands for."""
    for i in range(rows.num_rows):
        at, x = (np.frombuffer(rows[c][i].as_py(), t) for c, t in (("at", np.int32), ("x", np.float64)))
        order = np.lexsort((x, at))
        at, x = at[order], x[order]
        starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else np.zeros(0, np.int64)
        found = [x[a:e] if e - a <= BINS else x[a + np.linspace(0, e - a - 1, BINS).astype(np.int64)] for a, e in zip(starts, np.r_[starts[1:], len(at)])]
        n = [(e - a) / len(f) for f, a, e in zip(found, starts, np.r_[starts[1:], len(at)])]
        yield pa.record_batch({"j": pa.array(at[starts], pa.int32()), "v": pa.array(found, pa.list_(pa.float64())), "n": pa.array(n, pa.float64())})


def _borders(rows: pa.Table) -> pa.Table:
    """The borders of each column: zero, and even shares of the values that are not."""
    at = rows["j"].to_numpy()
    lengths = np.concatenate([np.diff(c.offsets.to_numpy()) for c in rows["v"].chunks])
    x, n = np.concatenate([c.flatten().to_numpy() for c in rows["v"].chunks]), np.repeat(rows["n"].to_numpy(), lengths)
    at = np.repeat(at, lengths)
    order = np.lexsort((x, at))
    at, x, n = at[order], x[order], n[order]
    starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    out = []
    for a, e in zip(starts, np.r_[starts[1:], len(at)]):
        v, upto = x[a:e], np.cumsum(n[a:e])
        even = v[np.minimum(np.searchsorted(upto, upto[-1] * np.arange(1, BINS - 2) / (BINS - 2)), len(v) - 1)]
        found = np.unique(np.r_[even, 0.0, v[v < 0][-1:]])
        out.append(found[found < max(v[-1], 0.0)])
    return pa.table({"j": pa.array(at[starts], pa.int32()), "b": pa.array(out, pa.list_(pa.float64()))})


def _split(sums: np.ndarray, total: np.ndarray) -> tuple[int, int, np.ndarray] | None:
    """The feature and bin whose split gains most, and the sums to its left; ``sums`` by feature, bin and (weight of 0, of 1, ...)."""
    left = np.cumsum(sums, axis=1)[:, :-1]
    a, b = left[..., 0], left[..., 1]
    c, d = total[0] - a, total[1] - b
    lw, rw, whole = a + b, c + d, total[0] + total[1]
    some = (lw > SOME * whole) & (rw > SOME * whole)
    pure = np.where(some, (a * a + b * b) / np.where(some, lw, 1.0) + (c * c + d * d) / np.where(some, rw, 1.0), 0.0)
    best = int(np.argmax(pure))
    if pure.flat[best] - (total[0] ** 2 + total[1] ** 2) / whole <= SOME * whole:
        return None
    f, t = divmod(best, pure.shape[1])
    return f, t, left[f, t]


class _Block:
    """A block of rows, by row and by column."""

    def __init__(self, block: int, y, w, ends, at, x, zero: np.ndarray):
        self.block, self.zero = block, zero
        self.y, self.w = np.frombuffer(y, np.uint8), np.frombuffer(w, np.float64)
        self.ends, self.at, self.x = np.frombuffer(ends, np.int64), np.frombuffer(at, _kind(zero)), np.frombuffer(x, np.uint8)
        self.n = len(self.ends) - 1

    def by_column(self) -> "_Block":
        order = np.argsort(self.at, kind="stable")
        self.rows = np.repeat(np.arange(self.n), np.diff(self.ends))[order]
        self.bins = self.x[order]
        self.starts = np.searchsorted(self.at[order], np.arange(len(self.zero) + 1))
        return self

    def bag(self, tree: int, seed: int) -> np.ndarray:
        return np.random.default_rng((seed, self.block, tree)).poisson(1.0, self.n)

    def slots(self, splits: list) -> np.ndarray:
        """The slot each row comes to: the left child keeps its parent's, the right one has its own."""
        slot = np.zeros(self.n, np.int32)
        for s, f, t, right in splits:
            rows, bins = (v[self.starts[f]:self.starts[f + 1]] for v in (self.rows, self.bins))
            if self.zero[f] <= t:
                go = rows[bins > t]
                slot[go[slot[go] == s]] = right
            else:
                go = slot == s
                go[rows[bins <= t]] = False
                slot[go] = right
        return slot

    def sums(self, inside: np.ndarray, of: np.ndarray, features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums of ``of`` over the rows inside, by feature and bin, and in all."""
        at = np.concatenate([np.arange(self.starts[f], self.starts[f + 1]) for f in features])
        key = np.repeat(np.arange(len(features)), self.starts[features + 1] - self.starts[features]) * BINS + self.bins[at]
        rows = self.rows[at]
        here = np.flatnonzero(inside[rows])
        key, rows = key[here], rows[here]
        total = of[inside].sum(axis=0)
        out = np.stack([np.bincount(key, of[rows, c], len(features) * BINS) for c in range(of.shape[1])], axis=-1)
        out = out.reshape(len(features), BINS, -1).astype(np.float64)   # counts of nothing are integers
        out[np.arange(len(features)), self.zero[features]] += total - out.sum(axis=1)
        return out, total


def _blocks(batches: Iterator[pa.RecordBatch], zero: np.ndarray) -> Iterator[_Block]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield _Block(*(batch[c][i].as_py() for c in ("block", "y", "w", "ends", "at", "x")), zero)


def _grow(y: np.ndarray, w: np.ndarray, ends: np.ndarray, at: np.ndarray, x: np.ndarray, zero: np.ndarray, tries: int, levels: int, rng) -> tuple:
    """The subtree of a node from its rows (weights with bootstrap counts): feature (-1: leaf), bin, left, right and share of class 1."""
    feature, bin_, left, right, p = [], [], [], [], []
    slot_of = np.full(len(zero), -1, np.int16)
    both = np.stack([w * (y == 0), w * (y == 1)])
    todo = [(0, 0, both, np.repeat(np.arange(len(y), dtype=np.int32), np.diff(ends)), at, x)]
    while todo:
        level, parent, both, row, at, x = todo.pop()
        me, total = len(feature), both.sum(axis=1)
        feature.append(-1), bin_.append(0), left.append(-1), right.append(-1)
        p.append(float(total[1] / total.sum()) if total.sum() > 0 else 0.0)
        if parent:   # the left child comes right after its parent
            right[parent - 1] = me
        if level >= levels or not total.all():
            continue
        tried = rng.choice(len(zero), tries, replace=False)
        slot_of[tried] = np.arange(tries, dtype=np.int16)
        slot = slot_of[at]
        slot_of[tried] = -1
        here = np.flatnonzero(slot >= 0)
        key, rows = slot[here].astype(np.int64) * BINS + x[here], row[here]
        sums = np.stack([np.bincount(key, c[rows], tries * BINS) for c in both], axis=-1).reshape(tries, BINS, 2).astype(np.float64)
        sums[np.arange(tries), zero[tried]] += total - sums.sum(axis=1)
        found = _split(sums, total)
        if found is None:
            continue
        f, t = int(tried[found[0]]), found[1]
        go = np.full(both.shape[1], zero[f] > t)
        mine = here[slot[here] == found[0]]
        go[row[mine]] = x[mine] > t
        feature[me], bin_[me], left[me] = f, t, me + 1
        place = (np.where(go, np.cumsum(go), np.cumsum(~go)) - 1).astype(np.int32)
        on = go[row]
        for parent, rows, entries in ((me + 1, go, on), (0, ~go, ~on)):   # the last is grown first
            todo.append((level + 1, parent, both[:, rows], place[row[entries]], at[entries], x[entries]))
    return feature, bin_, left, right, p


def _joined(sent: list[dict], zero: np.ndarray) -> tuple[np.ndarray, ...]:
    """The rows that several blocks sent for a node, as one."""
    ends = [_unpacked(s["ends"], np.int64) for s in sent]
    shift, kind = np.r_[0, np.cumsum([e[-1] for e in ends])], _kind(zero)
    planes = [_unpacked(s["at"], np.uint8).reshape(np.dtype(kind).itemsize, -1) for s in sent]
    at = np.concatenate([np.cumsum(np.ascontiguousarray(p.T).view(kind).ravel(), dtype=kind) for p in planes])
    return np.r_[0, np.concatenate([e[1:] + a for e, a in zip(ends, shift)])], at, np.concatenate([_unpacked(s["x"], np.uint8) for s in sent])


def _nodes(table: pa.Table) -> Iterator[tuple[tuple[int, int], list[dict]]]:
    """The rows sent for each tree and node."""
    trees, slots = table["tree"].to_numpy(), table["slot"].to_numpy()
    order = np.lexsort((slots, trees))
    starts = np.flatnonzero(np.r_[True, (np.diff(trees[order]) != 0) | (np.diff(slots[order]) != 0)])
    for here in np.split(order, starts[1:]):
        yield (int(trees[here[0]]), int(slots[here[0]])), table.take(pa.array(here)).to_pylist()


def _send(block: _Block, bucket: int, tree: int, slot: int, rows: np.ndarray, y: np.ndarray, w: np.ndarray) -> dict:
    entries, ends = _taken(block.ends, rows)
    at = np.diff(block.at[entries], prepend=block.at.dtype.type(0))   # steps are small; what wraps around comes back
    planes = np.ascontiguousarray(at.view(np.uint8).reshape(len(at), at.itemsize).T)
    return {"bucket": bucket, "tree": tree, "slot": slot, "n": len(at) + len(y), "y": _packed(y), "w": _packed(w),
            "ends": _packed(ends.astype(np.int64)), "at": _packed(planes), "x": _packed(block.x[entries])}


def _packed(values: np.ndarray) -> bytes:
    """Numbers for a shuffle: a row is sent to many trees."""
    return values.nbytes.to_bytes(8, "little") + pa.compress(values.tobytes(), "zstd", asbytes=True)


def _unpacked(sent: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(pa.decompress(sent[8:], int.from_bytes(sent[:8], "little"), "zstd", asbytes=True), kind)


_SENT_ARROW = pa.schema([("bucket", pa.int32()), ("tree", pa.int32()), ("slot", pa.int32()), ("n", pa.int64()), *((c, pa.binary()) for c in ("y", "w", "ends", "at", "x"))])


def _walk(nodes: dict, ends: np.ndarray, at: np.ndarray, x: np.ndarray, zero: np.ndarray) -> np.ndarray:
    """The share of class 1 in the leaf of each row."""
    feature, bin_, left, right = (np.asarray(nodes[c], np.int64) for c in ("feature", "bin", "left", "right"))
    n, size = len(ends) - 1, len(zero)
    keys = np.repeat(np.arange(n), np.diff(ends)) * size + at
    now, rows = np.zeros(n, np.int64), np.arange(n)
    while len(rows := rows[feature[now[rows]] >= 0]):
        f = feature[now[rows]]
        key = rows * size + f
        place = np.searchsorted(keys, key)
        held = np.zeros(len(key), bool)
        held[place < len(keys)] = keys[place[place < len(keys)]] == key[place < len(keys)]
        value = zero[f].copy()
        value[held] = x[place[held]]
        now[rows] = np.where(value > bin_[now[rows]], right[now[rows]], left[now[rows]])
    return np.asarray(nodes["p"], np.float64)[now]


@dataclass
class Forest:
    """A fitted forest: borders, large nodes, and a table of subtrees in ``buckets`` buckets.

    ``splits`` has for each tree (slot, feature, bin, right slot), ``ends`` what a slot
    ends in: a share of class 1 (leaf) or the bucket of its subtree."""
    bins: _Bins
    splits: list[list]
    ends: list[dict]
    buckets: int
    subtrees: DataFrame

    @classmethod
    def fit(cls, train: DataFrame, trees: int, depth: int, seed: int, weight_col: str = "weight", node_entries: int = NODE_ENTRIES,
            block_entries: int = BLOCK_ENTRIES) -> "Forest":
        rows = materialise(_entries(train.select(F.col("y").cast("double"), F.col(weight_col).cast("double").alias("w"), "features"))
                           .withColumn("_size", F.coalesce(F.unwrap_udt("features").getField("size"), F.size("_x"))).drop("features")
                           .withColumn("_deal", F.xxhash64(F.monotonically_increasing_id())), "forest-rows")
        n, load, size = rows.agg(F.count(F.lit(1)), F.sum(F.size("_x") + 1), F.max("_size")).first()
        if not n:
            raise ValueError("a forest needs training rows")
        blocks = max(1, math.ceil(load / block_entries))
        dealt = rows.withColumn("_part", F.pmod("_deal", F.lit(blocks)).cast("int"))
        raw = materialise(P.by_part(dealt, blocks).applyInArrow(_as_block, _ROWS), "forest-blocks")
        bins = _fit_bins(raw, size)
        binned = materialise(raw.mapInArrow(_binner(bins), _ROWS), "forest-binned")
        limit = max(1, int(node_entries * n / load))
        splits, ends, open_ = _grow_large(binned, bins.zero, n, limit, trees, depth, seed)
        buckets = _deal_nodes(open_, limit, ends)
        grown = binned.mapInArrow(_gatherer(bins.zero, splits, ends, seed), _SENT)
        levels = {(t, s): depth - d for t, s, d, _ in open_}
        made = P.by_part(grown.withColumn("_part", F.col("bucket")), buckets).applyInArrow(_finisher(bins.zero, levels, seed), _SUBTREE)
        return cls(bins, splits, ends, buckets, materialise(made, "forest-subtrees"))

    def probability(self, df: DataFrame, out_col: str = "p") -> DataFrame:
        """Adds the probability of class 1. Rows go to the subtrees; no task holds the forest, and a subtree that many rows
        come to goes to several tasks."""
        rows = materialise(df.withColumn("_row", F.monotonically_increasing_id()), "forest-scored-rows")
        entries, where = _entries(rows.select("_row", "features")).drop("features"), (self.bins, self.splits, self.ends, self.buckets)
        loads = entries.mapInArrow(_router(*where, count=True), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()   # one row a bucket
        tasks = [(r["bucket"], math.ceil(r["n"] / NODE_ENTRIES)) for r in loads]
        sent = entries.mapInArrow(_router(*where), _SENT)
        first = np.cumsum([0, *(n for _, n in tasks)]).tolist()
        places = [(b, n, f) for (b, n), f in zip(tasks, first)]

        def dealt(table: DataFrame, part) -> DataFrame:
            to = F.broadcast(df.sparkSession.createDataFrame(places, "bucket int, _n int, _first int"))
            return P.by_part(table.join(to, "bucket").withColumn("_part", part).withColumn("_part", F.col("_part").cast("int")).drop("_n", "_first"), max(first[-1], 1))

        groups = dealt(sent, F.col("_first") + F.pmod(F.xxhash64("y"), F.col("_n")))
        table = dealt(self.subtrees, F.explode(F.sequence("_first", F.col("_first") + F.col("_n") - 1)))
        shares = groups.cogroup(table).applyInArrow(_scorer(self.bins.zero), "_row long, p double")
        mean = materialise(shares.groupBy("_row").agg(F.round(F.sum("p") / len(self.splits), 12).alias(out_col)), "forest-probability")
        return rows.join(mean, "_row").drop("_row")

    def save(self, path: str) -> None:
        self.subtrees.write.mode("overwrite").parquet(f"{path}/subtrees")
        held = [("borders", [b.tolist() for b in self.bins.borders]), ("splits", self.splits), ("ends", [list(e.items()) for e in self.ends]), ("buckets", self.buckets)]
        self.subtrees.sparkSession.createDataFrame([(k, json.dumps(v)) for k, v in held], "name string, value string") \
            .coalesce(1).write.mode("overwrite").parquet(f"{path}/large")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "Forest":
        held = {r["name"]: json.loads(r["value"]) for r in spark.read.parquet(f"{path}/large").collect()}   # four rows
        return cls(_Bins([np.array(b, np.float64) for b in held["borders"]]), held["splits"], [{s: tuple(e) for s, e in ends} for ends in held["ends"]],
                   held["buckets"], spark.read.parquet(f"{path}/subtrees"))


def _as_block(rows: pa.Table) -> pa.Table:
    rows = rows.sort_by("_deal")
    ends, at, x = _flat(rows)
    return pa.table({"block": pa.array([rows["_part"][0].as_py()], pa.int32()), "y": [(rows["y"].to_numpy() > 0.5).astype(np.uint8).tobytes()],
                     "w": [rows["w"].to_numpy().astype(np.float64).tobytes()], "ends": [ends.tobytes()],
                     "at": [at.astype(np.int32).tobytes()], "x": [x.astype(np.float64).tobytes()]})


def _fit_bins(raw: DataFrame, size: int) -> _Bins:
    def points(batches):
        for batch in batches:
            yield from _points(batch)

    found = raw.select("at", "x").mapInArrow(points, "j int, v array<double>, n double")
    made = found.groupBy(F.pmod("j", F.lit(64))).applyInArrow(_borders, "j int, b array<double>").collect()   # one row a column, at most BINS numbers
    borders = [np.zeros(0)] * size
    for r in made:
        borders[r["j"]] = np.array(r["b"], np.float64)
    return _Bins(borders)


def _binner(bins: _Bins):
    kind = _kind(bins.zero)

    def run(batches):
        for batch in batches:
            ats = [np.frombuffer(a.as_py(), np.int32) for a in batch["at"]]
            x = [bins.of(a, np.frombuffer(v.as_py(), np.float64)).tobytes() for a, v in zip(ats, batch["x"])]
            held = {c: batch[c] for c in batch.schema.names} | {"at": pa.array([a.astype(kind).tobytes() for a in ats], pa.binary()), "x": pa.array(x, pa.binary())}
            yield pa.record_batch(held)
    return run


def _tried(zero: np.ndarray, rng) -> np.ndarray:
    return rng.choice(len(zero), math.ceil(math.sqrt(len(zero))), replace=False)


def _grow_large(binned: DataFrame, zero: np.ndarray, n: int, limit: int, trees: int, depth: int, seed: int) -> tuple[list, list, list]:
    """Splits of the nodes of more than ``limit`` rows, the slots that end as leaves, and (tree, slot, depth, rows) of the nodes left."""
    splits, ends, open_ = [[] for _ in range(trees)], [{} for _ in range(trees)], []
    root = int(n * BAGGED)
    active = [(t, 0, 0) for t in range(trees)] if root > limit and depth > 0 else []
    if not active:
        open_ = [(t, 0, 0, root) for t in range(trees)]
    made = [1] * trees
    while active:
        level, active = active, []
        for a in range(0, len(level), NODES_AT_ONCE):
            some = level[a:a + NODES_AT_ONCE]
            summed = binned.mapInArrow(_summer(zero, splits, some, seed), "tree int, slot int, sums binary, total binary")
            found = {(r["tree"], r["slot"]): r for r in summed.groupBy("tree", "slot").applyInArrow(_chooser(zero, {(t, s): d for t, s, d in some}, seed),
                     "tree int, slot int, feature int, bin int, stats array<double>").collect()}   # one row a large node
            for t, s, d in some:
                feature, bin_, stats = found[t, s]["feature"], found[t, s]["bin"], np.array(found[t, s]["stats"]).reshape(2, 3)
                if feature < 0:
                    ends[t][s] = (True, stats[0][1] / max(stats[0][0] + stats[0][1], 1e-300))
                    continue
                splits[t].append([s, feature, bin_, made[t]])
                for slot, (w0, w1, rows) in ((s, stats[0]), (made[t], stats[1])):
                    if d + 1 >= depth or min(w0, w1) <= SOME * (w0 + w1):
                        share = w1 / (w0 + w1)
                        ends[t][slot] = (True, float(share if d + 1 >= depth else round(share)))
                    elif rows > limit:
                        active.append((t, slot, d + 1))
                    else:
                        open_.append((t, slot, d + 1, int(rows)))
                made[t] += 1
    return splits, ends, open_


def _summer(zero: np.ndarray, splits: list, nodes: list, seed: int):
    """Sums of a task's blocks for the large nodes, by feature and bin: weight of class 0, of class 1, rows."""
    def run(batches):
        held = {}
        of_tree = {}
        for t, s, d in nodes:
            of_tree.setdefault(t, []).append((s, _tried(zero, np.random.default_rng((seed, t, s, d)))))
        for block in _blocks(batches, zero):
            block.by_column()
            for t, of in of_tree.items():
                bag = block.bag(t, seed)
                w, slot = bag * block.w, block.slots(splits[t])
                three = np.stack([w * (block.y == 0), w * (block.y == 1), (bag > 0).astype(np.float64)], axis=-1)
                for s, features in of:
                    sums, total = block.sums((slot == s) & (bag > 0), three, features)
                    if (t, s) in held:
                        held[t, s][0][:] += sums
                        held[t, s][1][:] += total
                    else:
                        held[t, s] = (sums, total)
        for (t, s), (sums, total) in held.items():
            yield pa.record_batch({"tree": pa.array([t], pa.int32()), "slot": pa.array([s], pa.int32()), "sums": [sums.tobytes()], "total": [total.tobytes()]})
    return run


def _chooser(zero: np.ndarray, depths: dict, seed: int):
    """The best split of a large node: the sums of both sides; feature -1 where nothing gains."""
    def run(rows: pa.Table) -> pa.Table:
        t, s = rows["tree"][0].as_py(), rows["slot"][0].as_py()
        sums, total = (sum(np.frombuffer(b.as_py()) for b in rows[c]) for c in ("sums", "total"))
        found = _split(sums.reshape(-1, BINS, 3), total) if total[0] > 0 and total[1] > 0 else None
        if found is None:
            feature, bin_, stats = -1, 0, [*total, *total]
        else:
            feature = int(_tried(zero, np.random.default_rng((seed, t, s, depths[t, s])))[found[0]])
            bin_, stats = found[1], [*found[2], *(total - found[2])]
        return pa.table({"tree": pa.array([t], pa.int32()), "slot": pa.array([s], pa.int32()), "feature": pa.array([feature], pa.int32()),
                         "bin": pa.array([bin_], pa.int32()), "stats": pa.array([stats], pa.list_(pa.float64()))})
    return run


def _deal_nodes(open_: list, limit: int, ends: list) -> int:
    """Deal the nodes left to buckets of about ``limit`` rows; the number of buckets."""
    bucket, held = 0, 0
    for t, s, _, n in sorted(open_, key=lambda o: -o[3]):
        if held and held + n > limit:
            bucket, held = bucket + 1, 0
        ends[t][s] = (False, bucket)
        held += n
    return bucket + 1


def _gatherer(zero: np.ndarray, splits: list, ends: list, seed: int):
    """The bootstrapped rows of each small node, one record a block and node."""
    def run(batches):
        for block in _blocks(batches, zero):
            block.by_column()
            for t in range(len(splits)):
                bag, slot = block.bag(t, seed), block.slots(splits[t])
                out = []
                for s in np.unique(slot[bag > 0]).tolist():
                    leaf, bucket = ends[t][s]
                    if not leaf:
                        rows = np.flatnonzero((slot == s) & (bag > 0))
                        out.append(_send(block, bucket, t, s, rows, block.y[rows], (bag * block.w)[rows]))
                if out:
                    yield pa.RecordBatch.from_pylist(out, _SENT_ARROW)
    return run


def _finisher(zero: np.ndarray, levels: dict, seed: int):
    tries = math.ceil(math.sqrt(len(zero)))

    def run(rows: pa.Table) -> pa.Table:
        out, bucket = [], rows["bucket"][0].as_py()
        for (t, s), sent in _nodes(rows):
            sent.sort(key=lambda r: (r["y"], r["w"], r["at"]))   # the order in which blocks come does not count
            y, w = (np.concatenate([_unpacked(r[c], kind) for r in sent]) for c, kind in (("y", np.uint8), ("w", np.float64)))
            made = _grow(y, w, *_joined(sent, zero), zero, tries, levels[t, s], np.random.default_rng((seed, t, s)))
            out.append({"bucket": bucket, "tree": t, "slot": s} | dict(zip(("feature", "bin", "left", "right", "p"), made)))
        ints = pa.list_(pa.int32())
        return pa.Table.from_pylist(out, pa.schema([("bucket", pa.int32()), ("tree", pa.int32()), ("slot", pa.int32()), ("feature", ints), ("bin", ints),
                                                    ("left", ints), ("right", ints), ("p", pa.list_(pa.float64()))]))
    return run


def _router(bins: _Bins, splits: list, ends: list, buckets: int, count: bool = False):
    """Rows to score, sent to the subtrees they come to; of the leaves among the large nodes, the sum of their shares (slot -1).
    With ``count`` only how many rows and entries each bucket gets."""
    zero = bins.zero

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            at_end, at, x = _flat(batch)
            ids, none = batch["_row"].to_numpy(), np.zeros(0)
            block = _Block(0, b"", none.tobytes(), at_end.tobytes(), at.astype(_kind(zero)).tobytes(), bins.of(at, x).tobytes(), zero).by_column()
            shares, sizes, load = np.zeros(block.n), np.diff(at_end) + 1, np.zeros(buckets, np.int64)
            home = int(ids[0] % buckets)
            load[home] += block.n
            for t in range(len(splits)):
                slot, out = block.slots(splits[t]), []
                for s in np.unique(slot).tolist():
                    leaf, end = ends[t][s]
                    rows = np.flatnonzero(slot == s)
                    if leaf:
                        shares[rows] += end
                    elif count:
                        load[end] += sizes[rows].sum()
                    else:
                        out.append(_send(block, end, t, s, rows, ids[rows], none))
                if out:
                    yield pa.RecordBatch.from_pylist(out, _SENT_ARROW)
            if count:
                yield pa.record_batch({"bucket": pa.array(np.flatnonzero(load), pa.int32()), "n": pa.array(load[load > 0])})
            else:
                yield pa.RecordBatch.from_pylist([_send(block, home, -1, -1, np.zeros(0, np.int64), ids, shares)], _SENT_ARROW)
    return run


def _scorer(zero: np.ndarray):
    def run(rows: pa.Table, subtrees: pa.Table) -> pa.Table:
        grown = {(r["tree"], r["slot"]): r for r in subtrees.to_pylist()}
        ids, shares = [np.zeros(0, np.int64)], [np.zeros(0)]
        for (t, s), sent in _nodes(rows) if rows.num_rows else ():
            here = [_unpacked(r["y"], np.int64) for r in sent]
            ids += here
            if s < 0:
                shares += [_unpacked(r["w"], np.float64) for r in sent]
            elif (t, s) in grown:
                shares.append(_walk(grown[t, s], *_joined(sent, zero), zero))
            else:   # no bootstrapped row came here: nothing is known
                shares.append(np.zeros(sum(map(len, here))))
        ids, at = np.unique(np.concatenate(ids), return_inverse=True)
        return pa.table({"_row": pa.array(ids), "p": pa.array(np.bincount(at, np.concatenate(shares), len(ids)).astype(np.float64))})
    return run
