"""Near-duplicate vectors by sorted projection passes.

In each pass a vector gets 64 bits, the signs of the projections of its difference from its label's mean on random
directions, as one sort key. Rows sorted by label and key lie near those that share a long prefix; each is compared with
the WINDOW rows before it, key with key: two that link differ in few bits, and so are candidates. Only keys are sorted
and compared, never vectors, and of a batch's candidates only as many go on as connect what all connect. Sorted order
is global: rows are range-partitioned, and the first and last WINDOW rows of each partition are compared once more
together, so windows don't end where a partition does.

The rows that have a candidate in any pass go through the windows once more with their vectors, pass by pass, and pairs at
the threshold are links; only these are united, over all passes, to components. A window can be too small for a run of rows
whose keys are all alike: groups of candidates of more rows than a window, of any size, are compared exactly as well, each
row with each, block of BLOCK rows by block, so that no link is lost to a group's size; that costs the square of a group
of near copies, less the equal ones. Last, all links within each component are
counted: in one of up to BLOCK vectors by comparing all; in a larger one, members within half the link angle of its centre
link to each other by the triangle inequality and are only counted, and each other member is compared with its component's
members.

How many passes a label needs is measured: in the first PROBE passes, the prefix that a vector shares with the row
WINDOW places before it says how many bits a partner must share to be met. A row whose window is full of candidates lies
inside a run of near copies, which counts by the rows at its ends. Where no number of PASSES is enough, as where
many vectors are near the mean, the label as a whole is one group to check. What can stay unfound is a link between two
groups that no pass brought into one window; RECALL says how rare that is for a pair at the threshold exactly.

Equal vectors of a label are one node with a count, never pairs.

Cases: vectors that are null, empty, zero or hold null or non-finite components, and rows without a label, link with
nothing; rows that repeat an id, label and vector are one vector, and give one row; an id with several vectors has a row
for each of them; vectors of different lengths never link; each row without an id stays a row of its own, without
links; an empty table gives an empty table; only the named columns are read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import components, discard, materialize, small_batches, written

WINDOW = 24
BLOCK = 2048
BITS = 64
#: The least number of passes, whatever the table's size.
LEAST_PASSES = 12
#: The share of pairs at the threshold exactly whose keys share, in one of the passes, a prefix that a window's worth of rows has.
RECALL = 0.999
#: Passes that the shared prefixes are measured in.
PROBE = 8
#: The numbers of passes that a label may take.
PASSES = (12, 16, 24, 32, 48, 64, 96, 128, 192, 256, 384, 512, 768, 1024)
#: Deviations above the mean of a partner's differing bits up to which keys are candidates.
SIGMAS = 4
_EDGE = 1e-9
_SCALE = 1 << 30


def passes_for(rows: int, threshold: float, window: int = WINDOW, recall: float = RECALL) -> int:
    """Passes for a label of so many vectors, spread evenly: a bit differs with the chance angle / pi, and log2(rows / window) bits leave a window's worth of rows."""
    bits = min(BITS, max(1.0, math.log2(max(rows, 1) / window)))
    met = (1 - math.acos(min(1.0, threshold)) / math.pi) ** bits
    return max(LEAST_PASSES, math.ceil(math.log(1 - recall) / math.log1p(-met))) if met < 1 else LEAST_PASSES


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, label, raw, unit_key, unit): digests of the vector and of its direction; the latter and unit are null where it can't link."""
    for whole in batches:
        for start in range(0, whole.num_rows, 1024):
            batch = whole.slice(start, 1024)
            ids, labels, vectors = (batch.column(i) for i in range(3))
            known = zip(ids.is_valid().to_pylist(), labels.is_valid().to_pylist(), strict=True)
            raws, keys, units = [], [], []
            for v, (has_id, has_label) in zip(vectors.to_pylist(), known, strict=True):
                x = np.array(v or [], np.float64)  # a null component becomes nan
                raws.append(b"" if v is None else hashlib.md5(x.tobytes()).digest())
                top = np.abs(x).max(initial=0.0)
                if has_id and has_label and np.isfinite(top) and top > 0:
                    x /= top  # first, so that squares neither overflow nor vanish
                    x = x / np.sqrt(x @ x) + 0.0
                    keys.append(hashlib.md5(x.tobytes()).digest())
                    units.append(x)
                else:
                    keys.append(None)
                    units.append(None)
            yield pa.RecordBatch.from_arrays([ids, labels, pa.array(raws, pa.binary()), pa.array(keys, pa.binary()), pa.array(units, pa.list_(pa.float64()))], names=["vec_id", "label", "raw", "unit_key", "unit"])


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(label, dim, n, sums): a task's sums by label, in whole numbers, so that they don't depend on the order."""
    held: dict[tuple, list] = {}

    def out() -> pa.RecordBatch:
        rows = [(k[0], k[1], n, s.tolist()) for k, (n, s) in held.items()]
        held.clear()
        columns = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(columns[0], kind), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.list_(pa.int64()))], names=["label", "dim", "n", "sums"])

    kind = None
    for batch in batches:
        kind = batch.column(0).type
        units = batch.column(1)
        values, offsets = np.asarray(units.values), np.asarray(units.offsets)
        for i, label in enumerate(batch.column(0).to_pylist()):
            x = np.rint(values[offsets[i] : offsets[i + 1]] * _SCALE).astype(np.int64)
            n, s = held.get((label, len(x)), (0, 0))
            held[label, len(x)] = [n + 1, s + x]
        if len(held) > 4096:
            yield out()
    if held:
        yield out()


@lru_cache(64)
def _directions(dim: int, step: int) -> np.ndarray:
    """The directions of passes PROBE * step and on."""
    return np.random.default_rng([20, dim, step]).standard_normal((dim, PROBE * BITS))


def _keys(threshold: float, first: int):
    """(nid, label, dim, pass, key, same) for each vector and pass from first on; same is the chance that a bit is a partner's at the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                batch = whole.slice(start, 1024)
                ids, labels, unit, mean = (batch.column(i) for i in range(4))
                passes, units_at, means_at = np.asarray(batch.column(4)), np.asarray(unit.offsets), np.asarray(mean.offsets)
                dims = np.diff(units_at)
                for dim in np.unique(dims).tolist():
                    of, places = np.flatnonzero(dims == dim), np.arange(dim)
                    rest = np.asarray(unit.values)[units_at[of][:, None] + places] - np.asarray(mean.values)[means_at[of][:, None] + places]
                    square = np.maximum(np.einsum("ij,ij->i", rest, rest), 1e-300)
                    chance = 1 - np.arccos(np.clip(1 - (1 - threshold) / square, -1, 1)) / np.pi
                    for step in range(first // PROBE, -(-int(passes[of].max()) // PROBE)):
                        more = passes[of] > step * PROBE
                        at, x, same = of[more], rest[more], chance[more]
                        bits = (x @ _directions(dim, step) > 0).reshape(len(at), PROBE, BITS)
                        keys = np.packbits(bits, axis=2).view(">u8").reshape(len(at), PROBE).astype(np.uint64)
                        keys = (keys ^ np.uint64(1 << 63)).view(np.int64)  # signed order is the order of the bits
                        number = np.arange(step * PROBE, (step + 1) * PROBE, dtype=np.int32)
                        row, column = np.nonzero(number[None] < passes[at][:, None])
                        take = pa.array(at[row])
                        yield pa.RecordBatch.from_arrays([ids.take(take), labels.take(take), pa.array(np.full(len(row), dim, np.int32)), pa.array(number[column]), pa.array(keys[row, column]), pa.array(same[row])], names=["nid", "label", "dim", "pass", "key", "same"])

    return run


def _sorted_keys(nodes: DataFrame, threshold: float, first: int) -> DataFrame:
    """The keys of nodes (nid, label, unit, mean, passes) in global order."""
    parts = max(1, int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    label_type = nodes.schema["label"].dataType.simpleString()
    keys = nodes.select("nid", "label", "unit", "mean", "passes").mapInArrow(_keys(threshold, first), f"nid long, label {label_type}, dim int, pass int, key long, same double")
    keys = materialize(keys)  # to find the ranges, Spark reads them once more
    return keys.repartitionByRange(parts, "pass", "label", "dim", "key", "nid").sortWithinPartitions("pass", "label", "dim", "key", "nid")


def _forest(n: int, a: np.ndarray, b: np.ndarray, root: np.ndarray | None = None) -> np.ndarray:
    """Each of n places' least place that the links a, b, and those of root, reach."""
    root = np.arange(n) if root is None else root
    while len(a):
        u, v = root[a], root[b]
        np.minimum.at(root, np.maximum(u, v), np.minimum(u, v))
        while (root[root] != root).any():
            root = root[root]
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
    return root


def _bound(same: np.ndarray) -> np.ndarray:
    """Bits in which keys of candidates differ at most, by the chance that a bit is the same."""
    return BITS * (1 - same) + SIGMAS * np.sqrt(BITS * (1 - same) * same) + 1


def _candidates(table: pa.Table, window: int, new: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Links between ids that connect the candidates among sorted keys: rows from new on with the rows up to window before them."""
    n = table.num_rows
    key, same, nid = np.asarray(table["key"]), np.asarray(table["same"]), np.asarray(table["nid"])
    group = [np.asarray(table[c].combine_chunks().dictionary_encode().indices) for c in ("label", "dim", "pass")]
    bound = _bound(same)
    ends: list[np.ndarray] = []
    for back in range(1, min(window, n - 1) + 1):
        at = np.arange(max(new, back), n)
        near = np.bitwise_count((key[at] ^ key[at - back]).view(np.uint64)) <= np.maximum(bound[at], bound[at - back])
        for g in group:
            near &= g[at] == g[at - back]
        ends.append(np.stack([at[near], at[near] - back]))
    a, b = np.concatenate(ends, 1) if ends else np.zeros((2, 0), np.int64)
    root = _forest(n, a, b)
    at = np.flatnonzero(root != np.arange(n))
    return nid[at], nid[root[at]]


def _walk(window: int, measure: bool, label_type: pa.DataType):
    """Over a partition of sorted keys: links between candidates, the rows at its ends, and sums of the chances that a partner isn't met, by label."""
    names = ["kind", "a", "b", "label", "dim", "pass", "key", "same", "missed"]
    kinds = [pa.int32(), pa.int64(), pa.int64(), label_type, pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.list_(pa.float64())]

    def batch(n: int, **columns) -> pa.RecordBatch:
        full = [columns.get(k) for k in names]
        return pa.RecordBatch.from_arrays([pa.nulls(n, t) if c is None else pa.array(c, t) if not isinstance(c, pa.Array) else c for c, t in zip(full, kinds, strict=True)], names=names)

    def ends(rows: pa.Table) -> pa.RecordBatch:
        of = {k: rows[k].combine_chunks() for k in ("label", "dim", "pass", "key", "same")}
        return batch(rows.num_rows, kind=np.full(rows.num_rows, 1, np.int32), a=rows["nid"].combine_chunks(), **of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, head, missed = None, window, {}
        for one in batches:
            if not one.num_rows:
                continue
            table = pa.Table.from_batches([one]) if held is None else pa.concat_tables([held, pa.Table.from_batches([one])]).combine_chunks()
            n, new = table.num_rows, 0 if held is None else held.num_rows
            a, b = _candidates(table, window, new)
            yield batch(len(a), kind=np.zeros(len(a), np.int32), a=a, b=b)
            if head:
                yield ends(table.slice(new, head))
                head -= min(head, n - new)
            if measure and n > window:
                _missed(table, window, max(new, window), missed)
            held = table.slice(max(0, n - window))
        if held is not None:
            yield ends(held)
        if missed:
            label, dim = zip(*missed, strict=True)
            yield batch(len(missed), kind=np.full(len(missed), 2, np.int32), label=pa.array(label, label_type), dim=np.array(dim, np.int32), missed=[v.tolist() for v in missed.values()])

    return run, names


def _missed(table: pa.Table, window: int, start: int, into: dict[tuple, np.ndarray]) -> None:
    """Adds to into, by label and dim, how many rows were measured, and the sums of the chances that so many passes (PASSES) don't meet a partner."""
    at = np.arange(start, table.num_rows)
    key, same = np.asarray(table["key"]), np.asarray(table["same"])
    codes = [np.asarray(table[c].combine_chunks().dictionary_encode().indices) for c in ("label", "dim", "pass")]
    inside = np.ones(len(at), bool)
    for c in codes:
        inside &= c[at] == c[at - window]
    differ = (key[at] ^ key[at - window]).view(np.uint64)
    run = inside & (np.bitwise_count(differ) <= np.maximum(_bound(same[at]), _bound(same[at - window])))
    # bits up to and with the first that differs, or all; halves, since a double holds 53 bits
    high, low = differ >> np.uint64(32), differ & np.uint64(0xFFFFFFFF)
    bits = np.where(high > 0, 33 - np.frexp(high.astype(float))[1], np.where(low > 0, 65 - np.frexp(low.astype(float))[1], BITS))
    met = np.where(inside, same[at] ** bits, 1.0)  # fewer rows before it than the window holds: all are met
    missed = (1 - met)[:, None] ** np.array(PASSES, float)
    label, dim = table["label"].to_pylist(), np.asarray(table["dim"])
    # rows of one label and dim lie side by side
    cuts = np.flatnonzero(np.concatenate([[True], (codes[0][at[1:]] != codes[0][at[:-1]]) | (codes[1][at[1:]] != codes[1][at[:-1]])])) if len(at) else []
    for s, e in zip(cuts, [*cuts[1:], len(at)], strict=True):
        k = label[at[s]], int(dim[at[s]])
        ends = ~run[s:e]
        into[k] = into.get(k, 0) + np.concatenate([[ends.sum()], missed[s:e][ends].sum(0)])


def _walked(nodes: DataFrame, threshold: float, window: int, first: int, measure: bool) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_type

    kind = nodes.schema["label"].dataType
    run, names = _walk(window, measure, to_arrow_type(kind))
    types = ["int", "long", "long", kind.simpleString(), "int", "int", "long", "double", "array<double>"]
    return materialize(_sorted_keys(nodes, threshold, first).mapInArrow(run, ", ".join(f"{n} {t}" for n, t in zip(names, types, strict=True))))


def _links(walked: DataFrame, window: int) -> DataFrame:
    """Links (a, b) of candidates: those of the partitions, and those among the rows at their ends."""

    def across(table: pa.Table) -> pa.Table:
        a, b = _candidates(table.sort_by([("key", "ascending"), ("nid", "ascending")]), window)
        return pa.table({"a": a.astype(np.int64), "b": b.astype(np.int64)})

    seams = walked.where("kind = 1").select("label", "dim", "pass", "key", "same", F.col("a").alias("nid"))
    return walked.where("kind = 0").select("a", "b").unionByName(seams.groupBy("pass", "label", "dim").applyInArrow(across, "a long, b long"))


def needed_passes(walked: DataFrame, recall: float = RECALL) -> DataFrame:
    """(label, dim, needed): the least of PASSES by which a partner at the threshold is met so often; null if none is enough."""
    sums = walked.where("kind = 2").groupBy("label", "dim").agg(*[F.sum(F.element_at("missed", i + 1)).alias(f"m{i}") for i in range(len(PASSES) + 1)])
    return sums.select("label", "dim", F.coalesce(*[F.when(F.col(f"m{i + 1}") <= (1 - recall) * F.col("m0"), F.lit(p)) for i, p in enumerate(PASSES)]).alias("needed"))


def _by_run(function: Callable[..., list[tuple]], names: tuple[str, str]):
    """applyInArrow of function to each run of one group and pair of blocks in a table; it gives two columns of long."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in ("of", "i", "j", "block", "nid")]).combine_chunks()
        of, i, j = (np.asarray(table[c]) for c in ("of", "i", "j"))
        nid, block, copies = (np.asarray(table[c]) for c in ("nid", "block", "copies"))
        units = table["unit"].combine_chunks()
        values, at = np.asarray(units.values), np.asarray(units.offsets)
        cuts = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]))
        out = [np.zeros((2, 0), np.int64)]
        for s, e in zip(cuts, [*cuts[1:], len(of)], strict=True):
            out.append(function(nid[s:e], values[at[s] : at[e]].reshape(e - s, -1), block[s:e], i[s] == j[s], copies[s:e]))
        a, b = np.concatenate(out, 1)
        return pa.table({names[0]: a.astype(np.int64), names[1]: b.astype(np.int64)})

    return run


def _checked(threshold: float):
    """Links that connect what all links between two blocks of a group, or inside one, connect."""

    def one(nid, x, block, same, copies):
        first, other = np.flatnonzero(block == block.min()), np.flatnonzero(block == block.max())
        if not same and len(first) == len(nid):
            return np.zeros((2, 0), np.int64)  # the other block is empty
        root = np.arange(len(nid))
        for start in range(0, len(first), 256):
            rows = first[start : start + 256]
            at, to = np.nonzero(x[rows] @ x[other].T >= threshold)
            root = _forest(len(nid), rows[at], other[to], root)
        at = np.flatnonzero(root != np.arange(len(nid)))
        return np.stack([nid[at], nid[root[at]]])

    return one


def _counted(threshold: float):
    """(nid, other vectors that each node's vectors link with), of all members of a component."""

    def one(nid, x, block, same, copies):
        links = np.empty(len(nid), np.int64)
        for start in range(0, len(nid), 256):
            near = x[start : start + 256] @ x.T >= threshold
            near[np.arange(len(near)), start + np.arange(len(near))] = False
            links[start : start + 256] = near @ copies
        return np.stack([nid, links])

    return one


def _in_blocks(members: DataFrame, function: Callable, names: tuple[str, str]) -> DataFrame:
    """function over members (of, n: members of that group; nid, unit, copies), block by block; small groups share a task's table."""
    parts = F.ceil(F.col("n") / BLOCK)
    dealt = members.withColumn("parts", parts).withColumn("block", F.pmod(F.xxhash64("nid"), "parts"))
    pairs = dealt.select("of", "nid", "copies", "unit", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("with"))
    pairs = pairs.select("of", "nid", "copies", "unit", "block", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"))
    buckets = max(1, members.count() // BLOCK)
    return pairs.groupBy(F.pmod(F.xxhash64("of", "i", "j"), F.lit(buckets))).applyInArrow(_by_run(function, names), f"{names[0]} long, {names[1]} long")


def _compare(threshold: float, window: int):
    """Links (a, b) of a block: each row that belongs to it with the rows up to window places before, vector with vector."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos").combine_chunks()
        n = table.num_rows
        nid, own = np.asarray(table["nid"]), np.asarray(table["own"])
        group = [np.asarray(table[c].combine_chunks().dictionary_encode().indices) for c in ("label", "dim", "pass")]
        vectors = table["unit"].to_pylist()
        x = np.zeros((n, max(map(len, vectors))))
        for i, v in enumerate(vectors):
            x[i, : len(v)] = v
        ends = []
        for back in range(1, min(window, n - 1) + 1):
            near = (np.einsum("ij,ij->i", x[back:], x[:-back]) >= threshold) & own[back:]
            for g in group:
                near &= g[back:] == g[:-back]
            at = np.flatnonzero(near)
            ends.append(np.stack([at + back, at]))
        a, b = np.concatenate(ends, 1) if ends else np.zeros((2, 0), np.int64)
        root = _forest(n, a, b)
        at = np.flatnonzero(root != np.arange(n))
        return pa.table({"a": nid[at].astype(np.int64), "b": nid[root[at]].astype(np.int64)})

    return run


def _in_windows(nodes: DataFrame, threshold: float, window: int) -> DataFrame:
    """Links (a, b) of nodes (nid, label, unit, mean, passes) that lie in one window in one of their label's passes."""
    ordered = materialize(_sorted_keys(nodes, threshold, 0).drop("same").withColumn("id", F.monotonically_increasing_id()))
    part = F.shiftright("id", 33)
    sizes = ordered.groupBy(part.alias("part")).agg(F.count("*").alias("n"))  # one row a partition
    sizes = sizes.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    placed = ordered.withColumn("part", part).join(F.broadcast(sizes), "part")
    placed = placed.withColumn("pos", F.col("before") + F.col("id").bitwiseAND(F.lit((1 << 33) - 1)))
    block = F.floor(F.col("pos") / BLOCK)
    blocks = F.when(F.col("pos") % BLOCK >= BLOCK - window, F.array(block, block + 1)).otherwise(F.array(block))
    placed = placed.select("nid", "label", "dim", "pass", "pos", F.explode(blocks).alias("block"))
    placed = placed.withColumn("own", F.floor(F.col("pos") / BLOCK) == F.col("block"))
    units = nodes.select(F.col("nid").alias("__n"), "unit")
    full = placed.join(units, placed["nid"] == units["__n"]).select("block", "pos", "own", "nid", "label", "dim", "pass", "unit")
    return full.groupBy("block").applyInArrow(_compare(threshold, window), "a long, b long")


def _grouped(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """nodes in the components of links found, with of (the component) and n (its nodes)."""
    found = components(found)
    roots = found.select(F.col("component").alias("id"), "component").distinct()
    every = materialize(found.unionByName(roots).select("id", F.col("component").alias("of")))
    sizes = every.groupBy("of").agg(F.count("*").alias("n"))
    return every.join(sizes, "of").join(nodes, F.col("id") == nodes["nid"]).drop("id")


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, passes: int | None = None, window: int = WINDOW, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept): a row for each vector. passes: of every label; if not given, as measured."""
    spark = vectors.sparkSession
    small_batches(spark)
    before = written(spark)
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).alias("label"), F.col(embedding).alias("v"))
    label_type = rows.schema["label"].dataType.simpleString()
    made = materialize(rows.mapInArrow(_units, f"vec_id long, label {label_type}, raw binary, unit_key binary, unit array<double>"))
    ids = materialize(made.where("vec_id IS NOT NULL").select("vec_id", "label", "raw", "unit_key").distinct())
    # equal directions of a label are one node
    shared = ids.where("unit_key IS NOT NULL").groupBy("label", "unit_key").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    units = made.where("unit_key IS NOT NULL").groupBy("label", "unit_key").agg(F.any_value("unit").alias("unit"))
    nodes = materialize(shared.join(units, ["label", "unit_key"]).withColumn("nid", F.monotonically_increasing_id()))

    sums = nodes.select("label", "unit").mapInArrow(_sums, f"label {label_type}, dim int, n long, sums array<long>")
    sums = sums.select("label", "dim", "n", F.posexplode("sums").alias("i", "x")).groupBy("label", "dim", "i").agg(F.sum("n").alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).cast("double").alias("x"))
    means = sums.groupBy("label", "dim").agg(F.max("n").alias("n"), F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("c"))
    means = materialize(means.select("label", "dim", "n", F.transform("c", lambda x: x / F.col("n") / _SCALE).alias("mean")).where("n > 1"))
    named = nodes.select("nid", "label", "unit", "copies", F.size("unit").alias("dim"))
    centred = named.join(means, ["label", "dim"])

    if passes is None:
        walked = _walked(centred.withColumn("passes", F.lit(PROBE)), threshold, window, 0, True)
        found = _links(walked, window)
        means = materialize(means.join(needed_passes(walked), ["label", "dim"], "left").withColumn("passes", F.greatest("needed", F.lit(LEAST_PASSES))))
        # labels without a measured row have no more vectors than the window
        means = means.withColumn("passes", F.when(F.col("n") <= window, LEAST_PASSES).otherwise(F.col("passes")))
        centred = named.join(means, ["label", "dim"])
        more = _walked(centred.where("passes IS NOT NULL"), threshold, window, PROBE, False)
        found = found.unionByName(_links(more, window))
    else:
        centred = centred.withColumn("passes", F.lit(passes))
        found = _links(_walked(centred, threshold, window, 0, False), window)
    whole = centred.where("passes IS NULL")
    grouped = materialize(_grouped(found, centred.where("passes IS NOT NULL").select("nid", "label", "unit", "copies", "mean", "passes")))
    links = _in_windows(grouped, threshold, window)
    links = links.unionByName(_in_blocks(grouped.where(F.col("n") > window), _checked(threshold), ("a", "b")))
    if passes is None and not whole.isEmpty():
        labels = F.xxhash64("label", "dim")  # labels that share a hash only share blocks: no link crosses a label below
        links = links.unionByName(_in_blocks(whole.select(labels.alias("of"), "n", "nid", "unit", "copies"), _checked(threshold), ("a", "b")))
    inside = materialize(_grouped(links, nodes.select("nid", "unit", "copies", "least")))

    counts = _in_blocks(inside.where(F.col("n") <= BLOCK), _counted(threshold), ("nid", "others"))
    large = inside.where(F.col("n") > BLOCK)
    if not large.isEmpty():
        counts = counts.unionByName(_counts_about_centre(large, threshold))
    least = inside.groupBy("of").agg(F.min("least").alias("component_id"))
    of = inside.select("nid", "of").join(least, "of").join(counts, "nid").select("nid", "component_id", "others")
    tables = [p for p in written(spark) if p not in before]
    result = materialize(_rows(made, ids, nodes, of))
    discard(spark, tables)
    return result


def _counts_about_centre(inside: DataFrame, threshold: float) -> DataFrame:
    """(nid, others) of the members (of, nid, copies, unit) of large components."""
    dim = F.size("unit").alias("dim")
    sums = inside.select("of", dim, F.posexplode("unit").alias("i", "x")).groupBy("of", "dim", "i").agg(F.sum("x").alias("x"))
    centre = sums.groupBy("of").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("centre"))
    # a table of its own, so that the join with it is one whose large components Spark splits
    centre = materialize(centre.select(F.col("of").alias("__of"), "centre", F.sqrt(F.aggregate("centre", F.lit(0.0), lambda s, y: s + y * y)).alias("size")))

    def dot(a: str, b: str):
        return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)

    half = math.cos(math.acos(threshold) / 2) + _EDGE
    inside = inside.join(centre, inside["of"] == centre["__of"])
    inside = materialize(inside.select("of", "nid", "copies", "unit", (dot("unit", "centre") >= half * F.col("size")).alias("inner")))
    inner = materialize(inside.where("inner").groupBy(F.col("of").alias("__of")).agg(F.sum("copies").alias("mutual")))
    outer = inside.where("NOT inner").select(F.col("of").alias("oc"), F.col("nid").alias("o"), F.col("copies").alias("o_copies"), F.col("unit").alias("ou"))
    met = outer.join(inside, (F.col("oc") == F.col("of")) & (F.col("o") != F.col("nid")) & (dot("ou", "unit") >= threshold))
    # an outer member's links, and what each adds to an inner one
    extra = met.select(F.explode(F.expr("IF(inner, array(struct(o AS id, copies AS n), struct(nid AS id, o_copies AS n)), array(struct(o AS id, copies AS n)))")).alias("e")).select("e.id", "e.n").groupBy("id").agg(F.sum("n").alias("extra"))
    counts = inside.join(inner, inside["of"] == inner["__of"], "left").join(extra, inside["nid"] == extra["id"], "left")
    return counts.select("nid", (F.when(F.col("inner"), F.col("mutual") - F.col("copies")).otherwise(0) + F.coalesce("extra", F.lit(0))).alias("others"))


def _rows(made: DataFrame, ids: DataFrame, nodes: DataFrame, of: DataFrame) -> DataFrame:
    """The result: linked vectors, those alone, those that can't link, and those without an id."""
    linked = nodes.select("label", "unit_key", "nid", "copies", "least").join(of, "nid", "left")
    linked = linked.select(F.col("label").alias("__l"), F.col("unit_key").alias("__k"), (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component_id", "least").alias("component_id"))
    can = ids.where("unit_key IS NOT NULL")
    out = can.join(linked, (can["label"] == linked["__l"]) & (can["unit_key"] == linked["__k"])).select("vec_id", "n_links", "component_id")
    alone = ids.where("unit_key IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    nameless = made.where("vec_id IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = out.unionByName(alone).unionByName(nameless)
    return out.select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id", F.coalesce(F.col("component_id") == F.col("vec_id"), F.lit(True)).alias("kept"))
