"""N-gram Jaccard join with a count-vector R-tree.

Two texts link when the Jaccard index of their sets of word 5-grams is at least
the threshold t = num/den.  The join loses no link:

1. ``profiles``: each text's set gets a digest, its size and its count vector
   (grams hashed into groups, counted).  Texts with one digest form a class,
   and from here on only classes matter.
2. Blocks: of a set of n grams at least one of the n - ceil(t n) + 1 rarest is
   shared by every linked partner.  Rarity comes from a fixed-size sketch of
   gram counts over the corpus; any order is lossless.
3. Within a block the count vectors are points of an R-tree.  The overlap of two
   sets is at most the sum of their vectors' coordinate minima, and that of a
   set and anything below a node the sum of minima with the node's upper corner.
   What passes keeps its members in one cluster.
4. Clusters get their grams once; an R-tree over the cluster proposes pairs that
   are not yet connected, and exact overlaps decide.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waybill.llm.common import attach_groups, forget, lean, numbered, partitions, stage
from waybill.llm.components import Forest, components
from waybill.llm.textscan import mix64, scans, shingle_hashes

WIDTH = 5
NUM, DEN = 80, 100
#: log2 of the counters in the rarity sketch; its levels, a byte each, are broadcast.
SKETCH_BITS = 20
SEGMENTS = 64
#: Grams a coordinate of a count vector holds on average, at most.
GROUP_GRAMS = 6
LEAF = 32
#: Blocks of up to so many members give their pairs directly.
SMALL = 4
#: Members of a block, or of a part of a cluster, that one task holds at once, and the grams of such a part.
HELD = 4096
HELD_GRAMS = 8 << 20


def needed(n: np.ndarray | int, m: np.ndarray | int):
    """The least overlap of linked sets of n and m grams: ceil(t (n + m) / (1 + t))."""
    return -(-NUM * (n + m) // (NUM + DEN))


def prefix_length(n: int) -> int:
    return n - -(-NUM * n // DEN) + 1


def vector(grams: np.ndarray) -> np.ndarray:
    """Counts of the grams in 2**k groups, with k by the set's size."""
    groups = 8
    while groups * GROUP_GRAMS < len(grams):
        groups *= 2
    return np.bincount((grams & np.uint64(groups - 1)).astype(np.int64), minlength=groups).astype(np.uint16)


def fold(v: np.ndarray, groups: int) -> np.ndarray:
    """The same grams' counts in fewer groups."""
    return v if len(v) == groups else v.reshape(-1, groups).sum(axis=0)


class CountTree:
    """A bulk-loaded R-tree over count vectors, each with its set's size."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        # Order by size and then by the heaviest groups, so that nodes stay small.
        self.order = np.lexsort((points.argmax(axis=1) if points.size else sizes, sizes))
        self.points, self.sizes = points[self.order], sizes[self.order]
        self.levels = []
        high, low_n, high_n = self.points, self.sizes, self.sizes
        while len(high) > 1:
            cut = np.arange(0, len(high), LEAF)
            high, low_n, high_n = np.maximum.reduceat(high, cut), np.minimum.reduceat(low_n, cut), np.maximum.reduceat(high_n, cut)
            self.levels.append((high, low_n, high_n))

    def near(self, point: np.ndarray, n: int) -> np.ndarray:
        """Numbers of the points whose overlap with a set of ``n`` grams at ``point`` may suffice."""
        rows = np.zeros(1, dtype=np.int64) if self.levels else np.arange(len(self.sizes))
        least_n, most_n = -(-NUM * n // DEN), DEN * n // NUM
        for depth in range(len(self.levels) - 1, -1, -1):
            high, low_n, high_n = self.levels[depth]
            rows = rows[(low_n[rows] <= most_n) & (high_n[rows] >= least_n)]
            bound = np.minimum(high[rows], point).sum(axis=1, dtype=np.int64)
            rows = rows[bound >= needed(n, np.maximum(low_n[rows], least_n))]
            below = len(self.levels[depth - 1][1]) if depth else len(self.sizes)
            rows = (rows[:, None] * LEAF + np.arange(LEAF)).ravel()
            rows = rows[rows < below]
        rows = rows[(self.sizes[rows] >= least_n) & (self.sizes[rows] <= most_n)]
        bound = np.minimum(self.points[rows], point).sum(axis=1, dtype=np.int64)
        return self.order[rows[bound >= needed(n, self.sizes[rows])]]


def join_near(vectors: list[np.ndarray], sizes: np.ndarray, forest: Forest, decide) -> None:
    """Join the forest's nodes i and j where ``decide(i, js)`` says so, among pairs that the trees propose.

    Sizes of linked sets differ by a quarter at most, so that vectors have as
    many groups or twice as many; each tree takes those of one length and, as
    queries only, those of twice the length, folded.
    """
    length = np.array([len(v) for v in vectors])
    for groups in np.unique(length).tolist():
        own, twice = np.flatnonzero(length == groups), np.flatnonzero(length == 2 * groups)
        points = np.stack([vectors[i] for i in own]).astype(np.int32)
        tree = CountTree(points, sizes[own])
        # The texts nearest to the middle come first: they connect most.
        middle = np.median(points, axis=0)
        first = np.argsort(np.abs(points - middle).sum(axis=1), kind="stable")
        queries = [(int(own[k]), points[k]) for k in first] + [(int(i), fold(vectors[i], groups).astype(np.int32)) for i in twice]
        for i, point in queries:
            found = own[tree.near(point, int(sizes[i]))]
            root = forest.find(i)
            found = np.array([j for j in found.tolist() if forest.find(j) != root], dtype=np.int64)
            if len(found):
                for j in decide(i, found):
                    forest.join(i, int(j))


def _as_long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _class_of(grams: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(grams.tobytes(), digest_size=8).digest(), "little", signed=True)


def _profile_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of profiles, and at the end the task's sketch in segments."""
    sketch, seen = np.zeros(1 << SKETCH_BITS, dtype=np.uint32), set()
    schema = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("n", pa.int64()), ("cls", pa.int64()), ("vec", pa.binary()), ("segment", pa.int32())])
    for batch in batches:
        doc_ids, rows = batch.column(0), batch.column(1)
        ns, classes, vectors = [], [], []
        for _, scan in scans(batch.column(2), fold=True):
            values, first = shingle_hashes(scan, WIDTH)
            fresh = np.zeros(len(values), dtype=bool)
            for i in range(scan.n_docs):
                grams = values[first[i] : first[i + 1]]
                cls = _class_of(grams) if len(grams) else None
                ns.append(len(grams))
                classes.append(cls)
                vectors.append(vector(grams).tobytes() if len(grams) else None)
                if cls is not None and cls not in seen:
                    seen.add(cls)
                    fresh[first[i] : first[i + 1]] = True
            np.add.at(sketch, (values[fresh] >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), 1)
        yield pa.RecordBatch.from_arrays([doc_ids, rows, pa.array(ns, pa.int64()), pa.array(classes, pa.int64()), pa.array(vectors, pa.binary()), pa.nulls(len(ns), pa.int32())], schema=schema)
    if seen:
        parts = sketch.reshape(SEGMENTS, -1)
        yield pa.RecordBatch.from_pydict({"doc_id": [None] * SEGMENTS, "row": [None] * SEGMENTS, "n": [None] * SEGMENTS, "cls": [None] * SEGMENTS, "vec": [p.astype("<u4").tobytes() for p in parts], "segment": list(range(SEGMENTS))}, schema=schema)


def _levels(table: pa.Table) -> pa.Table:
    total = np.zeros((1 << SKETCH_BITS) // SEGMENTS, dtype=np.int64)
    for blob in table["vec"]:
        total += np.frombuffer(blob.as_py(), dtype="<u4")
    # Half-octave steps keep heavy counters apart and light ones together.
    level = np.floor(4 * np.log2(total + 1)).astype(np.uint8)
    return pa.table({"segment": table["segment"][:1], "level": pa.array([level.tobytes()], pa.binary())})


def _block_batches(levels):
    """From (row, text) to (gram, cls, n) for the rarest grams of each class seen by the task."""
    schema = pa.schema([("gram", pa.int64()), ("cls", pa.int64()), ("n", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = np.frombuffer(levels.value, dtype=np.uint8)
        seen: set[int] = set()
        for batch in batches:
            for _, scan in scans(batch.column(1), fold=True):
                values, first = shingle_hashes(scan, WIDTH)
                rank = level[(values >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                grams, classes, ns = [], [], []
                for i in range(scan.n_docs):
                    own = values[first[i] : first[i + 1]]
                    if not len(own):
                        continue
                    cls = _class_of(own)
                    if cls in seen:
                        continue
                    seen.add(cls)
                    # Grams ascend, so a stable sort by rank breaks ties by gram.
                    rare = np.argsort(rank[first[i] : first[i + 1]], kind="stable")[: prefix_length(len(own))]
                    grams.append(own[rare])
                    classes.append(np.full(len(rare), cls, dtype=np.int64))
                    ns.append(np.full(len(rare), len(own), dtype=np.int32))
                if grams:
                    yield pa.RecordBatch.from_arrays([pa.array(_as_long(np.concatenate(grams))), pa.array(np.concatenate(classes)), pa.array(np.concatenate(ns))], schema=schema)

    return run


def _shared_batches(batches: Iterator[pa.RecordBatch], most: int = HELD) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (gram, n, cls): those whose gram has another class.

    Blocks of up to SMALL members come back as pairs (a, b), larger ones row by
    row with b null; a block beyond ``most`` members is connected in order of
    size.  Each map task may repeat a row; members are counted without repeats,
    so that all parts of a block go one way.
    """
    schema = pa.schema([("gram", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("sure", pa.bool_())])
    held = [np.zeros(0, dtype=np.int64) for _ in range(3)]
    #: The last row of a block that is too large to hold.
    tail: tuple[int, int, int] | None = None

    def out(grams, a, b, sure):
        n = len(a)
        return pa.RecordBatch.from_arrays([pa.array(np.resize(grams, n), pa.int64()), pa.array(a, pa.int64()), b if isinstance(b, pa.Array) else pa.array(b, pa.int64()), pa.array(np.full(n, sure))], schema=schema)

    def work(gram, cls, n):
        nonlocal tail
        if not len(gram):
            return
        start = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
        size = np.diff(np.concatenate([start, [len(gram)]]))
        if tail and tail[0] == gram[0]:
            k = int(size[0])
            near = NUM * n[0] <= DEN * tail[2]
            a, b = np.concatenate([[tail[1]], cls[: k - 1]]), cls[:k]
            ok = np.concatenate([[near], NUM * n[1:k] <= DEN * n[: k - 1]])
            tail = (int(gram[0]), int(cls[k - 1]), int(n[k - 1]))
            if ok.any():
                yield out(gram[:1], a[ok], b[ok], True)
            start, size = start[1:], size[1:]
        per = np.repeat(size, size)
        body = slice(int(start[0]), None) if len(start) else slice(0, 0)
        gram, cls, n = gram[body], cls[body], n[body]
        if not len(gram):
            return
        small = (per >= 2) & (per <= SMALL)
        pairs = []
        for step in range(1, SMALL):
            same = small[: len(gram) - step] & (gram[step:] == gram[: len(gram) - step]) if len(gram) > step else np.zeros(0, dtype=bool)
            i = np.flatnonzero(same)
            i = i[NUM * n[i + step] <= DEN * n[i]]
            pairs.append(np.stack([np.minimum(cls[i], cls[i + step]), np.maximum(cls[i], cls[i + step])], axis=1))
        pairs = np.unique(np.concatenate(pairs), axis=0)
        if len(pairs):
            yield out(np.zeros(1, dtype=np.int64), pairs[:, 0], pairs[:, 1], False)
        large = (per > SMALL) & (per <= most)
        if large.any():
            yield out(gram[large], cls[large], pa.nulls(int(large.sum()), pa.int64()), False)
        huge = np.flatnonzero(per > most)
        if len(huge):
            i = huge[:-1][(gram[huge[:-1]] == gram[huge[1:]]) & (NUM * n[huge[1:]] <= DEN * n[huge[:-1]])]
            if len(i):
                yield out(gram[i[:1]], cls[i], cls[i + 1], True)
            tail = (int(gram[huge[-1]]), int(cls[huge[-1]]), int(n[huge[-1]]))

    for batch in batches:
        new = [batch.column(k).to_numpy().astype(np.int64) for k in range(3)]
        held = [np.concatenate(x) for x in zip(held, new, strict=True)]
        fresh = np.ones(len(held[0]), dtype=bool)
        fresh[1:] = (held[0][1:] != held[0][:-1]) | (held[1][1:] != held[1][:-1])
        if tail and len(fresh):
            # Right after a flush a row may repeat the last one that went out.
            fresh[: np.searchsorted(~((held[0] == tail[0]) & (held[1] == tail[1])), True)] = False
        held = [x[fresh] for x in held]
        last = np.searchsorted(-(held[0][::-1] == held[0][-1]).astype(np.int8), 0) if len(held[0]) else 0
        open_from = len(held[0]) - int(last)
        if open_from == 0 and len(held[0]) <= most:
            continue
        if len(held[0]) - open_from > most:
            # The open block is too large to hold: it goes out in order.
            yield from work(*(x[:open_from] for x in held))
            yield from work(*(x[open_from:] for x in held))
            held = [np.zeros(0, dtype=np.int64) for _ in range(3)]
        else:
            yield from work(*(x[:open_from] for x in held))
            held = [x[open_from:] for x in held]
    yield from work(*held)


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Tables of the rows with equal first ``keys`` columns, of sorted batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(keys)]
        change = np.zeros(batch.num_rows - 1, dtype=bool)
        for c in columns:
            change |= c[1:] != c[:-1]
        if held and any(held[-1].column(k)[-1].as_py() != c[0] for k, c in enumerate(columns)):
            yield pa.Table.from_batches(held)
            held = []
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            held.append(batch.slice(a, b - a))
            if b < batch.num_rows:
                yield pa.Table.from_batches(held)
                held = []
    if held:
        yield pa.Table.from_batches(held)


_EDGE = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _edges_of(forest: Forest, classes: np.ndarray) -> pa.RecordBatch:
    """An edge from each member to its set's root."""
    roots = np.array([forest.find(i) for i in range(len(classes))])
    far = roots != np.arange(len(classes))
    return pa.RecordBatch.from_arrays([pa.array(classes[roots[far]]), pa.array(classes[far])], schema=_EDGE)


def _tree_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (gram, cls, n, vec) sorted by gram: edges that connect what the bound lets pass."""
    for run in _runs(batches, 1):
        classes, sizes = run["cls"].to_numpy(), run["n"].to_numpy()
        vectors = [np.frombuffer(v.as_py(), dtype=np.uint16) for v in run["vec"]]
        forest = Forest(len(classes))
        join_near(vectors, sizes, forest, lambda _, found: found)
        yield _edges_of(forest, classes)


def _pair_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From pairs (a, b, n_a, n_b, vec_a, vec_b): those that the bound lets pass."""
    for batch in batches:
        a, b, n_a, n_b = (batch.column(k).to_numpy() for k in range(4))
        keep = []
        for i, (x, y) in enumerate(zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)):
            x, y = np.frombuffer(x, dtype=np.uint16), np.frombuffer(y, dtype=np.uint16)
            groups = min(len(x), len(y))
            keep.append(int(np.minimum(fold(x, groups), fold(y, groups)).sum()) >= needed(int(n_a[i]), int(n_b[i])))
        keep = np.array(keep, dtype=bool)
        yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], schema=_EDGE)


def _gram_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (unit, part, cls, text) to (unit, part, cls, grams)."""
    for batch in batches:
        blobs = []
        for _, scan in scans(batch.column(3), fold=True):
            values, first = shingle_hashes(scan, WIDTH)
            blobs += [values[first[i] : first[i + 1]].tobytes() for i in range(scan.n_docs)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(blobs, pa.binary())], ["unit", "part", "cls", "grams"])


class _Overlaps:
    """Exact overlaps of one set with many, through lists of who has each gram."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets = sets
        self.sizes = np.array([len(s) for s in sets])
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        grams = np.concatenate(sets)
        order = np.argsort(grams, kind="stable")
        self.owner = owner[order]
        grams = grams[order]
        start = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
        self.grams, self.start, self.end = grams[start], start, np.concatenate([start[1:], [len(grams)]])

    def linked(self, i: int, found: np.ndarray) -> np.ndarray:
        if len(found) <= 4:
            overlap = np.array([len(np.intersect1d(self.sets[i], self.sets[j], assume_unique=True)) for j in found])
        else:
            at = np.searchsorted(self.grams, self.sets[i])
            count = self.end[at] - self.start[at]
            ends = np.cumsum(count)
            index = np.arange(int(ends[-1])) + np.repeat(self.start[at] - (ends - count), count)
            overlap = np.bincount(self.owner[index], minlength=len(self.sets))[found]
        return found[overlap >= needed(self.sizes[i], self.sizes[found])]


def _verify_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (unit, part, cls, grams) sorted by unit: edges that span the links of each unit."""
    for run in _runs(batches, 1):
        classes = run["cls"].to_numpy()
        _, once = np.unique(classes, return_index=True)
        blobs = run["grams"]
        classes = classes[once]
        sets = [np.frombuffer(blobs[int(i)].as_py(), dtype=np.uint64) for i in once]
        forest, exact = Forest(len(sets)), _Overlaps(sets)
        join_near([vector(s) for s in sets], exact.sizes, forest, exact.linked)
        yield _edges_of(forest, classes)


def profile(rows: DataFrame) -> tuple[DataFrame, bytes]:
    """Profiles (doc_id, row, n, cls, vec) of ``rows`` (doc_id, row, text), and the sketch's levels."""
    seen = stage(rows.mapInArrow(lean(_profile_batches), "doc_id long, row long, n long, cls long, vec binary, segment int"), "profiles")
    levels = seen.where("segment is not null").select("segment", "vec").groupBy("segment").applyInArrow(_levels, "segment int, level binary")
    by_segment = {r.segment: bytes(r.level) for r in levels.collect()}  # SEGMENTS rows, 1 << SKETCH_BITS bytes in all
    empty = bytes((1 << SKETCH_BITS) // SEGMENTS)
    return seen.where("segment is null").drop("segment"), b"".join(by_segment.get(s, empty) for s in range(SEGMENTS))


def link_classes(docs: DataFrame, profiles: DataFrame, levels: bytes, most: int = HELD) -> DataFrame:
    """(node, label): the classes that have links, with their component's smallest class.

    ``docs`` (row, text) has the rows of ``profiles``; ``most`` stands for HELD.
    """
    spark = docs.sparkSession
    n = partitions(spark)
    held = spark.sparkContext.broadcast(levels)
    # One row a class: its first text stands for it.
    reps = stage(profiles.where("n > 0").groupBy("cls").agg(F.min(F.struct("row", "n", "vec")).alias("rep")).select("cls", "rep.row", "rep.n", "rep.vec"), "classes")
    rows = docs.select("row", "text")

    rare = rows.mapInArrow(lean(_block_batches(held)), "gram long, cls long, n int")
    sorted_ = rare.repartition(n, "gram").sortWithinPartitions("gram", "n", "cls")
    shared = stage(sorted_.mapInArrow(lean(lambda batches: _shared_batches(batches, most)), "gram long, a long, b long, sure boolean"), "shared")

    points = reps.select("cls", "n", "vec")
    blocks = shared.where("b is null").select("gram", F.col("a").alias("cls")).join(points, "cls").select("gram", "cls", "n", "vec")
    in_blocks = blocks.repartition(n, "gram").sortWithinPartitions("gram", "cls").mapInArrow(lean(_tree_batches), "a long, b long")
    pairs = shared.where("b is not null and not sure").select("a", "b").distinct()
    pairs = pairs.join(points.toDF("a", "n_a", "vec_a"), "a").join(points.toDF("b", "n_b", "vec_b"), "b")
    in_pairs = pairs.select("a", "b", "n_a", "n_b", "vec_a", "vec_b").mapInArrow(lean(_pair_batches), "a long, b long")
    sure = shared.where("sure").select("a", "b")
    clusters = components(in_blocks.union(in_pairs).union(sure)).select(F.col("node").alias("cls"), F.col("label").alias("cluster"))

    joined = stage(clusters.join(reps.select("cls", "row", "n"), "cls"), "members")
    # Sizes of linked sets differ by a quarter at most: a member meets its own band and the next.
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(DEN / NUM)) + 1e-9).cast("int")
    members = joined.withColumn("band", band)
    sizes = members.groupBy("cluster").agg(((F.count(F.lit(1)) <= most) & (F.sum("n") <= HELD_GRAMS)).alias("whole"))
    bands = members.groupBy("cluster", "band").agg(F.ceil(F.greatest(F.count(F.lit(1)) * 2 / most, F.sum("n") * 2 / HELD_GRAMS)).cast("int").alias("parts"))
    following = bands.select("cluster", (F.col("band") - 1).alias("band"), F.col("parts").alias("next_parts"))
    before = bands.select("cluster", (F.col("band") + 1).alias("band"), F.col("parts").alias("last_parts"))
    bands = bands.join(following, ["cluster", "band"], "left").join(before, ["cluster", "band"], "left").na.fill(0)
    dealt = members.join(sizes, "cluster").join(bands, ["cluster", "band"]).withColumn("part", F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int"))

    def name(band_, part, other_band, other):
        return F.concat_ws("/", F.lit("u"), F.col("cluster").cast("string"), band_.cast("string"), part.cast("string"), other_band.cast("string"), other.cast("string"))

    b, p = F.col("band"), F.col("part")
    same = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda q: name(b, F.least(p, q), b, F.greatest(p, q)))
    up = F.when(F.col("next_parts") > 0, F.transform(F.sequence(F.lit(0), F.col("next_parts") - 1), lambda q: name(b, p, b + 1, q))).otherwise(F.array().cast("array<string>"))
    down = F.when(F.col("last_parts") > 0, F.transform(F.sequence(F.lit(0), F.col("last_parts") - 1), lambda q: name(b - 1, q, b, p))).otherwise(F.array().cast("array<string>"))
    alone = F.array(F.concat(F.lit("c/"), F.col("cluster").cast("string")))
    units = F.when(F.col("whole"), alone).otherwise(F.concat(same, up, down))
    dealt = dealt.select("row", "cls", "part", units.alias("units"))
    texts = rows.join(dealt.hint("shuffle_hash"), "row").select(F.explode("units").alias("unit"), "part", "cls", "text")
    grams = texts.mapInArrow(lean(_gram_batches), "unit string, part int, cls long, grams binary")
    links = grams.repartition(n, "unit").sortWithinPartitions("unit", "cls").mapInArrow(lean(_verify_batches), "a long, b long")
    out = components(links)
    forget(reps, shared, joined)
    return out


def ngram_join(docs: DataFrame, key: str | None = None, most: int = HELD) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, row, n_shingles, component_id, component_row.

    component_id is the smallest doc_id reachable by links, the row's own
    included, and component_row the row it stands in.  Texts under five words have their whole sequence as one gram; a
    null text or one without words has none and links with nothing, so its
    component_id is its own doc_id.  Repeated rows link with each other.  A null
    doc_id is never the smallest unless the whole component has none.  Grams and
    classes are told apart by 64-bit hashes.  Without rows the result is empty.
    ``row`` is the caller's ``key``, if one is named; other columns are not read.
    ``most`` members of a block or of a part of a cluster are held at once; it
    changes no result.
    """
    rows = numbered(docs, F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), key=key).select("doc_id", "row", "text")
    profiles, levels = profile(rows)
    labels = link_classes(rows, profiles, levels, most)
    classes = profiles.where("n > 0").groupBy("cls").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("least"), F.count(F.lit(1)).alias("copies"))
    classes = classes.join(labels.select(F.col("node").alias("cls"), "label"), "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    classes = stage(classes, "components")
    forget(labels)
    groups = classes.groupBy("label").agg(F.min("least").alias("first"), F.sum("copies").alias("members"))
    groups = groups.select("label", F.col("first.doc_id").alias("component_id"), F.col("first.row").alias("component_row"), "members")
    by_class = stage(attach_groups(classes, groups, "label", "members", F.col("cls")).select("cls", "component_id", "component_row", "copies"), "class_components")
    own = profiles.select("doc_id", "row", "n", F.coalesce(F.col("cls").cast("string"), F.concat(F.lit("none"), F.col("row").cast("string"))).alias("ckey"))
    out = attach_groups(own, by_class.select(F.col("cls").cast("string").alias("ckey"), "component_id", "component_row", "copies"), "ckey", "copies", F.col("row"))
    alone = F.col("n") == 0
    return out.select("doc_id", "row", F.col("n").alias("n_shingles"), F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.when(alone, F.col("row")).otherwise(F.col("component_row")).alias("component_row"))
