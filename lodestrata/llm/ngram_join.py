"""N-gram Jaccard self-join of texts by count-vector R-trees.

A text's set holds the hashes of its distinct runs of `width` words. Hashes fall into GROUPS equal ranges; the counts by range
are the set's point; large sets have more ranges, in halves of those, as full ranges tell nothing apart. For two sets the overlap is at most the sum, over the ranges, of the smaller of the two counts; for a set and
an R-tree node, of the set's count and the node's largest. Sets of at least the needed similarity have an overlap of
t / (1 + t) of their sizes' sum, so nodes and points under that are passed over, and pairs that remain are verified on the sets.

To spread the work, sets are first cut into parts that surely bring all pairs together: sizes fall into bands, and in each band (and,
for sets within reach of the next band's least size, that one too) the hash range is cut into more parts than two such sets
can differ in elements, by a spare share. So more parts are equal than are spare, and a part's digest brings its sets together.
As that many may be spared, a set leaves out its parts without elements, then those of one, then its most frequent ones, in an
order that is the same for all sets: of the parts that two sets share the last in this order is left out by neither. Sets with
more empty parts than are spare bring their single elements instead, without the most frequent ones.

Digests that a sample of the sets shows in about HOT sets or more are the frequent ones; the sample only steers. What is left
of them links its sets to the least one, in tasks of any cut. Other digests have their sets in one task: up to SMALL sets are pairs,
more go through an R-tree, and only candidates whose bound allows the similarity are linked. The components of these links are
blocks: a block's sets are gathered, packed into an R-tree, and each set asks it for partners outside its own component; a verified
link joins components at once, and what is near a few pivots asks no more, so a group of n mutual near copies takes about n
verifications, not n squared. Blocks of more than CAP sets or ELEMENTS elements are cut into tiles: first each is joined in itself, then
some leaders of the tiles; then only sets outside the block's largest component still meet its other tiles.

Equal sets are one class, represented by the smallest (doc_id, text). Memory is bounded by the Arrow batch and by two tiles.

Defined results: a null or wordless text has no set and links with nothing; a text of fewer words has its whole sequence as its
one element. Each row has the result of its own text, rows that share an id too, and equal rows come back as often as they went in.
Rows with a null id form components like others; the smallest non-null id names one, null if there is none. Other columns are
not read. Sets are told apart by 128-bit hashes, their elements by 64-bit ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestrata.llm._shared import byte_chunks, mixed, staged, table, word_hashes, word_spans

GROUPS, CAP, LEAF, SMALL = 64, 4096, 16, 8
#: Elements in a range, where there may be more than GROUPS ranges.
FULL = 8
#: Elements of a tile at most, but for a set that has more; one set in SAMPLE looks for digests in about HOT sets or more.
ELEMENTS, SAMPLE, HOT = 2_000_000, 64, 2048
PIVOTS, LEADERS = 3, 8
#: Frequent digests, or hashes of texts in blocks, that may be broadcast, 20 bytes each.
BROADCAST_ROWS = 500_000
ODD = [np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each row of a chunk, one after another, and where each row's begin."""
    n = len(offsets) - 1
    low = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    starts, ends, row = word_spans(~((low == 32) | ((low >= 9) & (low <= 13))), offsets)
    h = word_hashes(low, starts, ends)
    count = np.bincount(row, minlength=n)
    whole = np.zeros(len(h), np.uint64)
    for k in range(min(width, len(h))):
        whole[: len(h) - k] += mixed(h[k:] + np.uint64((k + 1) * 0xD6E8FEB86659FD93 % (1 << 64))) * ODD[k % len(ODD)]
    first = np.concatenate([[0], np.cumsum(count)])[:-1]
    place = np.arange(len(h)) - first[row]
    full = place + width <= count[row]
    short = np.flatnonzero((count > 0) & (count < width))
    more = np.array([mixed(np.array([sum(int(x) * (2 * j + 3) for j, x in enumerate(h[first[i] : first[i] + count[i]])) % (1 << 64)], np.uint64))[0] for i in short], np.uint64)
    rows, values = np.concatenate([row[full], short]), mixed(np.concatenate([whole[full], more]))
    order = np.lexsort((values, rows))
    rows, values = rows[order], values[order]
    fresh = np.ones(len(rows), bool)
    fresh[1:] = (rows[1:] != rows[:-1]) | (values[1:] != values[:-1])
    rows, values = rows[fresh], values[fresh]
    return values, np.searchsorted(rows, np.arange(n + 1))


class Bands:
    """The size bands for a similarity: where they begin, and how many parts each needs."""

    def __init__(self, similarity: Fraction, ratio: float = 0.65):
        self.t, self.edges, self.parts, self.spare = similarity, [1], [], []
        while self.edges[-1] < 1 << 40:
            self.edges.append(max(self.edges[-1] + 1, int(self.edges[-1] / ratio)))
        for least, end in zip(self.edges, self.edges[1:], strict=False):
            # partners of a key have sizes up to end - 1, and so differ in at most this many elements
            most = int(2 * (end - 1) * (1 - similarity) / (1 + similarity))
            self.spare.append((most + 1) * 3 // 10 + 3 if most else 0)
            self.parts.append(most + 1 + self.spare[-1])
        self.edges, self.parts, self.spare = np.array(self.edges), np.array(self.parts), np.array(self.spare)

    def of(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.edges, sizes, side="right") - 1

    def reaches_next(self, sizes: np.ndarray, band: np.ndarray) -> np.ndarray:
        return sizes * self.t.denominator >= self.edges[band + 1] * self.t.numerator


def part_digests(values: np.ndarray, starts: np.ndarray, key: np.ndarray, bands: Bands, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(set, digest, mark) of the parts of the sets numbered `which`, as cut for band `key` of each.

    A mark is 128 times the number of digests with this mark that the set may still leave out, plus the key; for single elements 64 more.
    """
    size = np.diff(starts)[which]
    owner = np.repeat(np.arange(len(which)), size)
    at = np.repeat(starts[which] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
    own, parts, spare = values[at], bands.parts[key], bands.spare[key]
    part = ((own >> np.uint64(32)) * parts[owner].astype(np.uint64)) >> np.uint64(32)
    fresh = np.ones(len(own), bool)
    fresh[1:] = (owner[1:] != owner[:-1]) | (part[1:] != part[:-1])
    first = np.flatnonzero(fresh)
    salt = mixed(part[first] * np.uint64(4096) + key[owner[first]].astype(np.uint64))
    digest = mixed((np.add.reduceat(mixed(own), first) if len(first) else np.zeros(0, np.uint64)) + salt)
    who, count = owner[first], np.diff(np.append(first, len(own)))
    empty = parts - np.bincount(who, minlength=len(which))
    thin = np.bincount(who[count == 1], minlength=len(which))
    few = empty + thin > spare  # then thin parts stay, and are those that may be left out
    free = np.maximum(np.where(few, spare - empty, spare - empty - thin), 0)
    keep = (count > 1) | few[who]
    mark = np.where((count == 1) == few[who], free[who], 0) * 128 + key[who]
    bare = (empty > spare) & (parts > 1)
    single = bare[owner]
    spared = np.array([max(0, ceil(bands.t * int(n)) - 1) for n in size[bare]], np.int64)
    left_out = np.zeros(len(which), np.int64)
    left_out[bare] = spared
    alone = mixed(own[single] ^ mixed(key[owner[single]].astype(np.uint64) + ODD[3]))
    return (
        np.concatenate([which[who[keep]], which[owner[single]]]),
        np.concatenate([digest[keep], alone]),
        np.concatenate([mark[keep], left_out[owner[single]] * 128 + 64 + key[owner[single]]]),
    )


SKETCH = "doc_id long, text_hash long, n long, set long, other long, counts binary, parts array<long>, marks array<long>"


def set_digests(values: np.ndarray, starts: np.ndarray, salt: np.uint64 = ODD[1]) -> np.ndarray:
    """A number for each set's contents; 0 for none."""
    n = np.diff(starts)
    some = np.flatnonzero(n)
    out = np.zeros(len(n), np.uint64)
    if len(some):
        out[some] = mixed(np.add.reduceat(mixed(values + salt), starts[some]) + n[some].astype(np.uint64))
    return out.view(np.int64)


def groups_for(n: np.ndarray) -> np.ndarray:
    """How many ranges a set of n elements is counted in: GROUPS, doubled until about FULL elements are in each."""
    return GROUPS << np.clip(np.ceil(np.log2(np.maximum(n, 1) / (FULL * GROUPS))), 0, 6).astype(np.int64)


def points_of(values: np.ndarray, starts: np.ndarray, groups: int) -> np.ndarray:
    """Counts of each set's hashes in so many equal ranges."""
    n = len(starts) - 1
    row = np.repeat(np.arange(n), np.diff(starts))
    part = (values >> np.uint64(64 - groups.bit_length() + 1)).astype(np.int64)
    counts = np.bincount(row * groups + part, minlength=n * groups).reshape(n, groups)
    return counts.astype(np.uint16 if counts.max(initial=0) < 1 << 16 else np.uint32)


def packed_points(values: np.ndarray, starts: np.ndarray) -> list[bytes]:
    """Each set's counts in its own number of ranges, a byte each; where one exceeds 255, four."""
    size = np.diff(starts)
    groups = groups_for(size)
    out: list = [b""] * len(size)
    for g in np.unique(groups).tolist():
        for i in np.flatnonzero(groups == g).tolist():
            own = np.bincount((values[starts[i] : starts[i + 1]] >> np.uint64(64 - g.bit_length() + 1)).astype(np.int64), minlength=g)
            out[i] = own.astype(np.uint8 if own.max(initial=0) < 256 else "<u4").tobytes()
    return out


def unpacked(raw: list[bytes], sizes: np.ndarray) -> np.ndarray:
    """The counts of all of raw in the fewest ranges that any has; ranges that are too fine are added up."""
    groups = groups_for(sizes)
    least = int(groups.min(initial=GROUPS << 6))
    out = np.zeros((len(raw), least), np.uint32)
    for i, (r, g) in enumerate(zip(raw, groups.tolist(), strict=True)):
        own = np.frombuffer(r, np.uint8 if len(r) == g else "<u4")
        out[i] = own if g == least else own.reshape(least, -1).sum(1)
    return out.astype(np.uint16) if out.max(initial=0) < 1 << 16 else out


def sketch(width: int, bands: Bands):
    """Arrow batches of (doc_id, text, text_hash) as rows of SKETCH. Of equal sets in a batch only the first carries its parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(i, 2000) for whole in batches for i in range(0, whole.num_rows, 2000)):
            base, names, others, sizes, points, found = 0, [], [], [], [], []
            for _, _, data, offsets in byte_chunks(batch.column(1)):
                values, starts = shingle_sets(data, offsets, width)
                n = np.diff(starts)
                names.append(set_digests(values, starts))
                others.append(set_digests(values, starts, ODD[2]))
                sizes.append(n)
                points += packed_points(values, starts)
                some = np.flatnonzero(n)
                some = some[np.unique(names[-1][some], return_index=True)[1]]
                some.sort()
                band = bands.of(n[some])
                more = bands.reaches_next(n[some], band)
                for which, key in ((some, band), (some[more], band[more] + 1)):
                    who, digest, mark = part_digests(values, starts, key, bands, which)
                    found.append((who + base, digest.view(np.int64), mark))
                base += len(n)
            if not base:
                continue
            names, others, sizes = np.concatenate(names), np.concatenate(others), np.concatenate(sizes)
            sets, digests, marks = (np.concatenate(c) for c in zip(*found, strict=True))
            first = np.zeros(base, bool)
            first[np.unique(names, return_index=True)[1]] = True
            sets, digests, marks = (c[first[sets]] for c in (sets, digests, marks))
            order = np.argsort(sets, kind="stable")
            ends = pa.array(np.searchsorted(sets[order], np.arange(base + 1)), pa.int32())
            parts, marks = (pa.ListArray.from_arrays(ends, pa.array(c[order], pa.int64())) for c in (digests, marks))
            columns = [batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(names), pa.array(others), pa.array(points, pa.binary()), parts, marks]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "n", "set", "other", "counts", "parts", "marks"])

    return run


def shared_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, set) rows sorted by both: pairs (a, b) of the groups of 2 to SMALL sets, and (part, a) rows of larger groups.

    A group's rows are looked at with those SMALL before and after them, so groups of any size pass as a stream.
    """
    part = own = np.zeros(0, np.int64)
    done = 0  # rows of the window that went out before

    def out(stop: int) -> pa.RecordBatch:
        edge = np.flatnonzero(np.diff(part, prepend=part[:1] - 1))
        size = np.diff(np.append(edge, len(part)))
        group = np.repeat(np.arange(len(edge)), size)
        place = np.arange(len(part)) - edge[group]
        here = np.arange(len(part))
        mine = (here >= done) & (here < stop)
        large = np.flatnonzero(mine & (size[group] > SMALL))
        a, b = [], []
        for step in range(1, SMALL):
            i = np.flatnonzero(mine & (size[group] <= SMALL) & (place >= step))
            a.append(own[i - step])
            b.append(own[i])
        a, b = np.concatenate(a), np.concatenate(b)
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
        none = pa.nulls(len(pairs), pa.int64())
        return pa.RecordBatch.from_arrays([pa.concat_arrays([none, pa.array(part[large], pa.int64())]), pa.concat_arrays([pa.array(pairs[:, 0]), pa.array(own[large], pa.int64())]), pa.concat_arrays([pa.array(pairs[:, 1]), pa.nulls(len(large), pa.int64())])], ["part", "a", "b"])

    for batch in batches:
        p, d = np.concatenate([part, batch.column(0).to_numpy()]), np.concatenate([own, batch.column(1).to_numpy()])
        fresh = np.ones(len(p), bool)
        fresh[1:] = (p[1:] != p[:-1]) | (d[1:] != d[:-1])
        part, own = p[fresh], d[fresh]  # what was held has no repeats, so `done` still fits
        stop = max(done, len(part) - SMALL - 1)
        if stop > done:
            yield out(stop)
            keep = max(0, stop - SMALL - 1)
            part, own, done = part[keep:], own[keep:], stop - keep
    if len(part) > done:
        yield out(len(part))


def bound_links(t: Fraction):
    """(part, a, n, counts) rows sorted by part: pairs (a, b) that connect what the bound lets be similar in each group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, names, sizes, raw = None, [], [], []

        def links() -> pa.RecordBatch:
            found = np.array(connect(unpacked(raw, np.array(sizes)), np.array(sizes), t), np.int64).reshape(-1, 2)
            own = np.array(names, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(own[found[:, 0]]), pa.array(own[found[:, 1]])], ["a", "b"])

        for batch in (whole.slice(i, 1024) for whole in batches for i in range(0, whole.num_rows, 1024)):
            for part, name, n, counts in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if part != at:
                    if names:
                        yield links()
                    at, names, sizes, raw = part, [], [], []
                names.append(name)
                sizes.append(n)
                raw.append(counts)
        if names:
            yield links()

    return run


def within_bound(t: Fraction):
    """(a, b, na, nb, ca, cb) rows: the pairs whose bound allows the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, q = t.numerator, t.denominator
        for batch in (whole.slice(i, 1024) for whole in batches for i in range(0, whole.num_rows, 1024)):
            n, m = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            level = np.minimum(groups_for(n), groups_for(m))
            keep = np.zeros(len(n), bool)
            for g in np.unique(level).tolist():  # pairs that are counted in as many ranges
                own = np.flatnonzero(level == g)
                some = batch.take(pa.array(own))
                both = unpacked(some.column(4).to_pylist() + some.column(5).to_pylist(), np.concatenate([n[own], m[own]]))
                bound = np.minimum(both[: len(own)], both[len(own) :]).sum(1, dtype=np.int64)
                keep[own] = bound * (p + q) >= p * (n[own] + m[own])
            yield batch.filter(pa.array(keep)).select(["a", "b"])

    return run


def components(edges: DataFrame, name: str = "links") -> DataFrame:
    """(node, root) for the nodes of edges (a, b): each root is its component's smallest node.

    Every node takes the least label around it and labels are then replaced by their own label, so paths halve each round;
    rounds end when no label moves. Each round is written to the shared folder.
    """
    ways = F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("other")), F.struct(F.col("b").alias("node"), F.col("a").alias("other"))))
    both = staged(edges.select(ways.alias("e")).select("e.*").distinct(), f"{name}-edges")
    state = staged(both.groupBy("node").agg(F.min("other").alias("least")).select("node", F.least("node", "least").alias("root")), name)
    while True:
        around = both.join(state.toDF("other", "r"), "other").groupBy("node").agg(F.min("r").alias("around"))
        lowered = state.join(around, "node").select("node", F.col("root").alias("old"), F.least("root", "around").alias("root"))
        # the old root also learns of the lower label, so whole trees move, not single nodes
        told = lowered.where("root < old").groupBy(F.col("old").alias("node")).agg(F.min("root").alias("told"))
        lowered = lowered.join(told, "node", "left").select("node", "old", F.least("root", "told").alias("root"))
        jump = lowered.select(F.col("node").alias("root"), F.col("root").alias("further"))
        after = staged(lowered.join(jump, "root", "left").select("node", "old", F.coalesce("further", "root").alias("root")), name)
        moved = after.where("root != old").limit(1).count()
        state = after.select("node", "root")
        if not moved:
            return state


class Tree:
    """An R-tree over count vectors: sorted by size and by the two widest counts, packed LEAF to a node, level on level."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        order = np.lexsort((*[points[:, g] for g in np.argsort(points.var(0))[-2:]], sizes))
        self.order, self.points, self.sizes = order, points[order], sizes[order]
        self.levels = []  # from leaves up: the largest counts, the least and the largest size of each node
        top, least, most = self.points, self.sizes, self.sizes
        while len(top) > LEAF:
            at = np.arange(0, len(top), LEAF)
            top, least, most = np.maximum.reduceat(top, at), np.minimum.reduceat(least, at), np.maximum.reduceat(most, at)
            self.levels.append((top, least, most))

    def ask(self, point: np.ndarray, size: int, t: Fraction) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the points whose bound allows similarity t, and their bounds."""
        p, q = t.numerator, t.denominator
        nodes = np.arange(len(self.levels[-1][0])) if self.levels else np.arange(len(self.points))
        for depth in range(len(self.levels) - 1, -1, -1):
            top, least, most = self.levels[depth]
            bound = np.minimum(point, top[nodes]).sum(1, dtype=np.int64)
            fits = (bound * (p + q) >= p * (size + least[nodes])) & (least[nodes] * p <= q * size) & (most[nodes] * q >= p * size)
            below = len(self.levels[depth - 1][0]) if depth else len(self.points)
            nodes = (nodes[fits][:, None] * LEAF + np.arange(LEAF)).ravel()
            nodes = nodes[nodes < below]
        bound = np.minimum(point, self.points[nodes]).sum(1, dtype=np.int64)
        fits = bound * (p + q) >= p * (size + self.sizes[nodes])
        return self.order[nodes[fits]], bound[fits]


def similar(a: np.ndarray, b: np.ndarray, t: Fraction) -> bool:
    """Whether two sorted sets have at least the similarity."""
    at = np.searchsorted(a, b)
    both = int((a[np.minimum(at, len(a) - 1)] == b).sum())
    return both * t.denominator >= t.numerator * (len(a) + len(b) - both)


def connect(points: np.ndarray, sizes: np.ndarray, t: Fraction, accept=lambda i, j: True, label: np.ndarray | None = None, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Accepted pairs within the bound that connect components: a spanning forest.

    label: the components there are already. side: those of side 0 ask those of side 1, and no others do.
    """
    n, links = len(sizes), []
    label = np.arange(n) if label is None else np.unique(label, return_inverse=True)[1]

    def try_all(i: int, found: np.ndarray) -> None:
        while len(found := found[label[found] != label[i]]):
            j, found = int(found[0]), found[1:]
            if accept(i, j):
                links.append((i, j))
                label[label == label[i]] = label[j]

    if side is None:
        for _ in range(PIVOTS):
            rest = np.flatnonzero(label != np.bincount(label).argmax())
            if not len(rest):
                return links
            i = int(rest[0])
            bound = np.minimum(points, points[i]).sum(1, dtype=np.int64)
            for j in np.flatnonzero(bound * (t.numerator + t.denominator) >= t.numerator * (sizes + sizes[i])).tolist():
                if label[j] != label[i] and accept(i, j):
                    links.append((i, j))
                    label[label == label[j]] = label[i]
        asking, among = np.flatnonzero(label != np.bincount(label).argmax()), np.arange(n)
    else:
        asking, among = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    tree = Tree(points[among], sizes[among])
    asks = np.zeros(n, bool)
    asks[asking] = side is None
    for i in asking.tolist():
        found, bound = tree.ask(points[i], int(sizes[i]), t)
        nearest = np.argsort(sizes[among[found]] - 2 * bound, kind="stable")
        found = among[found[nearest]]
        try_all(i, found[~asks[found] | (found < i)])  # of two that ask, one does
    return links


def every_pair(points: np.ndarray, sizes: np.ndarray, t: Fraction, accept, side: np.ndarray | None) -> list[tuple[int, int]]:
    """All accepted pairs within the bound; with `side`, those across sides."""
    asking, among = (np.arange(len(sizes)),) * 2 if side is None else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
    tree, links = Tree(points[among], sizes[among]), []
    for i in asking.tolist():
        found = among[tree.ask(points[i], int(sizes[i]), t)[0]]
        links += [(i, j) for j in found.tolist() if (side is not None or j < i) and accept(i, j)]
    return links


def verify(width: int, t: Fraction, every: bool = False):
    """Texts sorted by (unit, set, side) as links (a, b) between the sets of one unit; a run of rows is a unit."""

    def links(sets: list[np.ndarray], names: list[int], sides: list[int], roots: list[int]) -> pa.RecordBatch:
        side = np.array(sides) if any(sides) else None
        found = []
        if len(sets) > 1:
            sizes = np.array([len(x) for x in sets])
            points = points_of(np.concatenate(sets), np.concatenate([[0], np.cumsum(sizes)]), int(groups_for(np.median(sizes))))
            accept = lambda i, j: similar(sets[i], sets[j], t)
            found = every_pair(points, sizes, t, accept, side) if every else connect(points, sizes, t, accept, np.array(roots), side)
        own, found = np.array(names, np.int64), np.array(found, np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(own[found[:, 0]]), pa.array(own[found[:, 1]])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, last, held = None, None, ([], [], [], [])
        for batch in (whole.slice(i, 256) for whole in batches for i in range(0, whole.num_rows, 256)):
            unit, name, side, root = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("unit", "set", "side", "root"))
            sets: list[np.ndarray] = []
            for _, _, data, offsets in byte_chunks(batch.column(batch.schema.get_field_index("text"))):
                values, starts = shingle_sets(data, offsets, width)
                sets += [values[a:b].copy() for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
            for key, *row in zip(unit, name, side, root, sets, strict=True):
                if key != at:
                    if held[0]:
                        yield links(held[3], held[0], held[1], held[2])
                    at, last, held = key, None, ([], [], [], [])
                if last != row[:2]:  # equal rows are the same text again
                    last = row[:2]
                    for column, value in zip(held, row, strict=True):
                        column.append(value)
        if held[0]:
            yield links(held[3], held[0], held[1], held[2])

    return run


def meeting(t: Fraction):
    """(unit, set, side, root, n, counts) rows sorted by unit: those that the bound lets be similar to one of another root across the unit's sides."""
    columns = ["unit", "set", "side", "root"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def needed() -> pa.RecordBatch:
            side, root, sizes = (np.array([h[i] for h in held], np.int64) for i in (2, 3, 4))
            points, keep = unpacked([h[5] for h in held], sizes), np.zeros(len(held), bool)
            asking, among = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            if len(asking) and len(among):
                tree = Tree(points[among], sizes[among])
                for i in asking.tolist():
                    found = among[tree.ask(points[i], int(sizes[i]), t)[0]]
                    found = found[root[found] != root[i]]
                    keep[found] = True
                    keep[i] |= len(found) > 0
            some = [h for h, k in zip(held, keep.tolist(), strict=True) if k]
            return pa.RecordBatch.from_arrays([pa.array([h[i] for h in some], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int64()))], columns)

        for batch in (whole.slice(i, 1024) for whole in batches for i in range(0, whole.num_rows, 1024)):
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[0] != at and held:
                    yield needed()
                    held = []
                at = row[0]
                held.append(row)
        if held:
            yield needed()

    return run


def tile_count(sets: Column, elements: Column) -> Column:
    return F.greatest(F.ceil(sets / CAP), F.ceil(elements / ELEMENTS)).cast("int")


def candidate_edges(sets: DataFrame, classes: DataFrame, t: Fraction) -> DataFrame:
    """Edges (a, b) whose components hold all similar pairs."""
    spark = sets.sparkSession
    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = sets.select("set", F.explode(F.arrays_zip("parts", "marks")).alias("p")).select(F.col("p.parts").alias("part"), "set", F.col("p.marks").alias("mark"))
    sampled = sets.where(F.pmod(F.xxhash64("set"), F.lit(SAMPLE)) == 0).select("set", F.explode("parts").alias("part")).distinct()
    listed = staged(sampled.groupBy("part").count().where(F.col("count") >= HOT // SAMPLE).select("part"), "hot")
    small = (lambda d: F.broadcast(d)) if listed.count() <= BROADCAST_ROWS else (lambda d: d)
    cold = rows.join(small(listed), "part", "left_anti").select("part", "set")
    shared = staged(cold.repartition(spread, "part").sortWithinPartitions("part", "set").mapInArrow(shared_parts, "part long, a long, b long"), "shared")
    hot = staged(rows.join(small(listed), "part").distinct(), "hot-rows")
    counted = hot.join(small(hot.groupBy("part").count()), "part")
    place = F.row_number().over(W.partitionBy("set", "mark").orderBy(F.desc("count"), "part"))
    kept = staged(counted.withColumn("place", place).where(F.col("place") > F.shiftright("mark", 7)).select("part", "set").distinct(), "hot-kept")
    stars = kept.join(small(kept.groupBy("part").agg(F.min("set").alias("first"))), "part").where("set != first").select(F.col("set").alias("a"), F.col("first").alias("b")).distinct()
    of = lambda c: classes.select(F.col("set").alias(c), F.col("n").alias(f"n{c}"), F.col("counts").alias(f"c{c}"))
    pairs = shared.where("b is not null").select("a", "b").distinct()
    near = pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "na", "nb", "ca", "cb").mapInArrow(within_bound(t), "a long, b long")
    groups = shared.where("b is null").select("part", "a").join(of("a"), "a").select("part", "a", "na", "ca").repartition(spread, "part").sortWithinPartitions("part", "a")
    return near.unionByName(groups.mapInArrow(bound_links(t), "a long, b long")).unionByName(stars)


class Join:
    """The stages of a join: sketches, classes of equal sets, blocks of candidates, and verified links between their sets."""

    def __init__(self, docs: DataFrame, width: int, similarity: Fraction, doc_id: str = "doc_id", text: str = "text"):
        self.width, self.t = width, similarity
        self.spread = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        self.source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("text_hash"))
        self.texts = self.source.withColumnRenamed("doc_id", "_id").withColumnRenamed("text_hash", "_hash")
        base = staged(self.source.mapInArrow(sketch(width, Bands(similarity)), SKETCH), "sketches")
        self.base, self.classes = base, self._classes(base)
        clashing = self.classes.where("other != last").select("set")
        if clashing.count():  # two sets under one number: they take numbers of both their hashes
            clash = clashing.withColumn("_clash", F.lit(True))
            renamed = base.join(clash, "set", "left").withColumn("set", F.when(F.col("_clash"), F.xxhash64("set", "other")).otherwise(F.col("set")))
            self.base = staged(renamed.select(*base.columns), "sketches")
            self.classes = self._classes(self.base)

    def _classes(self, base: DataFrame) -> DataFrame:
        row = F.min(F.struct("doc_id", "text_hash"))
        each = base.where("n > 0").groupBy("set").agg(F.min("doc_id").alias("least"), row.alias("row"), F.min("n").alias("n"), F.min("counts").alias("counts"), F.min("other").alias("other"), F.max("other").alias("last"))
        return staged(each.select("set", "least", "row.*", "n", "counts", "other", "last"), "classes")

    def placed(self) -> DataFrame:
        """The classes in blocks of more than one: set, doc_id, text_hash, n, block, tiles (of the block), tile."""
        edges = candidate_edges(self.base.where("n > 0"), self.classes, self.t)
        members = self.classes.select("set", "doc_id", "text_hash", "n").join(components(edges, "blocks").toDF("set", "block"), "set")
        sizes = members.groupBy("block").agg(tile_count(F.count("*"), F.sum("n")).alias("tiles"))
        placed = staged(members.join(sizes, "block").withColumn("tile", F.pmod(F.xxhash64("set"), "tiles").cast("int")), "placed")
        if placed.count() <= BROADCAST_ROWS:  # texts outside all blocks are not shuffled; with more, all texts are
            self.texts = self.texts.join(F.broadcast(placed.select(F.col("text_hash").alias("_hash"))), "_hash", "left_semi")
        return placed

    def links(self, units: DataFrame, every: bool = False) -> DataFrame:
        """Verified links (a, b) of units: rows unit, set, doc_id, text_hash, side, root."""
        whole = units.join(self.texts, (F.col("text_hash") == F.col("_hash")) & F.col("doc_id").eqNullSafe(F.col("_id"))).select("unit", "set", "side", "root", "text")
        ordered = whole.repartition(self.spread, "unit").sortWithinPartitions("unit", "set", "side")
        return staged(ordered.mapInArrow(verify(self.width, self.t, every), "a long, b long"), "found")

    def roots(self) -> DataFrame:
        """(set, root) of the sets that are linked with another."""
        placed = self.placed()
        row = ["set", "doc_id", "text_hash"]
        links = self.links(placed.select(F.xxhash64("block", "tile").alias("unit"), *row, F.lit(0).alias("side"), F.col("set").alias("root")))
        large = placed.where("tiles > 1")
        if large.isEmpty():
            return components(links, "links").toDF("set", "root")

        def rooted(links: DataFrame) -> DataFrame:
            found = components(links, "links").toDF("set", "root")
            return staged(large.join(found, "set", "left").withColumn("root", F.coalesce("root", "set")), "rooted")

        # some sets of the largest component of each tile meet those of others
        own = rooted(links)
        counts = own.groupBy("block", "tile", "root").count().groupBy("block", "tile").agg(F.max_by("root", F.struct("count", "root")).alias("root"))
        number = F.row_number().over(W.partitionBy("block", "tile").orderBy("set"))
        leaders = own.join(counts, ["block", "tile", "root"]).withColumn("_number", number).where(F.col("_number") <= LEADERS)
        many = CAP // LEADERS
        meets = F.array_compact(F.array(F.xxhash64("block", F.lit(0), F.floor(F.col("tile") / many)), F.when(F.col("tile") % many == 0, F.xxhash64("block", F.lit(1)))))
        links = links.unionByName(self.links(leaders.select(F.explode(meets).alias("unit"), *row, F.lit(0).alias("side"), "root")))
        # what is outside the largest component of its block meets all tiles
        own = rooted(links)
        main = own.groupBy("block", "root").agg(F.count("*").alias("size"), F.sum("n").alias("n")).groupBy("block").agg(F.max_by("root", F.struct("size", "root")).alias("main"), F.sum("size").alias("size"), F.sum("n").alias("n"), F.max(F.struct("size", "root", "n")).alias("most"))
        parts = tile_count(F.col("size") - F.col("most.size"), F.col("n") - F.col("most.n"))
        own = own.join(main.select("block", "main", parts.alias("parts")).where("parts > 0"), "block")
        part = F.pmod(F.xxhash64("set", F.lit(1)), F.col("parts")).cast("int")
        unit = lambda part, tile, side: F.struct(F.xxhash64("block", F.lit(2), part, tile).alias("unit"), F.lit(side).alias("side"))
        asked = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: unit(k, F.col("tile"), 1))
        asking = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda k: unit(part, k, 0))
        dealt = own.select("set", "root", "n", F.explode(F.when(F.col("root") != F.col("main"), F.concat(asked, asking)).otherwise(asked)).alias("u"))
        counted = dealt.join(self.classes.select("set", "counts"), "set").select("u.unit", "set", "u.side", "root", "n", "counts").repartition(self.spread, "unit").sortWithinPartitions("unit")
        needed = counted.mapInArrow(meeting(self.t), "unit long, set long, side int, root long")  # texts are copied for these only
        links = links.unionByName(self.links(needed.join(self.classes.select(*row), "set")))
        return components(links, "links").toDF("set", "root")


def near_duplicates(docs: DataFrame, width: int = 3, similarity: Fraction = Fraction(9, 10), doc_id: str = "doc_id", text: str = "text", text_hash: str | None = None) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (the smallest doc_id reachable by links). text_hash: names a column of xxhash64(text) to add."""
    join = Join(docs, width, similarity, doc_id, text)
    rooted = join.classes.select("set", "least").join(join.roots(), "set", "left").withColumn("root", F.coalesce("root", "set"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("set", "component_id")
    more = [F.col("text_hash").alias(text_hash)] if text_hash else []
    linked = join.base.where("n > 0").select("doc_id", "text_hash", "n", "set").join(named, "set").select("doc_id", F.col("n").alias("n_shingles"), "component_id", *more)
    return linked.unionByName(join.base.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), *more))


def similar_pairs(docs: DataFrame, width: int = 3, similarity: Fraction = Fraction(9, 10), doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """All links, as pairs (a, b) of classes of equal sets, each once, and the membership of rows: doc_id, text_hash, class (null without a set)."""
    join = Join(docs, width, similarity, doc_id, text)
    placed = join.placed()
    unit = lambda k: F.struct(F.xxhash64("block", F.least("tile", k), F.greatest("tile", k)).alias("unit"), F.when(F.col("tile") > k, 1).otherwise(0).alias("side"))
    units = placed.select("set", "doc_id", "text_hash", F.explode(F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), unit)).alias("u"))
    found = join.links(units.select("u.*", "set", "doc_id", "text_hash", F.col("set").alias("root")), every=True)
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), join.base.select("doc_id", "text_hash", F.when(F.col("n") > 0, F.col("set")).alias("class"))


def op4_ngram_join(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(list_transform(range(1, greatest(len(w) - 2, 1) + 1), lambda i: array_to_string(list_slice(w, i, i + 2), ' '))) AS s FROM w WHERE len(w) > 0),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS n FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c WHERE 100 * n >= 90 * (na + nb - n)),
u AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT a AS doc_id, a AS reached FROM u UNION SELECT r.doc_id, u.b FROM r JOIN u ON r.reached = u.a)
SELECT w.doc_id, CAST(coalesce(len(s.s), 0) AS BIGINT) AS n_shingles, least(w.doc_id, coalesce(m.least, w.doc_id)) AS component_id
FROM w LEFT JOIN s USING (doc_id) LEFT JOIN (SELECT doc_id, min(reached) AS least FROM r GROUP BY doc_id) m USING (doc_id)
"""
