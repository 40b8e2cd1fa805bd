"""SimHash near-dedup: fingerprints, blocks that close pairs share, Hamming verification, components.

A text's word shingles vote on each bit of its fingerprint. Equal fingerprints are one node. Close nodes meet in blocks:

* ``pigeonhole``: the bits are split into more blocks than may differ, so a pair within the distance shares at least
  the blocks that no difference falls into, and joins on them. No pair is missed.
* ``sampled``: for a similarity (a share of bits that differ far above a few bits) no pigeonhole is selective. A wider
  fingerprint is split into small blocks, and each key is a choice of them: as many keys as make a pair at exactly the similarity
  share one with the asked-for recall; more similar pairs share one more surely. Keys, blocks and distances depend on the
  similarity and the recall alone, never on how many rows there are.

The nodes that share a key are compared in cells of bounded size: nodes of a crowded key are dealt into chunks, and each
pair of chunks is a cell. A cell emits a spanning forest of its links, not all its pairs, so no link between classes is lost
while output stays in proportion to nodes.

Defined results: a null text counts as empty; texts without words have fingerprint zero and link like any other. Texts
are taken whole. Null doc_ids are left out of a component's smallest doc_id; a component of such rows alone has a null
one. Repeated rows share all results. An empty table gives no rows. Columns besides doc_id and text aren't looked at.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantaloom.llm._common import cut, mapped, slices, table, texts_of
from quantaloom.llm.components import components

#: Nodes of a key that one cell takes; two chunks of about this size meet in a cell. Crowded keys are found on a share of the
#: nodes, one in ``SAMPLE``: a key that is missed there takes one cell, with the same result.
CHUNK, SAMPLE = 2048, 8
#: Cells up to this size are compared at once, many to a step; of larger ones so many pairs.
SMALL, PAIRS_AT_ONCE = 32, 1 << 18
#: Bits of a key, of the fingerprint it is taken from, and of a block.
KEY_BITS, WIDE_BITS, BLOCK_BITS, SEED = 18, 256, 2, 11
#: The bits of a key in the order of its value, counted from the fingerprint's front.
Key = list[int]


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of ``words`` words, repeats included; of all words if fewer; empty without words."""
    split = text.encode().lower().split()  # bytes: only A-Z change, and only ASCII white space separates
    if not split:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    line = b" ".join(split)
    if len(split) <= words:
        return np.array([digest(line, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, split), np.int64, len(split)) + 1) - 1
    starts = [0, *(ends[:-words] + 1).tolist()]
    return np.array([digest(line[s:e], 42) for s, e in zip(starts, ends[words - 1 :].tolist(), strict=True)], np.uint64)


def fingerprint(hashes: np.ndarray, lanes: int = 1) -> np.ndarray:
    """``lanes`` 64-bit words; a bit is 1 if set in over half of the hashes. Further lanes remix each hash."""
    out = np.zeros(lanes, np.uint64)
    if not len(hashes):
        return out
    for lane in range(lanes):
        votes = np.zeros(64, np.int64)
        for at in range(0, len(hashes), 1 << 16):
            h = _remix(hashes[at : at + (1 << 16)], lane)
            votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, np.int32)
        out[lane] = np.packbits(votes * 2 > len(hashes), bitorder="little").view(np.uint64)[0]
    return out


def _remix(h: np.ndarray, lane: int) -> np.ndarray:
    """Lane 0 is the hash itself; others a 64-bit mix of it with an odd step, independent for practical purposes."""
    if lane == 0:
        return np.ascontiguousarray(h)
    x = h + np.uint64((0x9E3779B97F4A7C15 * lane) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprints(docs: DataFrame, words: int, lanes: int = 1, distinct: bool = False) -> DataFrame:
    """(doc_id, fp): the fingerprint as big-endian bytes, 8 a lane. ``distinct``: each shingle votes once."""
    schema = docs.select("doc_id").schema.add("fp", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = []
            for text in texts_of(batch):
                hashes = shingle_hashes(text, words)
                found.append(fingerprint(np.unique(hashes) if distinct else hashes, lanes).astype(">u8").tobytes())
            yield pa.record_batch([batch.column("doc_id"), pa.array(found, pa.binary())], names=schema.names)

    return mapped(docs.select("doc_id", "text"), run, schema)


def pigeonhole_keys(distance: int, nodes: int) -> list[Key]:
    """The keys over 64 bits: all choices of intact blocks.

    The number of blocks is the least that leaves 16 nodes or fewer to a key in the mean: with b blocks at least
    b - distance are intact in a close pair, whatever b, so the links are the same.
    """
    for blocks in range(distance + 2, 65):
        sizes = [64 // blocks + (i < 64 % blocks) for i in range(blocks)]
        if nodes <= 16 * 2 ** sum(sorted(sizes)[: blocks - distance]) or blocks == distance + 6:
            break
    starts = [0, *itertools.accumulate(sizes)]
    return [[bit for i in chosen for bit in range(starts[i], starts[i] + sizes[i])] for chosen in itertools.combinations(range(blocks), blocks - distance)]


def sampled_keys(differ: float, recall: float) -> list[Key]:
    """Choices of blocks, as many as make a pair with a ``differ`` share of unequal bits share one with ``recall``."""
    blocks, chosen = WIDE_BITS // BLOCK_BITS, KEY_BITS // BLOCK_BITS
    intact = (1 - differ) ** BLOCK_BITS
    share = [(math.comb(blocks, m) * intact**m * (1 - intact) ** (blocks - m), math.comb(m, chosen) / math.comb(blocks, chosen)) for m in range(blocks + 1)]
    keys = next(n for n in itertools.count(1) if sum(p * (1 - (1 - hit) ** n) for p, hit in share) >= recall)
    g = np.random.default_rng(SEED)
    return [[BLOCK_BITS * int(i) + k for i in np.sort(g.permutation(blocks)[:chosen]) for k in range(BLOCK_BITS)] for _ in range(keys)]


def differing_share(similarity: float) -> float:
    """The expected share of unequal bits of two sets with a Jaccard ``similarity``: the angle between them over pi."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def key_values(prints: np.ndarray, keys: list[Key], first: int = 0) -> np.ndarray:
    """The value of each key, with its number (from ``first``) above it, of each row of fingerprints."""
    bits = np.unpackbits(np.ascontiguousarray(prints.astype(">u8")).view(np.uint8).reshape(len(prints), -1), axis=1)
    out = np.zeros((len(prints), len(keys)), np.int64)
    for n, key in enumerate(keys):
        value = np.full(len(prints), first + n, np.int64)
        for bit in key:
            value = value << 1 | bits[:, bit]
        out[:, n] = value
    return out


def _keyed(nodes: DataFrame, keys: list[Key], first: int = 0) -> DataFrame:
    """(fp, label, k): a row for each key of each node (fp, label)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4096):
            if batch.num_rows:
                values = key_values(_numbers(batch.column("fp")), keys, first)
                ends = pa.array(np.arange(len(values) + 1, dtype=np.int32) * len(keys))
                yield pa.record_batch([batch.column("fp"), batch.column("label"), pa.ListArray.from_arrays(ends, pa.array(values.ravel()))], names=["fp", "label", "k"])

    return mapped(nodes.select("fp", "label"), run, "fp binary, label bigint, k array<bigint>").select("fp", "label", F.explode("k").alias("k"))


def links(nodes: DataFrame, keys: list[Key], distance: int) -> DataFrame:
    """(a, b): links between fingerprints of ``nodes`` (distinct ``fp``, a written table) at ``distance`` bits or fewer that
    share a key; of each cell a spanning forest."""
    return _in_cells(nodes.withColumn("label", F.lit(0).cast("long")), keys, _compare(distance), "a binary, b binary")


#: A cell within a key: the two chunks that meet, and a last bit: whether the row is of the second.
_CHUNK_BITS = 21


def _in_cells(nodes: DataFrame, keys: list[Key], run: Callable, schema: str, first: int = 0) -> DataFrame:
    """``run`` over the cells of ``nodes`` (fp, label), rows (k, c, fp, label) sorted by k and c. Each row is shuffled once, to its key's cell or,
    from a crowded key, to the cells of its chunk."""
    some = nodes.where(F.pmod(F.xxhash64("fp"), F.lit(SAMPLE)) == 0)
    size = F.count(F.lit(1)) * SAMPLE
    crowded = cut(_keyed(some, keys, first).groupBy("k").agg(F.ceil(size / CHUNK).cast("int").alias("chunks")).where("chunks > 1"))
    rows = _keyed(nodes, keys, first)
    if crowded.isEmpty():
        rows = rows.repartition("k").sortWithinPartitions("k").select("k", F.lit(0).cast("long").alias("c"), "fp", "label")
        return mapped(rows, run, schema)
    rows = rows.join(crowded, "k", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("fp", "k"), F.col("chunks"))).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    cell = F.shiftleft(F.least("own", "other").cast("long"), _CHUNK_BITS).bitwiseOR(F.greatest("own", "other").cast("long"))
    second = F.when(F.col("own") > F.col("other"), F.lit(1)).otherwise(F.lit(0)).cast("long")
    rows = rows.select("k", cell.alias("_cell"), second.alias("_second"), "fp", "label").repartition("k", "_cell")
    rows = rows.select("k", F.shiftleft("_cell", 1).bitwiseOR(F.col("_second")).alias("c"), "fp", "label").sortWithinPartitions("k", "c")
    return mapped(rows, run, schema)


class _Cells:
    """Rows sorted by cell: where each cell starts, its key's number, whether two chunks meet in it, whose second each row is of.

    ``label``: rows of an equal one are known to belong together; 0 stands for none."""

    def __init__(self, k: np.ndarray, c: np.ndarray, prints: np.ndarray, key_bits: int = 0, label: np.ndarray | None = None) -> None:
        self.label = label
        cell = c >> 1
        self.starts = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]) | (cell[1:] != cell[:-1])]) if len(k) else np.empty(0, np.int64)
        self.sizes = np.diff(np.r_[self.starts, len(k)])
        self.cell = np.repeat(np.arange(len(self.starts)), self.sizes)
        self.mixed = (cell >> _CHUNK_BITS != cell & ((1 << _CHUNK_BITS) - 1))[self.starts]
        self.second, self.key, self.prints = (c & 1).astype(bool), k >> key_bits, prints


def _whole_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows in batches with no cell in two; ``batches`` are sorted by cell."""
    rest: pa.RecordBatch | None = None
    for batch in itertools.chain(batches, [None]):
        if batch is not None and not batch.num_rows:
            continue
        last = batch is None
        if rest is not None:
            batch = rest if last else pa.concat_batches([rest, batch])
        if batch is None:
            return
        end = batch.num_rows
        if not last:
            k, cell = batch.column("k").to_numpy(), batch.column("c").to_numpy() >> 1
            end = int(np.flatnonzero((k != k[-1]) | (cell != cell[-1])).max(initial=-1)) + 1
            rest = batch.slice(end)
        if end:
            yield batch.slice(0, end)


def _compare(distance: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _whole_cells(batches):
            cells = _Cells(batch.column("k").to_numpy(), batch.column("c").to_numpy(), _numbers(batch.column("fp")))
            a, b = close_in_cells(cells, distance)
            if len(a):
                yield pa.record_batch([_binary(cells.prints[a]), _binary(cells.prints[b])], names=["a", "b"])

    return run


def _masks(keys: list[Key], lanes: int) -> np.ndarray:
    """The bits of each key as a mask over the fingerprint's numbers."""
    bits = np.zeros((len(keys), lanes * 64), np.uint8)
    for n, key in enumerate(keys):
        bits[n, key] = 1
    return np.packbits(bits, axis=1).view(">u8").astype(np.uint64)


def first_shared(differ: np.ndarray, key: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """Which pairs, given as their unequal bits, share no key before ``key``."""
    out, left = np.zeros(len(differ), bool), np.arange(len(differ))
    for n in range(int(key.max(initial=-1)) + 1):
        here = key[left] == n
        out[left[here]] = True
        left = left[~here]
        left = left[((differ[left] & masks[n]) != 0).any(1)]
        if not len(left):
            break
    return out


def _candidates(cells: _Cells, distance: int, masks: np.ndarray, apart: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of the pairs in a cell at ``distance`` bits or fewer, each pair only under the first key that it shares.

    ``apart`` says which pairs are still to be looked at; it is asked again for every block of pairs of a large cell."""
    prints = cells.prints

    def own(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if cells.label is not None:
            open_ = (cells.label[a] != cells.label[b]) | (cells.label[a] == 0)
            a, b = a[open_], b[open_]
        first = first_shared(prints[a] ^ prints[b], cells.key[a], masks)
        return a[first], b[first]

    calm = (cells.sizes <= SMALL) & ~cells.mixed
    for shift in range(1, min(SMALL, int(cells.sizes[calm].max(initial=1)))):
        i = np.flatnonzero((cells.cell[shift:] == cells.cell[:-shift]) & calm[cells.cell[shift:]])
        near = i[_near(prints[i], prints[i + shift], distance)] if len(i) else i
        if len(near):
            yield own(near, near + shift)
    for at in np.flatnonzero(~calm):
        rows = np.arange(cells.starts[at], cells.starts[at] + cells.sizes[at])
        ours, theirs = (rows[~cells.second[rows]], rows[cells.second[rows]]) if cells.mixed[at] else (rows, rows)
        step = max(1, PAIRS_AT_ONCE // max(1, len(theirs)))
        for some in (ours[i : i + step] for i in range(0, len(ours), step)):
            a, b = np.repeat(some, len(theirs)), np.tile(theirs, len(some))
            if not cells.mixed[at]:
                a, b = a[a < b], b[a < b]
            if apart is not None:
                keep = apart(a, b)
                a, b = a[keep], b[keep]
            near = _near(prints[a], prints[b], distance)
            if len(near):
                yield own(a[near], b[near])


def _promising(keys: list[Key], distance: int, lanes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The rows that have a candidate in their cell."""
    masks, key_bits = _masks(keys, lanes), len(keys[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _whole_cells(batches):
            marked = np.zeros(batch.num_rows, bool)
            label = batch.column("label").to_numpy()
            cells = _Cells(batch.column("k").to_numpy(), batch.column("c").to_numpy(), _numbers(batch.column("fp")), key_bits, label)
            for a, b in _candidates(cells, distance, masks, lambda a, b: ~(marked[a] & marked[b]) & ((label[a] != label[b]) | (label[a] == 0))):  # noqa: B023
                marked[a] = marked[b] = True
            if marked.any():
                yield batch.filter(pa.array(marked))

    return run


def _exact(keys: list[Key], distance: int, lanes: int, similarity: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of each cell a spanning forest of the candidates whose shingle sets have a Jaccard ``similarity`` or more."""
    masks, key_bits = _masks(keys, lanes), len(keys[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _whole_cells(batches):
            label = batch.column("label").to_numpy()
            cells = _Cells(batch.column("k").to_numpy(), batch.column("c").to_numpy(), _numbers(batch.column("fp")), key_bits, label)
            sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column("shingles")]
            size = np.array([len(x) for x in sets])
            # Labels of this cell's classes; a row without one is a class of its own.
            label = np.unique(np.where(label == 0, -1 - np.arange(len(label)), np.abs(label)), return_inverse=True)[1]
            out = []

            def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
                low, high = np.minimum(size[a], size[b]), np.maximum(size[a], size[b])  # noqa: B023
                return (label[a] != label[b]) & (low + 1e-9 >= similarity * high)  # noqa: B023

            for a, b in _candidates(cells, distance, masks, apart):
                for i, j in zip(a.tolist(), b.tolist(), strict=True):
                    if label[i] != label[j] and alike(sets[i], sets[j], similarity):
                        cell = slice(cells.starts[cells.cell[i]], cells.starts[cells.cell[i]] + cells.sizes[cells.cell[i]])
                        label[cell][label[cell] == label[j]] = label[i]
                        out.append((i, j))
            if out:
                a, b = zip(*out, strict=True)
                yield pa.record_batch([batch.column("fp").take(pa.array(a)), batch.column("fp").take(pa.array(b))], names=["a", "b"])

    return run


def alike(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether two sorted sets have a Jaccard ``similarity`` or more."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if len(small) + 1e-9 < similarity * len(large):
        return False
    if not len(large):
        return True
    common = int((large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small).sum())
    return common + 1e-9 >= similarity * (len(a) + len(b) - common)


def _numbers(column: pa.Array) -> np.ndarray:
    """Equally long binary values as rows of 64-bit numbers."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(">u8").astype(np.uint64).reshape(len(column), -1)


def _binary(prints: np.ndarray) -> pa.Array:
    raw, size = prints.astype(">u8").tobytes(), prints.shape[1] * 8
    return pa.array([raw[i : i + size] for i in range(0, len(raw), size)], pa.binary())


def _near(left: np.ndarray, right: np.ndarray, distance: int) -> np.ndarray:
    """Which rows of two equally long blocks of fingerprints differ in ``distance`` bits or fewer."""
    apart = np.bitwise_count(left[:, 0] ^ right[:, 0]).astype(np.int32)
    keep = np.flatnonzero(apart <= distance)
    for lane in range(1, left.shape[1]):
        apart = apart[keep] if lane == 1 else apart
        apart = apart + np.bitwise_count(left[keep, lane] ^ right[keep, lane])
        still = apart <= distance
        keep, apart = keep[still], apart[still]
    return keep


def close_in_cells(cells: _Cells, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of links: all in small cells, a spanning forest in others."""
    prints, small = cells.prints, (cells.sizes <= SMALL) & ~cells.mixed
    out_a, out_b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for shift in range(1, min(SMALL, int(cells.sizes[small].max(initial=1)))):
        i = np.flatnonzero((cells.cell[shift:] == cells.cell[:-shift]) & small[cells.cell[shift:]])
        if len(i):
            near = i[_near(prints[i], prints[i + shift], distance)]
            out_a.append(near)
            out_b.append(near + shift)
    for at in np.flatnonzero(~small):
        rows = np.arange(cells.starts[at], cells.starts[at] + cells.sizes[at])
        a, b = _forest(prints[rows], ~cells.second[rows] if cells.mixed[at] else None, distance)
        out_a.append(rows[a])
        out_b.append(rows[b])
    return np.concatenate(out_a), np.concatenate(out_b)


def _forest(prints: np.ndarray, first: np.ndarray | None, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between rows that are ``first`` and those that aren't; between all if None.

    Rows known to belong together are not compared again, so a cell of close copies takes linear time.
    """
    label, a, b = np.arange(len(prints)), [], []
    for i in range(len(prints)) if first is None else np.flatnonzero(first).tolist():
        apart = label != label[i]
        if first is None:
            apart[:i] = False
        else:
            apart &= ~first
        others = np.flatnonzero(apart)
        if not len(others):
            continue
        near = others[_near(np.broadcast_to(prints[i], (len(others), prints.shape[1])), prints[others], distance)]
        if len(near):
            joined, at = np.unique(label[near], return_index=True)
            label[np.isin(label, joined)] = label[i]
            a += [i] * len(joined)
            b += near[at].tolist()
    return np.array(a, np.int64), np.array(b, np.int64)


def classes(prints: DataFrame, link: Callable[[DataFrame, int], DataFrame]) -> DataFrame:
    """(doc_id, fp, component_id) for each row of ``prints`` (doc_id, fp; a written table). ``link`` gives links of nodes."""
    nodes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    rooted = components(link(nodes, nodes.count()))
    rooted = nodes.join(rooted.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = cut(rooted)
    named = cut(rooted.groupBy("root").agg(F.min("least").alias("component_id")))
    named = cut(rooted.join(named, "root").select("fp", "component_id"))
    return prints.join(named, "fp")


def near_classes(docs: DataFrame, words: int = 4, distance: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id) with 64-bit fingerprints linked at ``distance`` differing bits or fewer."""
    prints = cut(fingerprints(docs, words))
    found = classes(prints, lambda nodes, n: links(nodes, pigeonhole_keys(distance, n), distance))
    return found.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


#: The probability that a pair at exactly the similarity shares a key, and how many standard deviations beyond the expected
#: number of unequal bits a candidate may have.
RECALL, SLACK = 0.96, 3.0
#: Keys under which groups of copies are joined first, so that their sets are not dealt to all keys.
FIRST_KEYS = 12
#: Texts are found by up to so many 64-bit digests in a broadcast, by more in a shuffle of all texts.
OWNERS = 1 << 20


def similar_classes(docs: DataFrame, words: int = 5, similarity: float = 0.8, recall: float = RECALL, slack: float = SLACK) -> DataFrame:
    """(doc_id, component_id): classes of texts, each by its smallest doc_id, as of ``_row_classes``."""
    found = _row_classes(docs, words, similarity, recall, slack)
    return found.select("doc_id.doc_id", F.col("component_id.doc_id").alias("component_id"))


def _row_classes(docs: DataFrame, words: int = 5, similarity: float = 0.8, recall: float = RECALL, slack: float = SLACK) -> DataFrame:
    """(doc_id, component_id), structs of doc_id and the text's digest tid: classes of texts whose sets of word shingles have a Jaccard ``similarity`` or more.

    Wide fingerprints propose pairs: those with unequal bits no more than expected at ``similarity`` plus ``slack``
    standard deviations. The sets themselves decide; only texts that have a candidate are read again for theirs.
    """
    differ, lanes = differing_share(similarity), WIDE_BITS // 64
    keys = sampled_keys(differ, recall)
    distance = math.floor(WIDE_BITS * differ + slack * math.sqrt(WIDE_BITS * differ * (1 - differ)))
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.xxhash64("text").alias("tid"))  # of equal ones the texts are equal
    prints = cut(fingerprints(docs.select(key.alias("doc_id"), "text"), words, lanes, distinct=True))

    def verified(nodes: DataFrame, first: int, last: int) -> DataFrame:
        """The links under the keys from ``first`` to ``last`` between nodes (fp, least, label) that no label joins."""
        promising = cut(_in_cells(nodes, keys[first:last], _promising(keys, distance, lanes), "k long, c long, fp binary, label long", first))
        owners = cut(nodes.join(promising.select("fp").distinct(), "fp").select("least.tid").distinct())
        owners = F.broadcast(owners) if owners.count() <= OWNERS else owners.hint("merge")
        texts = docs.join(owners, F.xxhash64(docs["text"]) == owners["tid"], "left_semi")
        sets = cut(mapped(texts.select("text"), _sets(words, lanes), "fp binary, shingles binary").dropDuplicates(["fp"]))
        met = promising.join(sets, "fp").withColumn("cell", F.shiftright("c", 1)).repartition("k", "cell").sortWithinPartitions("k", "c").drop("cell")
        return mapped(met, _exact(keys, distance, lanes, similarity), "a binary, b binary")

    def link(nodes: DataFrame, _: int) -> DataFrame:
        # The first keys join most of each group of copies; under the others its members are not compared again.
        begun = components(verified(nodes.withColumn("label", F.lit(0).cast("long")), 0, FIRST_KEYS))
        label = F.when(F.col("root").isNotNull(), F.abs(F.xxhash64("root"))).otherwise(F.lit(0).cast("long"))
        labelled = cut(nodes.join(begun.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", label.alias("label")))
        return begun.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(verified(labelled, FIRST_KEYS, len(keys)))

    return classes(prints, link).select("doc_id", "component_id")


def _sets(words: int, lanes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [np.unique(shingle_hashes(text, words)) for text in texts_of(batch)]
            prints = [fingerprint(x, lanes).astype(">u8").tobytes() for x in sets]
            yield pa.record_batch([pa.array(prints, pa.binary()), pa.array([x.tobytes() for x in sets], pa.binary())], names=["fp", "shingles"])

    return run


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs``, all columns, less the near copies: of each class the row with the smallest doc_id stays, of
    different texts under that doc_id one.

    Rows with a null doc_id stay, as do rows equal in doc_id and text to one that stays: nothing tells them apart.
    """
    found = _row_classes(docs.where("doc_id IS NOT NULL"), **how).where("doc_id <> component_id")
    found = cut(found.select(F.col("doc_id.doc_id").alias("_gone"), F.col("doc_id.tid").alias("_tid")).distinct())
    return docs.join(found, (docs["doc_id"] == found["_gone"]) & (F.xxhash64(docs["text"]) == found["_tid"]), "left_anti")


def op1_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(table(spark, sf_dir, "documents"), words=4, distance=4)


QUERIES = {"op1_simhash_dedup": op1_simhash_dedup}
ORACLE: dict[str, str] = {}
