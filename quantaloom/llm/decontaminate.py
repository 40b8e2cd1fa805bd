"""Benchmark decontamination: CGK embedding, bit-sampling LSH, exact edit verification.

The CGK embedding (Chakraborty, Goldenberg and Koucky) walks along a string: at step t it writes the symbol it stands on
and moves on if a random bit of (t, symbol) says so. Strings at a small edit distance mostly fall back into step, so their
walks agree at most places: edits become a Hamming distance. Symbols are words here. A repetition samples some steps of the
walk; equal samples make a candidate. A walk starts from every word of a text and from every word of an item, and never leaves
the item. Its length goes with the item's: repetitions belong to classes of item lengths, and longer items have longer
walks besides the short ones. How many repetitions a class has is computed, by trying its walks on strings with as many
edits as are allowed, so that each length reaches ``RECALL``; copies without an edit always have a walk in common. Each
candidate is verified by the edit distance in words between the item and the best-fitting place of the text there.

A text's walks are given up as soon as the samples so far are no item's, so most are a step or two long.

Defined results: a null text counts as empty; an item without words matches nothing, and is reported by ``empty_items``.
Texts are read whole; rows are matched each, repeated ones alike; a null doc_id stays null, and so does a null item_id. An
empty table of either kind gives no rows. Other columns are not looked at, whatever their names. Verification holds a bounded
number of words at once, however long an item is.
"""

from __future__ import annotations

import bisect
import functools
import itertools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantaloom.llm._common import mapped, slices, table, texts_of
from quantaloom.llm._words import Words, grouped, mix, words_of

@dataclass(frozen=True)
class Class:
    """Repetitions for items of ``least`` to ``most`` words: steps of a walk, steps sampled, and how many words they must read."""

    least: int
    most: int
    steps: int
    samples: int
    words: int


#: Items of at most four words have no edits. The last classes are the longer walks, which add to those before them.
CLASSES = (Class(1, 1, 1, 1, 1), Class(2, 4, 2, 2, 1), Class(5, 9, 3, 3, 2), Class(10, 1 << 60, 6, 4, 3))
LONG = tuple(Class(2 * n, 1 << 60, 2 * n, 5, 4) for n in (8, 16, 32, 64))
#: Share of an item's words that edits may come to, and the share of items with so many edits that are to be found.
MAX_EDITS, RECALL = 0.2, 0.99
#: Items that a worker holds at once; more are searched in blocks of so many. Words that verification holds at once.
ITEMS_AT_ONCE, WORDS_AT_ONCE = 20_000, 1 << 21
_SEED = 20_240_229


@functools.lru_cache(maxsize=256)
def _walk(of: Class, repetition: int) -> tuple[np.ndarray, tuple[int, ...]]:
    """Odd multipliers of each step, whose product with a symbol gives its random bit; and the sampled steps, 0 the first."""
    g = np.random.default_rng([_SEED, of.steps, of.samples, repetition])
    odd = g.integers(0, 1 << 63, of.steps, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return odd, (0, *sorted((g.permutation(of.steps - 1)[: of.samples - 1] + 1).tolist()))


def embed(symbols: np.ndarray, starts: np.ndarray, of: Class, repetition: int) -> Iterator[tuple[np.ndarray, np.ndarray, Callable]]:
    """The walks from ``starts``, at each sampled step: the hash of the samples so far and the place of each walk. Walks that
    ``keep`` (a third value, to call with a mask) leaves out go no further. Beyond the end all is 0."""
    odd, sampled = _walk(of, repetition)
    padded = np.r_[symbols, np.zeros(of.steps + 1, np.uint64)]
    at, key = starts, np.full(len(starts), repetition, np.uint64)
    mask: list[np.ndarray] = []
    for step in range(sampled[-1] + 1):
        symbol = padded[at]
        if step in sampled:
            key = (key ^ symbol) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
            yield mix(key), at, mask.append
            if mask:
                keep = mask.pop()
                at, key, symbol = at[keep], key[keep], symbol[keep]
        at = at + ((symbol * odd[step]) >> np.uint64(63)).astype(np.int64)


@dataclass
class Walks:
    """A repetition's walks over the items: bits of the hashes after each sample, then the sorted whole keys with item and first word."""

    seen: list[np.ndarray]
    keys: np.ndarray
    items: np.ndarray
    starts: np.ndarray
    shift: int


@dataclass
class Index:
    """Items, and their walks by class and repetition."""

    ids: list
    words: list[np.ndarray]
    walks: dict[tuple[Class, int], Walks]


def _walks(items: list[np.ndarray], own: list[int], of: Class, repetition: int) -> Walks:
    """The walks from every word of ``own`` items; one that leaves its item, or reads too few words, says too little and is left out."""
    size = np.array([len(items[i]) for i in own])
    ends = np.cumsum(size)
    symbols = np.concatenate([items[i] for i in own])
    begin, end = np.repeat(ends - size, size), np.repeat(ends, size)
    starts = np.arange(len(symbols))
    hashes, read, last, before = [], np.zeros(len(starts), np.int64), starts, np.full(len(starts), -1)
    for found, at, _ in embed(symbols, starts, of, repetition):
        hashes.append(found)
        read += at != before
        before = last = at
    # A copy without edits must be found: of each item the first walk is kept, however few words it reads.
    fit = (last < end) & ((read >= of.words) | (starts == begin))
    shift = 64 - max(18, min(24, int(fit.sum()).bit_length() + 3))
    seen = []
    for found in hashes:
        bits = np.zeros(1 << (64 - shift), bool)
        bits[(found[fit] >> np.uint64(shift)).astype(np.int64)] = True
        seen.append(bits)
    order = np.argsort(hashes[-1][fit], kind="stable")
    item = np.repeat(np.array(own), size)
    return Walks(seen, hashes[-1][fit][order], item[fit][order], (starts - begin)[fit][order], shift)


@functools.lru_cache(maxsize=32)
def repetitions(of: Class, max_edits: float, recall: float = RECALL) -> int:
    """How many repetitions find items of the class that have as many edits as are allowed with ``recall``.

    Tried on items of random words, for several lengths of the class, with edits spread evenly and at random places; the
    length and kind with the least recall count.
    """
    lengths = sorted({min(of.most, of.least + n) for n in (0, 1, 2, 3, 4, 5, 6, 10, 20)})
    if not any(int(max_edits * n) for n in lengths):
        return 1
    g = np.random.default_rng(_SEED)
    items, texts, group = [], [], []
    for n in lengths:
        for i in range(200):
            item = g.integers(1, 1 << 62, n, dtype=np.uint64)
            items.append(item)
            texts.append(edited(g, item, int(max_edits * n), i % 2 == 0))
            group.append(2 * n + i % 2)
    gap = [g.integers(1, 1 << 62, 2 * of.steps, dtype=np.uint64) for _ in items]
    symbols = np.concatenate([part for pair in zip(gap, texts, strict=True) for part in pair])
    owner = np.repeat(np.arange(len(items)), [len(a) + len(b) for a, b in zip(gap, texts, strict=True)])
    met, group = np.zeros(len(items), bool), np.array(group)
    for repetition in itertools.count():
        walks = _walks(items, list(range(len(items))), of, repetition)
        anchor, row = _met(walks, symbols, of, repetition)
        same = owner[anchor] == walks.items[row]
        met[owner[anchor[same]]] = True
        if min(met[group == n].mean() for n in np.unique(group)) >= recall or repetition == 31:
            return repetition + 1


def edited(g: np.random.Generator, item: np.ndarray, edits: int, evenly: bool) -> np.ndarray:
    """The item with so many words replaced at even distances, or replaced, dropped or put in at random places."""
    out, n = item.tolist(), len(item)
    for k in range(edits):
        word = int(g.integers(1, 1 << 62))
        if evenly:
            out[(2 * k + 1) * n // (2 * edits)] = word
            continue
        at, kind = int(g.integers(len(out))), g.random()
        out[at : at + 1] = [word] if kind < 0.4 else [] if kind < 0.7 else [out[at], word]
    return np.array(out, np.uint64)


def build_index(ids: list, texts: list[str], max_edits: float = MAX_EDITS) -> Index:
    words = words_of(texts)
    items = [words.hash[a:b] for a, b in itertools.pairwise(words.bounds().tolist())]
    walks = {}
    for of in (*CLASSES, *LONG):
        own = [i for i, w in enumerate(items) if of.least <= len(w) <= of.most]
        for repetition in range((2 if of in LONG else repetitions(of, max_edits)) if own else 0):
            walks[of, repetition] = _walks(items, own, of, repetition)
    return Index(ids, items, walks)


def _met(walks: Walks, symbols: np.ndarray, of: Class, repetition: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, row of the walks): where a walk of ``symbols`` has all its samples in common with an item's."""
    starts = np.arange(len(symbols))
    found = np.empty(0, np.uint64)
    for seen, (found, _, keep) in zip(walks.seen, embed(symbols, starts, of, repetition), strict=True):
        mask = seen[(found >> np.uint64(walks.shift)).astype(np.int64)]
        keep(mask)
        starts, found = starts[mask], found[mask]
    low, high = np.searchsorted(walks.keys, found), np.searchsorted(walks.keys, found, "right")
    many = high - low
    rows = np.repeat(low, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    return np.repeat(starts, many), rows


def candidates(index: Index, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, item, place at which the item would begin), distinct, for all walks that have their samples in common with an item's."""
    out: list[np.ndarray] = [np.empty((3, 0), np.int64)]
    for (of, repetition), walks in index.walks.items():
        anchor, rows = _met(walks, words.hash, of, repetition)
        if len(rows):
            out.append(np.stack([words.doc[anchor], walks.items[rows], anchor - walks.starts[rows]]))
    doc, item, start = np.concatenate(out, 1)
    order = np.lexsort((start, item, doc))
    doc, item, start = doc[order], item[order], start[order]
    new = np.r_[True, (np.diff(doc) != 0) | (np.diff(item) != 0) | (np.diff(start) != 0)][: len(doc)]
    return doc[new], item[new], start[new]


def fit(item: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(edits, first, end) for each row of ``texts``: the least edit distance in words of ``item`` to a part of the row,
    and the first such part."""
    rows, n = texts.shape
    steps = np.arange(n + 1)
    cost, begin = np.zeros((rows, n + 1), np.int64), np.tile(steps, (rows, 1))
    for i, word in enumerate(item, 1):
        swap, drop = cost[:, :-1] + (texts != word), cost[:, 1:] + 1
        cost[:, 0], best_from = i, begin.copy()
        best_from[:, 0] = 0
        better = swap <= drop
        cost[:, 1:] = np.where(better, swap, drop)
        best_from[:, 1:] = np.where(better, begin[:, :-1], begin[:, 1:])
        # Words put into the text: the least of (cost at j) + (steps on from j), running.
        ahead = cost - steps
        rest = np.minimum.accumulate(ahead, axis=1)
        kept = np.maximum.accumulate(np.where(ahead == rest, steps, 0), axis=1)
        cost, begin = rest + steps, np.take_along_axis(best_from, kept, 1)
    end = cost.argmin(1)
    at = np.arange(rows)
    return cost[at, end], begin[at, end], end


def _equal(symbols: np.ndarray, at: np.ndarray, inside: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """At which places ``wanted`` stands word for word."""
    left = np.flatnonzero(inside)
    for k, word in enumerate(wanted):
        if not len(left):
            break
        left = left[symbols[at[left] + k] == word]
    same = np.zeros(len(at), bool)
    same[left] = True
    return same


def _run_starts(doc: np.ndarray, at: np.ndarray, spread: int) -> np.ndarray:
    """The first of each run of places of one text that lie within ``spread`` of the first; ``at`` rises within a text."""
    out, i = [], 0
    while i < len(at):
        out.append(i)
        end = int(np.searchsorted(doc, doc[i], "right"))
        i += int(np.searchsorted(at[i:end], at[i] + spread, "right"))
    return np.array(out, np.int64)


def matches(index: Index, words: Words, max_edits: float = MAX_EDITS) -> dict[int, list[tuple[int, int, int, int]]]:
    """By text: (item, edits, first word, end) of each verified place, by item, then edits, then place; overlapping ones once."""
    doc, item, start = candidates(index, words)
    bounds = words.bounds()
    found: list[tuple[int, int, int, int, int]] = []
    padded = np.r_[words.hash, np.zeros(1, np.uint64)]
    for i in np.unique(item).tolist():
        wanted = index.words[i]
        n = len(wanted)
        most = int(max_edits * n)
        own = item == i
        d, at = doc[own], start[own]
        low, high = bounds[d], bounds[d + 1]
        inside = (at >= low) & (at + n <= high)
        same = _equal(words.hash, at, inside, wanted)
        found += [(x, i, 0, y, y + n) for x, y in zip(d[same].tolist(), at[same].tolist(), strict=True)]
        if not most:
            continue
        # Places near each other are one: of the words around them the best-fitting part is taken. Those near a whole copy are it.
        near_copy = np.zeros(len(at), bool)
        if same.any():
            copies = at[same]
            after = np.searchsorted(copies, at)
            near_copy = np.minimum(np.abs(at - copies[np.maximum(after - 1, 0)]), np.abs(at - copies[np.minimum(after, len(copies) - 1)])) <= most
        d, at, low, high = (x[~near_copy] for x in (d, at, low, high))
        first = _run_starts(d, at, most)
        d, at, low, high = d[first], at[first], low[first], high[first]
        width = n + 3 * most
        for some in np.array_split(np.arange(len(d)), max(1, len(d) * width // WORDS_AT_ONCE)):
            where = at[some][:, None] + np.arange(-most, n + 2 * most)
            where = np.where((where >= low[some][:, None]) & (where < high[some][:, None]), where, len(words.hash))
            around = padded[where]
            # As many words as edits leave must be words of the item.
            likely = np.isin(around, wanted).sum(1) >= n - most
            if not likely.any():
                continue
            edits, begin, end = fit(wanted, around[likely])
            begin, end = begin + at[some][likely] - most, end + at[some][likely] - most
            good = (edits <= most) & (end > begin)
            clip = np.maximum(begin, low[some][likely]), np.minimum(end, high[some][likely])
            found += [(x, i, e, y, z) for x, e, y, z in zip(d[some][likely][good].tolist(), edits[good].tolist(), clip[0][good].tolist(), clip[1][good].tolist(), strict=True)]
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    for (d, i), group in itertools.groupby(sorted(found), key=lambda m: m[:2]):
        taken: list[tuple[int, int]] = []  # places that do not overlap, rising
        for _, _, edits, first, end in group:
            first, end = first - int(bounds[d]), end - int(bounds[d])
            at = bisect.bisect_left(taken, (end, -1))  # those before begin before this one ends
            if not at or taken[at - 1][1] <= first:
                taken.insert(at, (first, end))
                out.setdefault(d, []).append((i, edits, first, end))
    return out


def index_blocks(benchmark: DataFrame, max_edits: float = MAX_EDITS) -> Iterator[Index]:
    """Indexes of the items, block by block, so that what the driver and workers hold is bounded."""
    rows = benchmark.select("item_id", "text").toLocalIterator()
    while some := list(itertools.islice(rows, ITEMS_AT_ONCE)):
        yield build_index([r["item_id"] for r in some], [r["text"] or "" for r in some], max_edits)


def _found(index: Index, batch: pa.RecordBatch, max_edits: float) -> Iterator[tuple[int, list[tuple[int, int, int, int]]]]:
    """(row, matches) for the rows of a batch that have any."""
    for first, texts in grouped(texts_of(batch)):
        for doc, places in matches(index, words_of(texts), max_edits).items():
            yield first + doc, places


def find_leaks(docs: DataFrame, benchmark: DataFrame, max_edits: float = MAX_EDITS) -> DataFrame:
    """doc_id, item_id, edits, first_word, n_words, item_words, places: the best place of each item in each row."""
    schema = docs.select("doc_id").schema
    schema = schema.add("item_id", benchmark.schema["item_id"].dataType)
    for name in ("edits", "first_word", "n_words", "item_words", "places"):
        schema = schema.add(name, "long")
    session, out = docs.sparkSession, None
    for index in index_blocks(benchmark, max_edits):
        shared = session.sparkContext.broadcast(index)  # a block of items, not the table

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in slices(batches):
                rows: list[tuple] = []
                for row, found in _found(index, batch, max_edits):
                    for item, group in itertools.groupby(found, key=lambda m: m[0]):
                        places = list(group)
                        _, edits, first, end = places[0]
                        rows.append((row, index.ids[item], edits, first, end - first, len(index.words[item]), len(places)))
                columns = list(zip(*rows, strict=True)) or [[]] * 7
                ids = batch.column("doc_id").take(pa.array(columns[0], pa.int64()))
                yield pa.record_batch([ids, *(pa.array(c, pa.int64()) for c in columns[1:])], names=schema.names)

        part = mapped(docs.select("doc_id", "text"), run, schema)
        out = part if out is None else out.unionByName(part)
    return session.createDataFrame([], schema) if out is None else out


def keep_clean(docs: DataFrame, benchmark: DataFrame, max_edits: float = MAX_EDITS) -> DataFrame:
    """The rows of ``docs``, all columns, in which no item of the benchmark is found."""
    for index in index_blocks(benchmark, max_edits):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                clean = np.ones(batch.num_rows, bool)
                for row, _ in _found(shared.value, batch, max_edits):
                    clean[row] = False
                yield batch.filter(pa.array(clean))

        docs = mapped(docs, run, docs.schema)
    return docs


def empty_items(benchmark: DataFrame) -> DataFrame:
    """item_id of the items that have no words and so can't be searched for."""
    text = F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return benchmark.where(~text.rlike(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]")).select("item_id")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op5_decontaminate": op5_decontaminate}
ORACLE: dict[str, str] = {}
