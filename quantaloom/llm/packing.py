"""Best-fit packing with Martello-Toth dominance reduction.

Documents become token pieces; pieces become sequences. Which pieces share a sequence depends on their lengths
alone, and lengths are bounded, so the plan is made on the histogram of lengths (at most ``capacity`` rows, whatever the
corpus): reduction first fixes sets that provably dominate all alternatives (a piece with no partner, a pair that fills
the sequence, a pair when nothing else can be a better or a third part), then best-fit decreasing places the rest. A row
of the plan covers a whole run of equal sequences. Pieces are numbered within their length over many tasks and
look their place up in the plan.

Defined results: a null or empty text is the end token alone, a piece of length 1. Repeated rows are packed each.
Texts are taken whole, however long. An empty table gives no rows. Columns other than doc_id and text are not looked at.
"""

from __future__ import annotations

import functools
import itertools
import json
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantaloom.llm._common import cut, mapped, numbered, slices, table, texts_of

#: Characters of texts that are split and looked up here: Latin-1 without the end mark, and dashes and quotes. None of them
#: is changed by composition, and their case depends on no neighbour. Other texts are left to the library.
_OTHER = re.compile("[^\x01-\xff\u2010-\u2027]").search
_LETTER, _DIGIT, _SPACE = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
#: The form of vocabulary that is taken apart here; and its pattern of words, in these characters, lower-cased.
_FORM = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "split": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+",
    "model": {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": "</w>", "fuse_unk": False, "byte_fallback": False},
}
_WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_DIGIT}]|[^{_SPACE}{_LETTER}{_DIGIT}]+").findall
_BETWEEN_SPACES = re.compile("[^ \t\n\r]+").findall
#: Stands after a word's last byte.
_END = "\0"


def _end_marked(file: str):
    """The vocabulary as byte pairs in which a word's end is a byte of its own; None if the file is of another form.

    A last byte with its mark is one symbol in the file; here the two are a pair of a rank before all other merges.
    """
    import tiktoken

    with open(file, encoding="utf-8") as f:
        form = json.load(f)
    model, split = form["model"], (form["pre_tokenizer"] or {}).get("pretokenizers", [{}])
    same = form["normalizer"] == _FORM["normalizer"] and all(model.get(k) == v for k, v in _FORM["model"].items()) and form["post_processor"] is None
    same = same and [x.get("type") for x in split] == ["Split", "ByteLevel"] and split[0]["pattern"] == {"Regex": _FORM["split"]} and split[0]["invert"] and split[1]["add_prefix_space"] is False
    if not same:
        return None
    # The file writes a byte as a printable character: itself if it is one, else the next from 256 on.
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in printable} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in printable)}
    vocabulary = {k: v for k, v in model["vocab"].items() if k not in {x["content"] for x in form["added_tokens"]}}
    merged = [vocabulary["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    if sorted(set(merged)) != merged or len(merged) + 512 != len(vocabulary):
        return None  # ids are not in the order of merges
    ranks = {bytes(byte[c] for c in k.removesuffix("</w>")) + (_END.encode() if k.endswith("</w>") else b""): v for k, v in vocabulary.items()}
    return tiktoken.Encoding(file, pat_str=f"[^{_END}]+{_END}", mergeable_ranks=ranks, special_tokens={})


class WordEncoder:
    """Ids of whole texts, as the tokenizers library gives them.

    Words are split and marked here and merged by a byte-pair coder, several times as fast as the library; words with
    characters that ``_OTHER`` finds, and texts with what may be a special token, go to the library itself.
    """

    def __init__(self, file: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.merger = _end_marked(file)

    def ids(self, text: str) -> np.ndarray:
        """The ids of a text as little-endian unsigned 32-bit numbers."""
        if self.merger is None or "<|" in text:
            return self._from_library(text)
        if not _OTHER(text):
            return self._merged(text)
        # Nothing is joined over white space: only the runs of words with other characters are the library's.
        runs = itertools.groupby(_BETWEEN_SPACES(text), key=lambda word: bool(_OTHER(word)))
        return np.concatenate([np.empty(0, "<u4"), *((self._from_library if other else self._merged)(" ".join(run)) for other, run in runs)])

    def _from_library(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def _merged(self, text: str) -> np.ndarray:
        marked = _END.join([*_WORDS(text.lower()), ""])
        return self.merger.encode_to_numpy(marked, disallowed_special=()).astype("<u4", copy=False)


@functools.lru_cache(maxsize=2)
def encoder(file: str) -> WordEncoder:
    return WordEncoder(file)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pieces_of(docs: DataFrame, capacity: int, vocabulary: str | None = None, end_id: int = 1) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each text's ids and the end token, cut only where longer than ``capacity``."""
    schema = docs.select("doc_id").schema.add("piece", "integer").add("start", "long").add("length", "long").add("ids_crc32", "long")
    end, step = np.array([end_id], "<u4").tobytes(), 4 * capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(vocabulary or default_vocabulary())
        for batch in slices(batches):
            rows, columns = [], [[], [], [], []]
            for row, text in enumerate(texts_of(batch)):
                ids = words.ids(text).tobytes() + end
                for piece, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    rows.append(row)
                    for column, value in zip(columns, (piece, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        column.append(value)
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.record_batch([batch.column("doc_id").take(pa.array(rows, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=schema.names)

    return mapped(docs.select("doc_id", "text"), run, schema)


class Plan:
    """Runs of equal sequences: for each length, from which rank on pieces go to which sequences and offset."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.sequences, self.fixed = capacity, 0, 0
        self.used: dict[int, int] = {}
        #: length -> ranks where a run begins, and what holds in it: the first sequence and the offset.
        self.starts: dict[int, list[int]] = {}
        self.runs: dict[int, list[tuple[int, int]]] = {}

    def place(self, length: int, count: int, sequence: int, offset: int) -> None:
        """The next ``count`` pieces of ``length`` go to sequences from ``sequence`` on, one in each, at ``offset``."""
        rank = self.used.get(length, 0)
        self.starts.setdefault(length, []).append(rank)
        self.runs.setdefault(length, []).append((sequence, offset))
        self.used[length] = rank + count

    def close(self, lengths: tuple[int, ...], count: int) -> None:
        """``count`` sequences that hold just ``lengths``."""
        at = 0
        for length in lengths:
            self.place(length, count, self.sequences, at)
            at += length
        self.sequences += count
        self.fixed += count


def _largest(lengths: list[int], left: dict[int, int], most: int) -> int | None:
    """The largest length up to ``most`` of which pieces are left."""
    for i in range(bisect_right(lengths, most) - 1, -1, -1):
        if left[lengths[i]]:
            return lengths[i]
    return None


def _smallest(lengths: list[int], left: dict[int, int], besides: int, n: int) -> list[int]:
    """The ``n`` smallest single pieces left, one of ``besides`` not counted."""
    found: list[int] = []
    for length in lengths:
        found += [length] * min(n, left[length] - (length == besides))
        if len(found) >= n:
            return found[:n]
    return found


def reduce(plan: Plan, left: dict[int, int]) -> None:
    """Fixes dominating sets for as many pieces at once as have them; ``left`` keeps the pieces that no rule decides.

    Let j be the largest undecided length and r the room beside it. {j} is fixed if nothing fits; {j, k} if k fills r, or
    if k is the largest that fits and no two pieces fit beside j, or at most two do and k is no less than any such two.
    In each case another choice of partners could be exchanged for this one without a sequence more.
    """
    lengths = sorted(left)
    for j in sorted(left, reverse=True):
        while left[j]:
            room = plan.capacity - j
            left[j] -= 1
            k = _largest(lengths, left, room)
            left[j] += 1
            if k is None:
                n, alone = left[j], True
            else:
                small = _smallest(lengths, left, j, 3)
                two = len(small) > 1 and small[0] + small[1] <= room
                three = len(small) > 2 and sum(small) <= room
                if not (k == room or not two or (not three and k >= _best_two(lengths, left, j, room))):
                    break
                # Pieces that go only take alternatives away, so the rule holds for all that are left.
                n, alone = (left[j] // 2 if j == k else min(left[j], left[k])), False
            left[j] -= n
            if alone:
                plan.close((j,), n)
            else:
                left[k] -= n
                plan.close((j, k), n)


def _best_two(lengths: list[int], left: dict[int, int], j: int, room: int) -> int:
    """The most that two pieces beside j fill of ``room``."""
    best = 0
    have = [x for x in lengths if left[x] - (x == j) > 0 and x <= room]
    low, high = 0, len(have) - 1
    while low <= high:
        total = have[low] + have[high]
        if total > room:
            high -= 1
            continue
        if low < high or left[have[low]] - (have[low] == j) > 1:
            best = max(best, total)
        low += 1
    return best


def best_fit(plan: Plan, left: dict[int, int]) -> None:
    """Best-fit decreasing on what is left: each length, largest first, goes to the fullest open sequences it fits."""
    rooms: list[int] = []  # sorted
    open_: dict[int, list[tuple[int, int]]] = {}  # room -> (first sequence, count)
    for length in sorted((x for x in left if left[x]), reverse=True):
        n = left[length]
        while n:
            i = bisect_right(rooms, length - 1)
            if i < len(rooms):
                room = rooms[i]
                first, have = open_[room].pop()
                if not open_[room]:
                    del open_[room]
                    rooms.pop(i)
                took = min(n, have)
                if have > took:
                    _open(rooms, open_, room, first + took, have - took)
            else:
                # New sequences take as many of this length as fit.
                each = max(1, min(plan.capacity // length, n))
                room, took, first = plan.capacity - (each - 1) * length, max(1, n // each), plan.sequences
                plan.sequences += took
                for slot in range(each - 1):
                    plan.place(length, took, first, slot * length)
                n -= took * (each - 1)
            plan.place(length, took, first, plan.capacity - room)
            n -= took
            if room > length:
                _open(rooms, open_, room - length, first, took)
        left[length] = 0


def _open(rooms: list[int], open_: dict[int, list[tuple[int, int]]], room: int, first: int, count: int) -> None:
    if room not in open_:
        rooms.insert(bisect_right(rooms, room), room)
        open_[room] = []
    open_[room].append((first, count))


def make_plan(histogram: dict[int, int], capacity: int) -> Plan:
    plan, left = Plan(capacity), dict(histogram)
    reduce(plan, left)
    best_fit(plan, left)
    return plan


def pack(docs: DataFrame, capacity: int = 4096, vocabulary: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for each piece."""
    pieces = cut(pieces_of(docs, capacity, vocabulary))
    return place(pieces, capacity)


def place(pieces: DataFrame, capacity: int) -> DataFrame:
    """Adds sequence_id and offset to a written table of pieces with a ``length`` of 1 to ``capacity``."""
    plan = make_plan({r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}, capacity)
    ranked = numbered(pieces, ["length"], [F.col("doc_id"), F.col("start"), F.col("ids_crc32")], F.struct("doc_id", "start"), "_nth")
    looked_up = {length: (np.array(plan.starts[length]), np.array(plan.runs[length], np.int64)) for length in plan.starts}
    shared = pieces.sparkSession.sparkContext.broadcast(looked_up)  # grows with the number of lengths, not with the pieces
    schema = pieces.select("*").schema.add("sequence_id", "long").add("offset", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("_nth").to_numpy()
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            ends = np.flatnonzero(np.diff(length[order])) + 1
            for own in np.split(order, ends) if len(order) else []:
                starts, runs = shared.value[int(length[own[0]])]
                at = np.searchsorted(starts, rank[own], "right") - 1
                sequence[own], offset[own] = runs[at, 0] + rank[own] - starts[at], runs[at, 1]
            yield pa.record_batch([*(batch.column(c) for c in schema.names[:-2]), pa.array(sequence), pa.array(offset)], names=schema.names)

    return mapped(ranked.select(*pieces.columns, "_nth"), run, schema)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


QUERIES = {"op3_best_fit_packing": op3_best_fit_packing}
ORACLE: dict[str, str] = {}
