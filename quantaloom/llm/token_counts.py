"""Token counts by heap-and-linked-list byte-pair merging.

A text's characters are the initial symbols. A heap holds adjacent pairs that the vocabulary has as one piece, lowest
rank (best score) first, leftmost first among equals; popping one joins the pair in a linked list and offers the new
neighbours. The count is the symbols less the merges; a symbol left that the vocabulary lacks counts a token for each of
its UTF-8 bytes. No identifiers are made.

Pieces never hold certain neighbours (for one, a space mark after a letter), so merges never cross such a place:
texts fall apart there, and the count of each part is kept in a bounded memo.

Defined results: a null text counts as empty, with no tokens; texts of any length are counted whole; repeated rows are
counted each; a null doc_id stays null; an empty table gives no rows; columns other than doc_id and text are not looked at,
whatever their names.
"""

from __future__ import annotations

import functools
import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quantaloom.llm._common import mapped, slices, table, texts_of

SPACE = "▁"
#: Parts of a text whose counts a worker keeps, and the longest part kept.
MEMO_PARTS, MEMO_CHARS = 400_000, 48


class BytePairCounter:
    """Counts the tokens of texts for a byte-pair model file of the sentencepiece library."""

    def __init__(self, model_file: str) -> None:
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(model_file, "rb") as f:
            model.ParseFromString(f.read())
        if model.trainer_spec.model_type != proto.TrainerSpec.BPE or model.normalizer_spec.name != "identity" or model.normalizer_spec.remove_extra_whitespaces or not model.trainer_spec.byte_fallback:
            raise ValueError("a byte-pair model with byte fallback and no normalisation is expected")
        self.prefix = SPACE if model.normalizer_spec.add_dummy_prefix else ""
        self.rank = {p.piece: -p.score for p in model.pieces if p.type == proto.ModelProto.SentencePiece.NORMAL}
        self.pairs = {p[i : i + 2] for p in self.rank for i in range(len(p) - 1)}
        if any(x[1] == SPACE != x[0] or "\n" in x for x in self.pairs):
            raise ValueError("a piece of this model goes on over a space or line end")
        self.parts = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n").findall
        self.memo = _Memo(self._part)
        self.small = _Memo(self.merged)

    def count(self, text: str) -> int:
        if not text:
            return 0
        return sum(map(self.memo.__getitem__, self.parts(self.prefix + text.replace(" ", SPACE))))

    def _part(self, part: str) -> int:
        """Apart wherever no piece holds the two characters as neighbours."""
        total, start, pairs = 0, 0, self.pairs
        for i in range(1, len(part)):
            if part[i - 1 : i + 1] not in pairs:
                total += self.small[part[start:i]]
                start = i
        return total + self.small[part[start:]]

    def merged(self, part: str) -> int:
        rank, n = self.rank, len(part)
        if n == 1 or part in rank and n == 2:
            return 1 if part in rank else len(part.encode())
        symbol: list[str] = list(part)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(r, i, i + 1, 2) for i in range(n - 1) if (r := rank.get(part[i : i + 2])) is not None]
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, a, b, size = heapq.heappop(heap)
            if not symbol[a] or not symbol[b] or len(symbol[a]) + len(symbol[b]) != size or right[a] != b:
                continue
            symbol[a] += symbol[b]
            symbol[b] = ""
            merges += 1
            right[a] = after = right[b]
            if after >= 0:
                left[after] = a
                if (r := rank.get(symbol[a] + symbol[after])) is not None:
                    heapq.heappush(heap, (r, a, after, len(symbol[a]) + len(symbol[after])))
            if (before := left[a]) >= 0 and (r := rank.get(symbol[before] + symbol[a])) is not None:
                heapq.heappush(heap, (r, before, a, len(symbol[before]) + len(symbol[a])))
        spelled = sum(len(s.encode()) - 1 for s in symbol if s and s not in rank)
        return n - merges + spelled


class _Memo(dict):
    """Results by part; emptied when full, so that a worker's memory is bounded."""

    def __init__(self, make) -> None:
        self.make = make

    def __missing__(self, part: str) -> int:
        found = self.make(part)
        if len(part) <= MEMO_CHARS:
            if len(self) >= MEMO_PARTS:
                self.clear()
            self[part] = found
        return found


@functools.lru_cache(maxsize=2)
def counter(model_file: str) -> BytePairCounter:
    """One for each worker, so that its memo outlives a task."""
    return BytePairCounter(model_file)


def count_tokens(docs: DataFrame, model_file: str | None = None, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row. ``model_file``: a path that every executor has."""
    schema = docs.select("doc_id").schema.add("n_bytes", "long").add("n_tokens", "long").add("over_limit", "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(model_file or default_model()).count
        for batch in slices(batches):
            texts = texts_of(batch)
            tokens = [count(t) for t in texts]
            yield pa.record_batch([batch.column("doc_id"), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())], names=schema.names)

    return mapped(docs.select("doc_id", "text"), run, schema)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))


QUERIES = {"op9_token_counts": op9_token_counts}
ORACLE: dict[str, str] = {}
