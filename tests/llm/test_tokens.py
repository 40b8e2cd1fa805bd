import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from quantaloom.llm import packing, token_counts

ALPHABET = ["a", "th", " the ", " ", "  ", "\n", "\r\n", "\t", "▁", "é", "É", "ß", "日本", "😀", "\x00", "<s>", "</s>", "<unk>", "<0x0A>", "<|endoftext|>", "<|", "1", "23", "...", ",", "'s", "don't", "$$$", "İ", "ﬁ", "́", "\xa0", "Σ", "K", "\x1c", "\x85"]


def random_texts(n, seed):
    g = random.Random(seed)
    return ["".join(g.choices(ALPHABET, k=g.randint(0, 25))) for _ in range(n)]


def test_counts_are_the_library_s():
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=token_counts.default_model())
    count = token_counts.BytePairCounter(token_counts.default_model()).count
    for text in [*random_texts(3000, 1), "x" * 5000, "ab" * 3000 + " c"]:
        assert count(text) == len(library.encode(text)), text


def test_token_counts_odd_tables(odd, empty):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=token_counts.default_model())
    texts = [r["text"] or "" for r in odd.collect()]
    got = token_counts.count_tokens(odd, limit=5).collect()
    assert [(r["n_tokens"], r["n_bytes"], r["over_limit"]) for r in got] == [(n := len(library.encode(t)), len(t.encode()), n > 5) for t in texts]
    assert token_counts.count_tokens(empty).count() == 0


def test_ids_are_the_library_s():
    library = Tokenizer.from_file(packing.default_vocabulary())
    own = packing.WordEncoder(packing.default_vocabulary())
    g = random.Random(12)
    latin = [chr(c) for c in range(1, 256)] + list("\u2010\u2013\u2019\u201c\u2026\u2027'") + ["'s", "'LL", " don't"]
    texts = random_texts(3000, 2) + ["".join(g.choices(latin, k=g.randint(1, 30))) for _ in range(3000)]
    texts += ["".join(g.choices("abcdeiorstnÉéßü", k=g.randint(1, 25))) for _ in range(3000)] + ["x" * 5000, "ab" * 60_000, "é\u0301'", ""]
    want = library.encode_batch(texts, add_special_tokens=False)
    for text, encoded in zip(texts, want, strict=True):
        assert own.ids(text).tobytes() == np.array(encoded.ids, "<u4").tobytes(), text


def test_each_piece_of_the_vocabulary_as_the_library_reads_it():
    library = Tokenizer.from_file(packing.default_vocabulary())
    own = packing.WordEncoder(packing.default_vocabulary())
    assert own.merger is not None
    pieces = [p.removesuffix("</w>") for p in library.get_vocab(with_added_tokens=False) if p.isascii()]
    for some in (pieces[i : i + 500] for i in range(0, len(pieces), 500)):
        for text in (" ".join(some), "".join(some)):
            assert own.ids(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_vocabularies_of_other_forms_go_to_the_library():
    import public_tokenizers

    own = packing.WordEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert own.merger is None and own.ids("Hello world").tolist() == own.tokenizer.encode("Hello world", add_special_tokens=False).ids


def filled(plan, histogram):
    bins = {}
    for length, starts in plan.starts.items():
        for i, (sequence, offset) in enumerate(plan.runs[length]):
            stop = (starts + [plan.used[length]])[i + 1]
            for n in range(stop - starts[i]):
                bins.setdefault(sequence + n, []).append((offset, length))
    assert plan.used == histogram and len(bins) == plan.sequences
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= plan.capacity
    return bins


def fewest(lengths, capacity):
    """The least number of sequences, by trying all placements."""
    best = len(lengths)
    lengths = sorted(lengths, reverse=True)

    def go(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(lengths):
            best = len(rooms)
            return
        for k in range(len(rooms)):
            if rooms[k] >= lengths[i] and rooms[k] not in rooms[:k]:
                go(i + 1, rooms[:k] + [rooms[k] - lengths[i]] + rooms[k + 1 :])
        go(i + 1, [*rooms, capacity - lengths[i]])

    go(0, [])
    return best


def test_plans_are_gapless_and_reduction_never_costs_a_sequence():
    g = random.Random(4)
    for _ in range(150):
        capacity = g.randint(4, 30)
        lengths = [g.randint(1, capacity) for _ in range(g.randint(1, 9))]
        histogram = {x: lengths.count(x) for x in set(lengths)}
        plan = packing.make_plan(histogram, capacity)
        filled(plan, histogram)
        # What reduction leaves, packed at best, and what it fixed make the fewest possible.
        fixed, left = packing.Plan(capacity), dict(histogram)
        packing.reduce(fixed, left)
        rest = [x for x, n in left.items() for _ in range(n)]
        assert fixed.sequences + fewest(rest, capacity) == fewest(lengths, capacity)


def test_packing_odd_tables(odd, empty):
    library = Tokenizer.from_file(packing.default_vocabulary())
    capacity = 512
    rows = packing.pack(odd, capacity).collect()
    want = []
    for r in odd.collect():
        ids = [*library.encode(r["text"] or "", add_special_tokens=False).ids, 1]
        want += [(str(r["doc_id"]), p, at, len(ids[at : at + capacity]), zlib.crc32(np.array(ids[at : at + capacity], "<u4").tobytes())) for p, at in enumerate(range(0, len(ids), capacity))]
    assert sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == sorted(want)
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in bins.values():
        places.sort()
        assert [o for o, _ in places] == [sum(n for _, n in places[:i]) for i in range(len(places))] and sum(n for _, n in places) <= capacity
    assert packing.pack(empty).count() == 0


def test_a_wrong_model_is_refused(tmp_path):
    with pytest.raises(Exception):
        token_counts.BytePairCounter(str(tmp_path / "none"))
