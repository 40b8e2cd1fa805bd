import collections
import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from quantaloom.llm import components, exact_dedup, sharding, simhash


def brute_fingerprint(text, words=4):
    split = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not split:
        return 0
    shingles = [" ".join(split[i : i + words]) for i in range(len(split) - words + 1)] or [" ".join(split)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def brute_components(n, linked):
    root = list(range(n))
    for _ in range(n):
        new = [min([root[i], *(root[j] for j in range(n) if linked(i, j))]) for i in range(n)]
        if new == root:
            return root
        root = new


def test_simhash_against_brute_force(docs_of):
    random.seed(5)
    base = [" ".join(random.choices("abcdefghij", k=60)) for _ in range(12)]
    texts = base + [t + " end" for t in base] + [t.upper() for t in base] + ["", " \n", "one", "One two", "ünïcode ß 日本"]
    prints = [brute_fingerprint(t) for t in texts]
    want = brute_components(len(texts), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 4)
    got = {r["doc_id"]: r for r in simhash.near_classes(docs_of(*texts)).collect()}
    assert [got[i]["fingerprint"] for i in range(len(texts))] == [f"{p:016x}" for p in prints]
    assert [got[i]["component_id"] for i in range(len(texts))] == want


def test_no_pair_misses_its_blocks():
    random.seed(1)
    for nodes in (10, 10**6, 10**8, 10**10):
        keys = simhash.pigeonhole_keys(4, nodes)
        for _ in range(50):
            a = random.getrandbits(64)
            b = a ^ sum(1 << i for i in random.sample(range(64), 4))
            values = simhash.key_values(np.array([[a], [b]], np.uint64), keys)
            assert (values[0] == values[1]).any()


def test_a_pair_at_the_similarity_shares_a_key_with_the_recall():
    g = np.random.default_rng(3)
    differ = simhash.differing_share(0.8)
    keys = simhash.sampled_keys(differ, simhash.RECALL)
    a = g.integers(0, 1 << 63, (4000, 4), dtype=np.uint64)
    flips = np.packbits(g.random((4000, 256)) < differ, axis=1).view(">u8").astype(np.uint64)
    shared = simhash.key_values(a, keys) == simhash.key_values(a ^ flips, keys)
    assert abs(shared.any(1).mean() - simhash.RECALL) < 0.015
    masks = simhash._masks(keys, 4)
    first = shared.argmax(1)
    assert simhash.first_shared(flips, first, masks)[shared.any(1)].all()
    later = np.array([np.flatnonzero(row)[-1] for row in shared[shared.sum(1) > 1]])
    assert not simhash.first_shared(flips[shared.sum(1) > 1], later, masks).any()


def test_pairs_link_alike_in_tables_of_any_size(docs_of, monkeypatch):
    """The same pairs, alone and among many others, and with the others' keys in many cells."""
    g = random.Random(21)
    word = lambda: "".join(g.choices("abcdefghijklm", k=6))
    pairs = []
    for i in range(40):
        text = [word() for _ in range(150)]
        w = 4 + i % 20  # similarities from about 0.9 down to about 0.7
        pairs += [" ".join(text), " ".join(text[:60] + [word() for _ in range(w)] + text[60 + w :])]
    others = [" ".join(word() for _ in range(g.randint(1, 40))) for _ in range(3000)]
    classes = lambda *texts: {r["doc_id"]: r["component_id"] for r in simhash.similar_classes(docs_of(*texts)).collect() if r["doc_id"] < 80}
    alone = classes(*pairs)
    assert 15 < sum(k != v for k, v in alone.items()) < 40
    assert classes(*pairs, *others) == alone
    monkeypatch.setattr(simhash, "CHUNK", 16)
    monkeypatch.setattr(simhash, "SAMPLE", 1)
    near = [f"{t} extra{i}" for i in range(40) for t in (pairs[0],)]
    assert classes(*pairs, *near) == alone


def test_crowded_blocks_keep_all_links(spark, monkeypatch):
    """More nodes in a block than a chunk has: the classes are those of a comparison of all pairs."""
    monkeypatch.setattr(simhash, "CHUNK", 40)
    monkeypatch.setattr(simhash, "SAMPLE", 1)
    random.seed(2)
    seeds = [random.getrandbits(64) for _ in range(6)]
    values = sorted({s ^ sum(1 << i for i in random.sample(range(64), random.randint(0, 5))) for s in seeds for _ in range(60)})
    nodes = spark.createDataFrame([(bytearray(v.to_bytes(8, "big")),) for v in values], "fp binary")
    found = components.components(simhash.links(nodes, simhash.pigeonhole_keys(4, len(values)), 4))
    got = {int.from_bytes(r["node"], "big"): int.from_bytes(r["root"], "big") for r in found.collect()}
    want = brute_components(len(values), lambda i, j: (values[i] ^ values[j]).bit_count() <= 4)
    assert [got.get(v, v) for v in values] == [values[i] for i in want]


def test_small_and_large_cells_agree():
    g = np.random.default_rng(0)
    prints = g.integers(0, 4, (200, 2)).astype(np.uint64)
    a, b = simhash.close_in_cells(simhash._Cells(np.zeros(200, np.int64), np.zeros(200, np.int64), prints), 1)
    linked = lambda i, j: int(np.bitwise_count(prints[i] ^ prints[j]).sum()) <= 1
    pairs = set(zip(a.tolist(), b.tolist(), strict=True))
    assert len(pairs) < 200 and all(linked(i, j) for i, j in pairs)
    both = pairs | {(j, i) for i, j in pairs}
    assert brute_components(200, lambda i, j: (i, j) in both) == brute_components(200, linked)


def test_similar_texts_lose_their_copies(docs_of):
    random.seed(9)
    word = lambda: "".join(random.choices("abcdefghijklm", k=5))
    originals = [[word() for _ in range(300)] for _ in range(30)]
    copies = []
    for text in originals:
        changed = list(text)
        for at in random.sample(range(300), 4):
            changed[at] = word()
        copies.append(changed)
    rows = docs_of(*(" ".join(t) for t in originals + copies))
    assert sorted(r["doc_id"] for r in simhash.keep_one(rows).collect()) == list(range(30))


@pytest.mark.parametrize("owners", [simhash.OWNERS, 0])
def test_the_exact_similarity_decides(docs_of, monkeypatch, owners):
    monkeypatch.setattr(simhash, "OWNERS", owners)  # by a broadcast, by a shuffle
    """Pairs just below 0.8 stay, which an estimate of the similarity can't tell from those just above."""
    g = random.Random(10)
    word = lambda: "".join(g.choices("abcdefghijklm", k=6))
    originals = [[word() for _ in range(300)] for _ in range(60)]
    copies = [t[:100] + [word() for _ in range(w)] + t[100 + w :] for t, w in zip(originals, [34] * 30 + [25] * 30, strict=True)]
    sets = lambda t: np.unique(simhash.shingle_hashes(" ".join(t), 5))
    shares = [len(np.intersect1d(sets(a), sets(b))) / len(np.union1d(sets(a), sets(b))) for a, b in zip(originals, copies, strict=True)]
    assert all(0.77 < x < 0.78 for x in shares[:30]) and all(0.82 < x < 0.83 for x in shares[30:])
    kept = {r["doc_id"] for r in simhash.keep_one(docs_of(*(" ".join(t) for t in originals + copies))).collect()}
    assert set(range(90)) <= kept and len(kept) <= 91


def test_repeated_ids_lose_only_their_copies(docs_of):
    g = random.Random(11)
    text = lambda: " ".join("".join(g.choices("abcdefghijklm", k=6)) for _ in range(200))
    first, clean, other = text(), text(), text()
    rows = [(1, first), (2, first + " end"), (2, clean), (3, other), (3, other + " end")]
    kept = [(r["doc_id"], r["text"]) for r in simhash.keep_one(docs_of(rows=[(i, t, "", "", 1) for i, t in rows])).collect()]
    assert (1, first) in kept and (2, clean) in kept and sorted(i for i, _ in kept) == [1, 2, 3]


def test_simhash_odd_tables(odd, empty):
    got = simhash.near_classes(odd).collect()
    assert len(got) == 11 and {r["component_id"] for r in got if r["fingerprint"] == "0" * 16} == {1}
    assert simhash.near_classes(empty).count() == 0 and simhash.keep_one(empty).count() == 0
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["0", "1", "4", "6", "None", "None"]


def test_components_of_a_chain_and_a_star(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7)], "x long, y long")
    got = {r["node"]: r["root"] for r in components.components(links).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)}
    assert components.components(links.limit(0)).count() == 0


def test_exact_dedup_against_brute_force(docs_of):
    texts = ["a b", "a  b", "a\tb", None, "", "c", "A b", " a b", "c", "a b"]
    norm = [re.sub(r"[\x20\x09-\x0d]+", " ", t or "") for t in texts]
    index = exact_dedup.DigestIndex(docs_of().sparkSession, "t_index_1")
    got = {r["doc_id"]: r for r in index.add(docs_of(*texts), "b").collect()}
    for i, t in enumerate(norm):
        same = [j for j, u in enumerate(norm) if u == t]
        assert (got[i]["keep_id"], got[i]["group_size"], got[i]["kept"]) == (same[0], len(same), i == same[0])
        assert got[i]["text_sha256"] == hashlib.sha256(t.encode()).hexdigest()


def test_the_index_remembers_batches(docs_of):
    index = exact_dedup.DigestIndex(docs_of().sparkSession, "t_index_2", buckets=3)
    first = docs_of(rows=[(10, "x", "", "", 1), (11, "y", "", "", 1)])
    second = docs_of(rows=[(1, "x", "", "", 1), (2, "z", "", "", 1), (3, "z", "", "", 1)])
    assert {r["doc_id"]: r["kept"] for r in index.add(first, "b1").collect()} == {10: True, 11: True}
    assert {r["doc_id"]: (r["keep_id"], r["kept"]) for r in index.add(second, "b2").collect()} == {1: (10, False), 2: (2, True), 3: (2, False)}
    assert docs_of().sparkSession.table("t_index_2").count() == 3


@pytest.mark.parametrize("parts", [1, 2, 5])
def test_parts_give_the_same_rows_through_the_anti_join(spark, docs_of, parts):
    g = random.Random(16)
    rows = [(i, f"text {g.randint(0, 60)}", "", "", 1) for i in g.sample(range(1000), 300)]
    index = exact_dedup.DigestIndex(spark, f"t_index_parts_{parts}", buckets=3)
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in index.add(docs_of(rows=rows), "b", parts).collect()}
    for i, text, *_ in rows:
        same = [j for j, t, *_ in rows if t == text]
        assert got[i] == (min(same), len(same), i == min(same))
    assert spark.table(index.name).count() == len({t for _, t, *_ in rows})


def test_a_batch_added_again_gives_its_rows_again(spark, docs_of):
    index = exact_dedup.DigestIndex(spark, "t_index_again", buckets=3)
    docs = docs_of(*(f"text {i % 7}" for i in range(40)))
    index.add(docs_of("text 3", "other"), "before")
    once = sorted(map(tuple, index.add(docs, "b").drop("uid").collect()))
    assert sorted(map(tuple, index.add(docs, "b").drop("uid").collect())) == once
    assert sum(r[3] for r in once) == 6 and spark.table("t_index_again").count() == 8


def test_an_index_outlives_its_session(spark, docs_of, tmp_path):
    place = f"file://{tmp_path}/index"
    exact_dedup.DigestIndex(spark, "t_index_lasting", buckets=3, path=place).add(docs_of("a", "b"), "b1")
    spark.sql("DROP TABLE t_index_lasting")  # as in a session with another catalog
    spark.conf.set("spark.sql.shuffle.partitions", "5")
    try:
        index = exact_dedup.DigestIndex(spark, "t_index_lasting", path=place)
        assert index.buckets == 3
        got = {r["doc_id"]: r["kept"] for r in index.add(docs_of(rows=[(7, "b", "", "", 1), (8, "c", "", "", 1)]), "b2").collect()}
        assert got == {7: False, 8: True}
        assert exact_dedup.DigestIndex(spark, "t_index_lasting").buckets == 3
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_exact_dedup_odd_tables(spark, odd, empty):
    index = exact_dedup.DigestIndex(spark, "t_index_3")
    got = index.add(odd, "b", parts=3).collect()
    assert len(got) == 11 and sum(r["kept"] for r in got) == 6
    kept = exact_dedup.keep_first(odd)
    assert kept.columns == odd.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["0", "1", "4", "5", "6", "None"]
    assert exact_dedup.keep_first(empty).count() == 0 and exact_dedup.DigestIndex(spark, "t_index_4").add(empty, "b").count() == 0


def brute_jump(key, shards):
    at, ahead = -1, 0
    while ahead < shards:
        at = ahead
        key = (key * 2862933555777941757 + 1) & (2**64 - 1)
        ahead = int((at + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return at


def test_jump_against_the_published_loop():
    random.seed(3)
    keys = [0, 1, 2**64 - 1] + [random.getrandbits(64) for _ in range(500)]
    for shards in (1, 2, 24, 25, 1000):
        assert sharding.jump(np.array(keys, np.uint64), shards).tolist() == [brute_jump(k, shards) for k in keys]


def test_shards(docs_of, odd, empty):
    rows = sharding.shard(docs_of(*(f"t{i % 50}" for i in range(600)))).collect()
    assert all((r["shard"] == r["grown_shard"]) or r["grown_shard"] == 24 for r in rows) and {r["shard"] for r in rows} == set(range(24))
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    got = sharding.shard(odd).collect()
    assert len(got) == 11 and {(r["size"], r["text_crc32"]) for r in got if r["doc_id"] in (1, 2)} == {(8, 0)}
    assert len({(r["shard"], r["slot"]) for r in got}) == 11 and sharding.shard(empty).count() == 0
    with pytest.raises(ValueError):
        sharding.shard_of(None, 0)
