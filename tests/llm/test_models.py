import random
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from quantaloom.llm import chat_format, toxicity
from quantaloom.llm._words import words_of


def made_texts(n, seed):
    g = random.Random(seed)
    vocabulary = ["".join(g.choices("aeioustnr", k=g.randint(2, 7))) for _ in range(500)]
    rows = []
    for i in range(n):
        split = g.choices(vocabulary, k=g.randint(5, 150))
        toxic = i % 4 == 0
        for _ in range(max(1, len(split) // 40) if toxic else 0):
            split[g.randrange(len(split))] = "zqx" + "".join(g.choices("aeio", k=3))
        rows.append((" ".join(split), int(toxic)))
    return rows


@pytest.fixture(scope="module")
def net():
    rows = made_texts(300, 1)
    return toxicity.train([t for t, _ in rows], [y for _, y in rows])


def test_gradients_are_those_of_differences():
    words = words_of(["one two three", "four two " * 20])
    types = toxicity.types_of(words)
    windows, _ = toxicity.windows_of(words)
    at = np.r_[types.of, len(types.word)][windows]
    net, g = toxicity.Network(), np.random.default_rng(0)
    net.p = {k: (v + g.normal(0, 0.2, v.shape)).astype(np.float64) for k, v in net.p.items()}
    target, weight, gate = g.integers(0, 2, len(at)).astype(float), g.random(len(at)), np.ones(len(types.word))

    def loss():
        y = net.run(net.inputs(net.projected(net.vectors(types)), at))[0]
        p = 1 / (1 + np.exp(-y))
        return -(weight * (target * np.log(p) + (1 - target) * np.log(1 - p))).sum() / weight.sum()

    grads = net.gradients(types, at, target, weight, gate)
    for name, d in grads.items():
        flat = net.p[name].reshape(-1)
        for i in np.argsort(-np.abs(d).reshape(-1))[:3]:
            old = flat[i]
            flat[i] = old + 1e-3
            up = loss()
            flat[i] = old - 1e-3
            down = loss()
            flat[i] = old
            assert (up - down) / 2e-3 == pytest.approx(d.reshape(-1)[i], rel=0.05, abs=1e-4), name


def test_held_out_accuracy(net):
    rows = made_texts(200, 2)
    scores = net.scores(words_of([t for t, _ in rows]))
    toxic = np.array([y for _, y in rows]) == 1
    assert (scores[toxic] >= toxicity.THRESHOLD).mean() > 0.9 and (scores[~toxic] < toxicity.THRESHOLD).mean() > 0.9


def test_windows_cover_whole_texts(net):
    clean = " ".join(["the"] * 5000)
    for place in (0, 2500, 5000):
        split = clean.split()
        split.insert(place, "zqxaio zqxoia zqxeee")
        assert net.scores(words_of([" ".join(split)]))[0] > net.scores(words_of([clean]))[0] + 0.2
    words = words_of(["a " * n for n in range(0, 120)])
    windows, doc = toxicity.windows_of(words)
    for n in range(120):
        own = windows[doc == n]
        assert set(own[own >= 0].tolist()) == set(range(*words.bounds()[n : n + 2]))


def test_scores_do_not_depend_on_neighbours(net):
    texts = [t for t, _ in made_texts(40, 3)]
    together = net.scores(words_of(texts))
    assert np.allclose(together, [net.scores(words_of([t]))[0] for t in texts], atol=1e-5)


def test_toxicity_tables(spark, net, odd, empty):
    got = toxicity.score(odd, net).collect()
    assert len(got) == 11 and [r["held_out"] for r in got] == [r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in odd.collect()]
    assert {r["score"] for r in got if r["doc_id"] in (1, 2, 5)} == {0.0}
    assert toxicity.score(empty, net).count() == 0 and toxicity.keep_clean(empty, net).count() == 0
    assert toxicity.keep_clean(odd, net, 2.0).columns == odd.columns and toxicity.keep_clean(odd, net, 2.0).count() == 11
    assert {r["score"] for r in toxicity.score(odd, None).collect()} == {0.0}


def test_training_rows_leave_out_the_held_out(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(200)] + [(None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 3 == 0) for i in range(200)] + [(None, True), (3, None)], "doc_id long, toxic boolean").selectExpr("doc_id", "cast(toxic as int) toxic", "0 quality")
    texts, toxic = toxicity.training_rows(docs, labels)
    ids = [int(t.split()[1]) for t in texts]
    assert ids == [i for i in range(200) if zlib.crc32(str(i).encode()) % 4 != 2] and toxic == [int(i % 3 == 0) for i in ids]
    many = docs.unionByName(spark.range(3000).selectExpr("5L AS doc_id", "concat('again ', id) AS text")).unionByName(spark.createDataFrame([(7, "x" * 300_000)], docs.schema))
    assert len(toxicity.training_rows(many, labels)[0]) == len(ids)  # one text an id, none too long
    assert toxicity.train(["a", "b"], [0, 0]) is None and toxicity.train([], []) is None


def brute_chats(rows):
    chats = {}
    for conv, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        chats.setdefault(conv, []).append((role or "", text or ""))
    out = {}
    for conv, turns in chats.items():
        same = [c for c, t in chats.items() if t == turns]
        if conv == min(same) and not any(len(t) > len(turns) and t[: len(turns)] == turns for t in chats.values()):
            text, spans = "", []
            for role, said in turns:
                head = text + f"<|im_start|>{role}\n"
                if role == "assistant":
                    spans.append((len(head), len(head) + len(said)))
                text = head + said + "<|im_end|>\n"
            out[conv] = (len(turns), len(same), text, spans)
    return out


def test_chats_against_brute_force(spark):
    g = random.Random(8)
    rows = []
    for conv in range(120):
        start = g.choice([[("user", "hi"), ("assistant", "yes?")], [("system", None), ("user", "")], []])
        turns = start + [(g.choice(["user", "assistant", None]), g.choice(["a", "é😀", None])) for _ in range(g.randint(0 if start else 1, 3))]
        rows += [(conv, i, r, t, 1) for i, (r, t) in enumerate(turns)]
    rows += [(None, 0, "user", "x", 1), (500, None, "user", "first", 1), (500, 0, "user", "second", 1), (501, 0, "user", "long " * 20_000, 1)]
    g.shuffle(rows)
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, digest int")
    got = {r["conv_id"]: (r["n_turns"], r["copies"], r["text"], [tuple(s) for s in r["reply_spans"]]) for r in chat_format.format_chats(table).collect()}
    assert got == brute_chats([r[:4] for r in rows])
    assert chat_format.format_chats(table.limit(0)).count() == 0


def test_a_conversation_of_many_turns(spark):
    turns = spark.range(32_000).selectExpr("7L AS conv_id", "id AS turn", "IF(id % 2 = 0, 'user', 'assistant') AS role", "concat('said ', id) AS text")
    began = time.perf_counter()
    got = chat_format.format_chats(turns.unionByName(turns.where("turn < 31000").withColumn("conv_id", F.lit(8).cast("long")))).collect()
    assert time.perf_counter() - began < 30
    assert [(r["conv_id"], r["n_turns"], len(r["reply_spans"])) for r in got] == [(7, 32_000, 16_000)]
    assert [got[0]["text"][s["first"] : s["end"]] for s in got[0]["reply_spans"][-2:]] == ["said 31997", "said 31999"]


def test_the_pipeline_on_odd_and_empty_tables(spark, odd, empty, write_tables, tmp_path):
    labels = spark.createDataFrame([(0, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    benchmark = spark.createDataFrame([(5, "null id here")], "item_id long, text string")
    path = write_tables(documents=odd, labels=labels, benchmark=benchmark)
    got = corpus_pipeline.run(spark, path).collect()
    # Of equal texts one stays; "a  b\tc d e f" (7) is a copy of 0; the row without an id has the item.
    assert sorted({str(r["doc_id"]) for r in got}) == ["0", "1", "4", "6"] and sum(r["piece"] == 0 for r in got) == 4
    for name, df in (("documents", empty), ("labels", labels.limit(0)), ("benchmark", benchmark.limit(0))):
        df.write.parquet(f"{tmp_path}/none/{name}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_the_pipeline_does_what_its_stages_say(spark, write_tables):
    g = random.Random(11)
    word = lambda: "".join(g.choices("bcdfghjklmnp", k=5))
    clean = [" ".join(word() for _ in range(120)) for _ in range(60)]
    toxic = [" ".join(word() if i % 15 else "zqx" + "".join(g.choices("aeio", k=3)) for i in range(120)) for _ in range(60)]
    items = [" ".join(word() for _ in range(25)) for _ in range(5)]
    near = [" ".join([*t.split()[:-1], word()]) for t in clean[:10]]
    leaks = [f"{c} {i}" for c, i in zip([" ".join(word() for _ in range(60)) for _ in range(5)], items, strict=True)]
    texts = clean + toxic + clean[:8] + near + leaks + [None]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, 1, int(60 <= i < 120)) for i in range(120)], "doc_id long, quality int, toxic int")
    path = write_tables(documents=docs, labels=labels, benchmark=spark.createDataFrame(list(enumerate(items)), "item_id long, text string"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "simhash_near_dedup", "benchmark_decontamination", "best_fit_packing"]
    assert corpus_pipeline.drop_near_copies(spark, docs, path).columns == docs.columns
    kept = {r["doc_id"] for r in corpus_pipeline.run(spark, path).collect()}
    assert len(kept & set(range(60))) >= 58 and len(kept & set(range(60, 120))) <= 3  # a small sample to learn from
    assert not kept & set(range(120, 143)) and len(texts) - 1 in kept


def test_the_registry_has_all_ten_and_the_pipeline():
    names = set(__spark_entry__.queries())
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 11)} and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= names
