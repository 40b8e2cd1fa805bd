"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained and run in numpy.

Inputs are words, by a hashed word vector and the mean of hashed vectors of the word's character trigrams (with its begin
and end). A text is scored in overlapping windows of ``WINDOW`` words, ``STRIDE`` apart, each by the network; the text's
score is that of its worst window. Training sees texts with a label only, so windows of a toxic text count at first with
little weight, then only the text's worst window does.

The sample to learn from is bounded (``MAX_TOXIC`` and ``MAX_CLEAN`` texts, by hash of their id, one text an id, none of over
``MAX_CHARS`` characters) and taken from rows with crc32(doc_id as text) mod 4 other than 2; labels, lang, source and doc_id are
no inputs. The scale of the scores is set on texts that were not learnt from: a fifth of the sample; of a sample with
fewer than ``FEW`` toxic texts all, each by a network that did not see it.

Defined results: a null text counts as empty; a text without words scores 0. Rows are scored each, repeated ones alike;
texts are read whole. Null doc_ids are scored, not held out and never trained on. Without labelled rows of both kinds
all scores are 0. An empty table gives no rows. Other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantaloom.llm._common import mapped, slices, table, texts_of
from quantaloom.llm._words import Words, grouped, mix, words_of

#: Bound of the training sample: labelled texts of each kind.
MAX_TOXIC, MAX_CLEAN, MAX_CHARS = 700, 1300, 200_000
#: Toxic texts of a sample below which its scale is set on all folds; how many folds a large and a small sample has.
FEW, FOLDS, FOLDS_OF_FEW = 150, 5, 3
WINDOW, STRIDE = 32, 16
#: Hash buckets of words and character trigrams; width of their vectors and of each direction's state.
WORD_BUCKETS, GRAM_BUCKETS, WIDTH, STATE = 1 << 14, 1 << 13, 16, 8
EPOCHS, MAX_ROUNDS, BATCH, RATE, DECAY, SEED = 4, 12, 256, 0.01, 0.01, 7
THRESHOLD = 0.3
KEEP_WORD = 0.5
#: Windows that the network runs over at once.
WINDOWS_AT_ONCE = 4096


@dataclass
class Types:
    """The distinct words of some texts: bucket of each, and its trigrams' buckets one after the other."""

    word: np.ndarray
    grams: np.ndarray
    gram_start: np.ndarray
    of: np.ndarray


def types_of(words: Words) -> Types:
    _, first, of = np.unique(words.hash, return_index=True, return_inverse=True)
    start, end = words.start[first], words.end[first]
    size = end - start
    # A trigram is centred on each byte of a word; the bytes around a word are separators, and so mark begin and end.
    at = np.repeat(start - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
    inside = np.r_[np.uint8(10), words.raw, np.uint8(10)].astype(np.uint64)
    owner_start, owner_end = np.repeat(start, size), np.repeat(end, size)
    left = np.where(at > owner_start, inside[at], np.uint64(1))
    right = np.where(at + 1 < owner_end, inside[at + 2], np.uint64(2))
    grams = mix(left << np.uint64(16) | inside[at + 1] << np.uint64(8) | right) % np.uint64(GRAM_BUCKETS)
    return Types((words.hash[first] % np.uint64(WORD_BUCKETS)).astype(np.int64), grams.astype(np.int64), np.r_[0, np.cumsum(size)].astype(np.int64), of.astype(np.int64))


def windows_of(words: Words, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray]:
    """(windows, text of each): numbers of words, -1 beyond the text's end. Windows overlap and cover every word."""
    bounds = words.bounds()
    n = np.diff(bounds)
    count = np.where(n > 0, 1 + np.maximum(0, -(-(n - WINDOW) // stride)), 0)
    doc = np.repeat(np.arange(words.n_docs), count)
    nth = np.arange(len(doc)) - np.repeat(np.r_[0, np.cumsum(count)[:-1]], count)
    at = (bounds[doc] + nth * stride)[:, None] + np.arange(WINDOW)
    return np.where(at < bounds[doc + 1][:, None], at, -1), doc


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


class Network:
    """Parameters by name; every array is float32."""

    def __init__(self, parameters: dict[str, np.ndarray] | None = None) -> None:
        if parameters is None:
            g = np.random.default_rng(SEED)
            h = STATE
            parameters = {
                "words": np.zeros((WORD_BUCKETS, WIDTH)), "grams": g.normal(0, 0.1, (GRAM_BUCKETS, WIDTH)), "in": g.normal(0, WIDTH**-0.5, (WIDTH, 6 * h)), "in_b": np.zeros(6 * h),
                "state": g.normal(0, h**-0.5, (2, h, 3 * h)), "state_b": np.zeros((2, 1, h)), "attend": g.normal(0, 0.3, 2 * h), "out": g.normal(0, 0.3, 2 * h), "out_b": np.full(1, -1.0), "scale": np.array([1.0, 0.0]),
            }
        self.p = {k: v.astype(np.float32) for k, v in parameters.items()}

    def vectors(self, types: Types, some: np.ndarray | None = None, word_gate: np.ndarray | None = None) -> np.ndarray:
        """The input vector of each type: its word's, plus the mean of its trigrams'."""
        own = self.p["words"][types.word]
        if word_gate is not None:
            own = own * word_gate[:, None]
        size = np.diff(types.gram_start)
        return own + np.add.reduceat(self.p["grams"][types.grams], types.gram_start[:-1], axis=0) / size[:, None].astype(np.float32)

    def run(self, inputs: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list, np.ndarray]:
        """Logits of windows. ``inputs``: (2, steps, windows, 3 * STATE + 1), direction first, in each one's order of
        reading; the last column is 1 where there is a word. ``keep``: what back-propagation needs."""
        h, steps, n = STATE, inputs.shape[1], inputs.shape[2]
        state = np.zeros((2, n, h), np.float32)
        states = np.empty((2, steps, n, h), np.float32)
        kept = []
        for t in range(steps):
            x, there = inputs[:, t, :, : 3 * h], inputs[:, t, :, 3 * h :]
            u = state @ self.p["state"]
            gates = _sigmoid(x[..., : 2 * h] + u[..., : 2 * h])
            z, r = gates[..., :h], gates[..., h:]
            un = u[..., 2 * h :] + self.p["state_b"]
            new = np.tanh(x[..., 2 * h :] + r * un)
            if keep:
                kept.append((state, z, r, un, new, there))
            state = state + there * (1 - z) * (new - state)
            states[:, t] = state
        both = np.concatenate([states[0], states[1, ::-1]], axis=2)  # steps, windows, 2h
        weight = both @ self.p["attend"] + np.where(inputs[0, :, :, 3 * h] > 0, 0, -1e9).astype(np.float32)
        weight = np.exp(weight - weight.max(0))
        weight /= weight.sum(0)
        pooled = np.einsum("tn,tnh->nh", weight, both)
        return pooled @ self.p["out"] + self.p["out_b"], [kept, both, weight, pooled], states

    def inputs(self, projected: np.ndarray, at: np.ndarray) -> np.ndarray:
        """``projected``: 6 * STATE columns of each type, and a last row of zeros for no word; ``at``: types of windows."""
        h = STATE
        x = np.concatenate([projected, np.ones((len(projected), 1), np.float32)], 1)
        x[-1] = 0
        forward, backward = x[:, [*range(3 * h), 6 * h]], x[:, 3 * h :]
        return np.stack([forward[at.T], backward[at.T[::-1]]])

    def projected(self, vectors: np.ndarray) -> np.ndarray:
        return np.concatenate([vectors @ self.p["in"] + self.p["in_b"], np.zeros((1, 6 * STATE), np.float32)])

    def scores(self, words: Words) -> np.ndarray:
        """The score of each text: its worst window's; 0 without words."""
        out = np.zeros(words.n_docs)
        if len(words.hash):
            types = types_of(words)
            projected = self.projected(self.vectors(types))
            windows, doc = windows_of(words)
            of = np.r_[types.of, len(projected) - 1]
            for at in range(0, len(windows), WINDOWS_AT_ONCE):
                logits, _, _ = self.run(self.inputs(projected, of[windows[at : at + WINDOWS_AT_ONCE]]))
                np.maximum.at(out, doc[at : at + WINDOWS_AT_ONCE], _sigmoid(self.p["scale"][0] * logits.astype(np.float64) + self.p["scale"][1]))
        return out

    def gradients(self, types: Types, at: np.ndarray, target: np.ndarray, weight: np.ndarray, gate: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the weighted cross-entropy of windows ``at`` (types; the last number + 1 is no word)."""
        h, p = STATE, self.p
        vectors = self.vectors(types, word_gate=gate)
        inputs = self.inputs(self.projected(vectors), at)
        logits, (kept, both, attention, pooled), _ = self.run(inputs, keep=True)
        d_logit = ((_sigmoid(logits) - target) * weight / max(weight.sum(), 1e-6)).astype(np.float32)
        d_pooled = d_logit[:, None] * p["out"]
        d_attention = np.einsum("nh,tnh->tn", d_pooled, both)
        d_weight = attention * (d_attention - (attention * d_attention).sum(0))
        d_both = attention[:, :, None] * d_pooled + d_weight[:, :, None] * p["attend"]
        out = {"out": pooled.T @ d_logit, "out_b": d_logit.sum(keepdims=True), "attend": np.einsum("tn,tnh->h", d_weight, both)}
        d_states = np.stack([d_both[:, :, :h], d_both[::-1, :, h:]])
        d_in = np.zeros((*inputs.shape[:3], 3 * h), np.float32)
        d_u_state, d_b = np.zeros_like(p["state"]), np.zeros_like(p["state_b"])
        d_state = np.zeros_like(kept[0][0])
        back = p["state"].transpose(0, 2, 1)
        for t in range(len(kept) - 1, -1, -1):
            state, z, r, un, new, there = kept[t]
            d_state = d_state + d_states[:, t]
            d_new = d_state * there * (1 - z) * (1 - new * new)
            d_z = d_state * there * (state - new) * z * (1 - z)
            d_r = d_new * un * r * (1 - r)
            d_un = d_new * r
            d_in[:, t] = np.concatenate([d_z, d_r, d_new], 2)
            d_u = np.concatenate([d_z, d_r, d_un], 2)
            d_u_state += state.transpose(0, 2, 1) @ d_u
            d_b += d_un.sum(1, keepdims=True)
            d_state = d_state * (1 - there * (1 - z)) + d_u @ back
        out |= {"state": d_u_state, "state_b": d_b}
        # To the types: sum the steps that read each.
        flat = np.concatenate([d_in[0].transpose(1, 0, 2), d_in[1, ::-1].transpose(1, 0, 2)], 2).reshape(-1, 6 * h)
        order = np.argsort(at.ravel(), kind="stable")
        ids, starts = np.unique(at.ravel()[order], return_index=True)
        d_types = np.zeros((len(vectors) + 1, 6 * h), np.float32)
        d_types[ids] = np.add.reduceat(flat[order], starts, axis=0)
        d_types = d_types[:-1]
        out |= {"in": vectors.T @ d_types, "in_b": d_types.sum(0)}
        d_vectors = d_types @ p["in"].T
        out["words"] = np.zeros_like(p["words"])
        np.add.at(out["words"], types.word, d_vectors * gate[:, None])
        size = np.diff(types.gram_start)
        out["grams"] = np.zeros_like(p["grams"])
        np.add.at(out["grams"], types.grams, np.repeat(d_vectors / size[:, None].astype(np.float32), size, axis=0))
        return out


def _part(types: Types, windows: np.ndarray) -> tuple[Types, np.ndarray]:
    """The types that some windows have, and the windows by those."""
    ids, at = np.unique(windows, return_inverse=True)
    none = len(ids) and ids[-1] == len(types.word)
    ids = ids[:-1] if none else ids
    size = np.diff(types.gram_start)[ids]
    grams = np.repeat(types.gram_start[ids] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
    return Types(types.word[ids], types.grams[grams], np.r_[0, np.cumsum(size)], at), at.reshape(windows.shape)


def train(texts: list[str], toxic: list[int]) -> Network | None:
    """A network learnt from whole texts and their labels; None unless there are both kinds."""
    labels = np.array(toxic)
    if len(set(toxic)) < 2:
        return None
    words = words_of(texts)
    types = types_of(words)
    windows, doc = windows_of(words)
    windows = np.r_[types.of, len(types.word)][windows]
    few = (labels == 1).sum() < FEW
    fold = np.where(labels == 1, np.cumsum(labels == 1), np.cumsum(labels != 1)) % (FOLDS_OF_FEW if few else FOLDS)
    logits, net = np.full(len(labels), -np.inf), None
    for aside in range(FOLDS_OF_FEW if few else 1):
        net = learn(types, windows, doc, labels, fold != aside)
        _, worst = _window_logits(net, types, windows, doc, len(labels))
        logits[fold == aside] = worst[fold == aside]
    if few:
        net = learn(types, windows, doc, labels, np.ones(len(labels), bool))
    judge = np.isfinite(logits)
    if len(set(labels[judge])) == 2:
        net.p["scale"] = _scale(logits[judge], labels[judge])
    return net


def learn(types: Types, windows: np.ndarray, doc: np.ndarray, labels: np.ndarray, own: np.ndarray) -> Network:
    """A network learnt from the texts that are ``own``."""
    aside = ~own[doc]
    target = labels[doc].astype(np.float32)
    net, g = Network(), np.random.default_rng(SEED)
    learnt = [k for k in net.p if k != "scale"]
    first, second, step = {k: np.zeros_like(net.p[k]) for k in learnt}, {k: np.zeros_like(net.p[k]) for k in learnt}, 0
    likely = _likely(types, windows, doc, labels, own)
    # Few texts are gone over more often, up to a number of steps that many texts need as well.
    rounds = max(EPOCHS, min(MAX_ROUNDS, 600 * BATCH // max(1, len(windows))))
    for epoch in range(rounds):
        weight = np.where(aside, 0, 1).astype(np.float32)
        positive = target > 0
        if epoch < max(1, rounds // 4):
            weight[positive] *= likely[positive]
        else:
            # Only a toxic text's worst windows are surely toxic; its others are left out. Of a clean text the worst
            # windows weigh most, as they make its score.
            score, worst = _window_logits(net, types, windows, doc, len(labels))
            near = score >= np.where(positive, np.minimum(worst[doc], 2.0), worst[doc] - 0.5)
            weight *= np.where(near, 1.0, np.where(positive, 0.0, 0.2))
        # Both kinds weigh alike.
        weight[positive] *= max(1.0, 0.5 * weight[~positive].sum() / max(1.0, weight[positive].sum()))
        live = np.flatnonzero(weight)
        g.shuffle(live)
        for at in np.array_split(live, max(1, len(live) // min(BATCH, max(32, len(live) // 40)))):
            some, ids = _part(types, windows[at])
            gate = (g.random(len(some.word)) < KEEP_WORD).astype(np.float32)  # words are dropped, so that characters must tell
            grads = net.gradients(some, ids, target[at], weight[at], gate)
            step += 1
            rate = RATE * (1 - 0.9 * epoch / rounds)
            for k, d in grads.items():
                d = np.clip(d, -1, 1)
                first[k] += 0.1 * (d - first[k])
                second[k] += 0.01 * (d * d - second[k])
                net.p[k] -= rate * (first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-7) + DECAY * net.p[k])
    return net


def _likely(types: Types, windows: np.ndarray, doc: np.ndarray, labels: np.ndarray, learn: np.ndarray) -> np.ndarray:
    """Which windows to begin with: those of a text whose words or trigrams are the most peculiar to toxic texts.

    Peculiar: the log odds of a toxic text among those that have it, times the root of the number of toxic ones.
    """
    size = np.diff(types.gram_start)
    owner = np.repeat(np.arange(len(size)), size)
    pairs = np.unique(np.stack([np.repeat(doc, windows.shape[1]), windows.ravel()]), axis=1)
    pairs = pairs[:, (pairs[1] < len(types.word)) & learn[pairs[0]]]
    toxic, n = labels[pairs[0]] == 1, (max(1, (labels[learn] == 1).sum()), max(1, (labels[learn] == 0).sum()))

    def peculiar(have: list[np.ndarray]) -> np.ndarray:
        return (np.log((have[0] + 0.5) / (n[0] + 1)) - np.log((have[1] + 0.5) / (n[1] + 1))) * np.sqrt(have[0])

    by_word = peculiar([np.bincount(pairs[1][toxic == kind], minlength=len(size)) for kind in (True, False)])
    counts = []
    for kind in (True, False):
        own = pairs[:, toxic == kind]
        # Each trigram of each type of each text, once a text.
        many = size[own[1]]
        grams = types.grams[np.repeat(types.gram_start[own[1]] - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(many.sum())]
        once = np.unique(np.repeat(own[0], many) * GRAM_BUCKETS + grams)
        counts.append(np.bincount(once % GRAM_BUCKETS, minlength=GRAM_BUCKETS))
    by_gram = np.full(len(size), -np.inf)
    np.maximum.at(by_gram, owner, peculiar(counts)[types.grams])
    score = np.r_[np.maximum(by_word, by_gram), -np.inf][windows].max(1)
    worst = np.full(len(labels), -np.inf)
    np.maximum.at(worst, doc, score)
    return (score >= worst[doc] - 1e-9).astype(np.float32)


def _window_logits(net: Network, types: Types, windows: np.ndarray, doc: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """The logit of each window, and the largest of each text."""
    score, worst = np.full(len(windows), -np.inf), np.full(n_docs, -np.inf)
    projected = net.projected(net.vectors(types))
    for at in range(0, len(windows), WINDOWS_AT_ONCE):
        score[at : at + WINDOWS_AT_ONCE] = net.run(net.inputs(projected, windows[at : at + WINDOWS_AT_ONCE]))[0]
    np.maximum.at(worst, doc, score)
    return score, worst


def _scale(logit: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Slope and shift that put the place between the kinds at a score between THRESHOLD and 0.5.

    The place has the least error, a miss of either kind weighing alike, and lies mid-way where several do.
    """
    cuts = np.sort(logit)
    cuts = np.r_[cuts[0] - 1, (cuts[1:] + cuts[:-1]) / 2, cuts[-1] + 1]
    error = [(logit[label == 1] < c).mean() + (logit[label == 0] >= c).mean() for c in cuts]
    best = np.flatnonzero(np.array(error) <= min(error) + 1e-9)
    low, high = np.sort(logit)[max(0, best[0] - 1)], np.sort(logit)[min(len(logit) - 1, best[-1])]
    return np.array([1.0, -0.4 - (low + high) / 2], np.float32)


def held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 4 == 2


def training_rows(docs: DataFrame, labels: DataFrame) -> tuple[list[str], list[int]]:
    """The bounded sample: of each kind the rows with the least hash of doc_id, never one that is held out."""
    learn = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2
    marked = labels.where(learn & F.col("toxic").isin(0, 1)).select("doc_id", "toxic").distinct()
    chosen = marked.withColumn("_by", F.xxhash64("doc_id"))
    some = [chosen.where(F.col("toxic") == kind).orderBy("_by", "doc_id").limit(most) for kind, most in ((1, MAX_TOXIC), (0, MAX_CLEAN))]
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text")).where(F.length("text") <= MAX_CHARS).join(F.broadcast(some[0].unionByName(some[1])), "doc_id")
    rows = rows.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).collect()
    rows.sort(key=lambda r: (r["doc_id"], r["toxic"]))
    return [r["text"] for r in rows], [r["toxic"] for r in rows]


def fit(docs: DataFrame, labels: DataFrame) -> Network | None:
    return train(*training_rows(docs, labels))


def _scored(shared) -> callable:
    def scores(batch: pa.RecordBatch) -> np.ndarray:
        out = np.zeros(batch.num_rows)
        if shared.value is not None:
            net = Network(shared.value)
            for first, texts in grouped(texts_of(batch)):
                out[first : first + len(texts)] = net.scores(words_of(texts))
        return out

    return scores


def score(docs: DataFrame, net: Network | None) -> DataFrame:
    """doc_id, held_out, score, predicted for each row. The network's size is fixed, so it is broadcast."""
    schema = docs.select("doc_id").schema.add("held_out", "boolean").add("score", "double").add("predicted", "integer")
    scores = _scored(docs.sparkSession.sparkContext.broadcast(net and net.p))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids, found = batch.column("doc_id"), scores(batch)
            yield pa.record_batch([ids, pa.array([held_out(i) for i in ids.to_pylist()], pa.bool_()), pa.array(found), pa.array((found >= THRESHOLD).astype(np.int32))], names=schema.names)

    return mapped(docs.select("doc_id", "text"), run, schema)


def keep_clean(docs: DataFrame, net: Network | None, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, with a score below ``threshold``."""
    scores = _scored(docs.sparkSession.sparkContext.broadcast(net and net.p))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield batch.filter(pa.array(scores(batch) < threshold))

    return mapped(docs, run, docs.schema)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))


QUERIES = {"op6_toxicity": op6_toxicity}
ORACLE: dict[str, str] = {}
