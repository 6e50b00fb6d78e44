"""Operator 3, toxicity by a bidirectional gated recurrent network with attention pooling.

A text is lower-cased and read as words; a word enters as its own embedding (words seen
often enough in training) beside the mean embedding of its character n-grams, so unseen words
are judged by their letters. Windows of ``WINDOW`` words, ``STRIDE`` apart and the last one flush with the
end, cover the whole text. In each window two gated recurrent layers read both ways,
attention pools their states and gives a logit. The text's score is a logistic
function of the largest and the mean logit of all its windows.

Training is in numpy on the driver, on a sample bounded by ``SAMPLE`` labelled texts of each label
of at most ``LONGEST`` characters, the lowest by a hash of doc_id. A label says nothing of
single windows, so each epoch scores all windows of the sample and learns from the highest
of each text. Labels, languages, sources and ids are never inputs. Scoring is one pass over the
texts in Arrow batches with the model in the closure; what a worker keeps of words is bounded.

Null and empty texts are one empty window. Labels that are null do not count; a doc_id with several
labels counts as toxic if one says so. Without any labelled text of both kinds every score is the share of label 1, or
0. Rows are independent: ties, repeated rows and extra columns change nothing.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from runledger.llm.common import chunks, give_back, worker_cache

#: Words of a window and from one to the next.
WINDOW, STRIDE = 64, 48
#: Labelled texts of each label that training may use, and their greatest length in characters.
SAMPLE, LONGEST = 2000, 20_000
#: Sizes: word and n-gram embeddings, n-gram buckets, hidden units of a direction, attention units.
WIDTH, BUCKETS, HIDDEN, ATTENTION = 12, 1 << 14, 12, 8
#: Words a worker remembers, windows scored at once.
KEPT_WORDS, AT_ONCE = 200_000, 1024
GRAMS = (3, 4, 5, 6)
#: Stands where a window has no word; never a word itself, and masked.
PADDING = "#"
_WORD = re.compile(r"\w{1,32}")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def gram_means(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the byte n-grams of all words, marked at both ends: bucket, word and weight of each."""
    data = [b"^" + w.encode() + b"$" for w in words]
    raw = np.frombuffer(b"".join(data), np.uint8).astype(np.uint64)
    owner = np.repeat(np.arange(len(data)), [len(d) for d in data])
    value, found, whose = np.zeros(len(raw), np.uint64), [], []
    for n in range(1, GRAMS[-1] + 1):
        value = value[:len(raw) - n + 1] * np.uint64(257) + raw[n - 1:] + np.uint64(1)
        if n in GRAMS:
            inside = owner[:len(value)] == owner[n - 1:]
            mixed = (value[inside] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
            found.append((mixed >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64))
            whose.append(owner[:len(value)][inside])
    bucket, of = np.concatenate(found), np.concatenate(whose)
    order = np.argsort(of, kind="stable")
    bucket, of = bucket[order], of[order]
    return bucket, of, (1 / np.maximum(1, np.bincount(of, minlength=len(words))))[of].astype(np.float32)


def windows_of(n: int) -> list[int]:
    """Where the windows of a text of n words begin."""
    if n <= WINDOW:
        return [0]
    return [*range(0, n - WINDOW, STRIDE), n - WINDOW]


@dataclass
class Model:
    vocabulary: dict[str, int]
    weights: dict[str, np.ndarray]
    blend: tuple[float, float, float]

    def inputs(self, words: list[str]) -> np.ndarray:
        """The embedding of each word: its own (zero if unknown) and the mean of its n-grams."""
        out = np.zeros((len(words), 2 * WIDTH), np.float32)
        out[:, :WIDTH] = self.weights["word"][[self.vocabulary.get(w, 0) for w in words]]
        for at in range(0, len(words), 8192):
            some = words[at:at + 8192]
            bucket, of, part = gram_means(some)
            starts = np.searchsorted(of, np.arange(len(some)))
            out[at:at + 8192, WIDTH:] = np.add.reduceat(self.weights["gram"][bucket] * part[:, None], starts, 0)
        return out

    def gates(self, words: list[str]) -> np.ndarray:
        """What a word adds to the gates of both directions, computed once for each word."""
        w = self.weights
        out = self.inputs(words) @ np.concatenate([w["in_f"], w["in_b"]], 1)
        out += np.concatenate([w["bias_f"], w["bias_b"]])
        return out


def _recur(gates: np.ndarray, mask: np.ndarray, state: np.ndarray, keep: list | None) -> list[np.ndarray]:
    """States of one direction; gates (time, rows, 3 * hidden), mask (time, rows)."""
    h, out, n = np.zeros((gates.shape[1], HIDDEN), np.float32), [], HIDDEN
    for x, m in zip(gates, mask):
        u = h @ state
        rz = np.tanh((x[:, :2 * n] + u[:, :2 * n]) * np.float32(0.5)) * np.float32(0.5) + np.float32(0.5)
        r, z = rz[:, :n], rz[:, n:]
        c = np.tanh(x[:, 2 * n:] + r * u[:, 2 * n:])
        new = (c + z * (h - c)) * m[:, None]
        if keep is not None:
            keep.append((h, r, z, c, u[:, 2 * n:]))
        h = new
        out.append(h)
    return out


def forward(weights: dict, gates: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
    """The logit of each window; gates (time, rows, 6 * hidden)."""
    n = 3 * HIDDEN
    kept_f, kept_b = ([], []) if keep is not None else (None, None)
    ahead = _recur(gates[:, :, :n], mask, weights["state_f"], kept_f)
    back = _recur(gates[::-1, :, n:], mask[::-1], weights["state_b"], kept_b)[::-1]
    states = np.concatenate([np.stack(ahead), np.stack(back)], 2)
    hidden = np.tanh(states @ weights["attend"] + weights["attend_bias"])
    energy = hidden @ weights["attend_out"] - (1 - mask) * np.float32(1e9)
    share = np.exp(energy - energy.max(0)) * mask
    share /= np.maximum(share.sum(0), np.float32(1e-9))
    pooled = (states * share[:, :, None]).sum(0)
    if keep is not None:
        keep.update(f=kept_f, b=kept_b, states=states, hidden=hidden, share=share, pooled=pooled)
    return pooled @ weights["out"] + weights["out_bias"][0]


def _recur_back(kept: list, state: np.ndarray, mask: np.ndarray, grads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the gates and of the recurrent weights of one direction."""
    n, out, d_state = HIDDEN, np.empty((*grads.shape[:2], 3 * HIDDEN), np.float32), np.zeros_like(state)
    later = np.zeros_like(grads[0])
    for t in range(len(kept) - 1, -1, -1):
        h, r, z, c, un = kept[t]
        d = (grads[t] + later) * mask[t][:, None]
        dc = d * (1 - z) * (1 - c * c)
        dz = d * (h - c) * z * (1 - z)
        dr = dc * un * r * (1 - r)
        du = np.concatenate([dr, dz, dc * r], 1)
        out[t] = np.concatenate([dr, dz, dc], 1)
        d_state += h.T @ du
        later = d * z + du @ state.T
    return out, d_state


def backward(weights: dict, keep: dict, mask: np.ndarray, d_logit: np.ndarray) -> tuple[dict, np.ndarray]:
    """Gradients of the dense weights, and of the gates."""
    share, states, hidden = keep["share"], keep["states"], keep["hidden"]
    g = {"out": keep["pooled"].T @ d_logit, "out_bias": d_logit.sum(keepdims=True)}
    d_pooled = d_logit[:, None] * weights["out"]
    d_share = (states * d_pooled).sum(2)
    d_energy = share * (d_share - (share * d_share).sum(0))
    d_hidden = d_energy[:, :, None] * weights["attend_out"] * (1 - hidden * hidden)
    g["attend_out"] = (hidden * d_energy[:, :, None]).sum((0, 1))
    g["attend"] = np.tensordot(states, d_hidden, ([0, 1], [0, 1]))
    g["attend_bias"] = d_hidden.sum((0, 1))
    d_states = share[:, :, None] * d_pooled + d_hidden @ weights["attend"].T
    ahead, g["state_f"] = _recur_back(keep["f"], weights["state_f"], mask, d_states[:, :, :HIDDEN])
    back, g["state_b"] = _recur_back(keep["b"], weights["state_b"], mask[::-1], d_states[::-1, :, HIDDEN:])
    return g, np.concatenate([ahead, back[::-1]], 2)


def _windows(texts: list[np.ndarray], empty: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word numbers (rows, WINDOW) padded with ``empty``, lengths, and the text of each window."""
    rows = [(i, t[a:a + WINDOW]) for i, t in enumerate(texts) for a in windows_of(len(t))]
    out, lengths = np.full((len(rows), WINDOW), empty, np.int32), np.empty(len(rows), np.int64)
    for k, (_, part) in enumerate(rows):
        out[k, :len(part)], lengths[k] = part, len(part)
    return out, lengths, np.array([i for i, _ in rows], np.int64)


def logits(weights: dict, gates: np.ndarray, windows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Logits of all windows, those of like length together."""
    out, order = np.empty(len(windows), np.float32), np.argsort(lengths, kind="stable")
    for at in range(0, len(order), AT_ONCE):
        some = order[at:at + AT_ONCE]
        longest = max(1, int(lengths[some[-1]]))
        mask = (np.arange(longest)[:, None] < lengths[some]).astype(np.float32)
        out[some] = forward(weights, gates[windows[some, :longest].T], mask)
    return out


def _features(z: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """Largest and mean logit of each text."""
    top = np.full(n, -np.inf, np.float64)
    np.maximum.at(top, of, z)
    return np.stack([top, np.bincount(of, z, n) / np.bincount(of, minlength=n)], 1)


def _blend(features: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Logistic regression by Newton steps with a small ridge."""
    x, w = np.concatenate([features, np.ones((len(y), 1))], 1), np.array([1.0, 0.0, 0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        ridge = 0.05 * np.eye(3)
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (p - y) + 0.05 * (w - [1, 0, 0]))
    return tuple(w.tolist())


def train(texts: list[str], labels: list[int], epochs: int = 8, seed: int = 0, least_seen: int = 3) -> Model:
    rng = np.random.default_rng(seed)
    y, number, coded = np.array(labels, np.float32), {PADDING: 0}, []
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.0
        return Model({}, {}, (0.0, 0.0, 30.0 if share == 1 else -30.0))
    for text in texts:
        coded.append(np.array([number.setdefault(w, len(number)) for w in words_of(text)], np.int32))
    everything = list(number)
    seen = np.bincount(np.concatenate([np.unique(c) for c in coded]), minlength=len(number))
    vocabulary = {w: i + 1 for i, w in enumerate(w for w, n in zip(everything, seen) if n >= least_seen)}
    known = np.array([vocabulary.get(w, 0) for w in everything])
    draw = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
    w = {"word": draw(len(vocabulary) + 1, WIDTH, scale=0.1), "gram": draw(BUCKETS, WIDTH, scale=0.3),
         "in_f": draw(2 * WIDTH, 3 * HIDDEN, scale=0.2), "in_b": draw(2 * WIDTH, 3 * HIDDEN, scale=0.2),
         "state_f": draw(HIDDEN, 3 * HIDDEN, scale=0.2), "state_b": draw(HIDDEN, 3 * HIDDEN, scale=0.2),
         "bias_f": np.zeros(3 * HIDDEN, np.float32), "bias_b": np.zeros(3 * HIDDEN, np.float32),
         "attend": draw(2 * HIDDEN, ATTENTION, scale=0.3), "attend_bias": np.zeros(ATTENTION, np.float32), "attend_out": draw(ATTENTION, scale=0.3),
         "out": draw(2 * HIDDEN, scale=0.3), "out_bias": np.zeros(1, np.float32)}
    w["word"][0] = 0
    model = Model(vocabulary, w, (1.0, 0.0, 0.0))
    windows, lengths, owner = _windows(coded, 0)
    first = np.searchsorted(owner, np.arange(len(y)))
    count = np.bincount(owner, minlength=len(y))
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())).astype(np.float32)
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in w.items()}
    step, size = 0, 192
    epochs = max(epochs, min(30, -(-150 * size // max(1, len(y)))))
    for epoch in range(epochs):
        if epoch < 2:
            chosen = first + (rng.random(len(y)) * count).astype(np.int64)
        else:
            z = logits(w, model.gates(everything), windows, lengths)
            order = np.lexsort((z, owner))
            chosen = order[np.append(first[1:], len(owner)) - 1]
        rate = 0.01 * (1 - epoch / epochs) + 0.0005
        for some in np.array_split(rng.permutation(len(y)), max(1, len(y) // size)):
            rows = chosen[some]
            longest = max(1, int(lengths[rows].max()))
            mask = (np.arange(longest)[:, None] < lengths[rows]).astype(np.float32)
            unique, place = np.unique(windows[rows, :longest].T, return_inverse=True)
            bucket, of, part = gram_means([everything[i] for i in unique])
            x = np.empty((len(unique), 2 * WIDTH), np.float32)
            x[:, :WIDTH] = w["word"][known[unique]]
            x[:, WIDTH:] = np.add.reduceat(w["gram"][bucket] * part[:, None], np.searchsorted(of, np.arange(len(unique))), 0)
            drop = (rng.random((len(unique), 1)) > 0.15).astype(np.float32)  # some words are judged by their letters alone
            x[:, :WIDTH] *= drop
            both = np.concatenate([w["in_f"], w["in_b"]], 1)
            gates = (x @ both + np.concatenate([w["bias_f"], w["bias_b"]]))[place.reshape(longest, -1)]
            keep: dict = {}
            z = forward(w, gates, mask, keep)
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            g, d_gates = backward(w, keep, mask, ((p - y[some]) * weight[some] / len(some)).astype(np.float32))
            flat = d_gates.reshape(-1, 6 * HIDDEN)
            order = np.argsort(place.ravel(), kind="stable")
            d_x_gates = np.add.reduceat(flat[order], np.searchsorted(place.ravel()[order], np.arange(len(unique))), 0)
            d_both, d_x = x.T @ d_x_gates, d_x_gates @ both.T
            g["in_f"], g["in_b"] = d_both[:, :3 * HIDDEN], d_both[:, 3 * HIDDEN:]
            g["bias_f"], g["bias_b"] = flat[:, :3 * HIDDEN].sum(0), flat[:, 3 * HIDDEN:].sum(0)
            g["word"], g["gram"] = np.zeros_like(w["word"]), np.zeros_like(w["gram"])
            np.add.at(g["word"], known[unique], d_x[:, :WIDTH] * drop)
            g["word"][0] = 0
            np.add.at(g["gram"], bucket, d_x[of, WIDTH:] * part[:, None])
            step += 1
            for k, grad in g.items():
                a, b = moment[k]
                a += 0.1 * (grad - a)
                b += 0.001 * (grad * grad - b)
                w[k] -= (rate * (a / (1 - 0.9 ** step)) / (np.sqrt(b / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)
    z = logits(w, model.gates(everything), windows, lengths)
    model.blend = _blend(_features(z, owner, len(y)), y.astype(np.float64))
    return model


class Scorer:
    """A model with the words a worker has met."""

    def __init__(self, model: Model):
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.number = {PADDING: 0}
        self.table = self.model.gates([PADDING]) if self.model.weights else None

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        a, b, c = self.model.blend
        if not self.model.weights:
            return np.full(len(texts), 1 / (1 + np.exp(-c)))
        split = [words_of(t) for t in texts]
        if len(self.number) > KEPT_WORDS:
            self.clear()
        new = [w for w in set().union(*split) if w not in self.number]
        if new:
            self.number.update(zip(new, range(len(self.number), len(self.number) + len(new))))
            self.table = np.concatenate([self.table, self.model.gates(new)])
        of_word = self.number.__getitem__
        windows, lengths, of = _windows([np.fromiter(map(of_word, t), np.int64, len(t)) for t in split], 0)
        features = _features(logits(self.model.weights, self.table, windows, lengths), of, len(texts))
        return 1 / (1 + np.exp(-np.clip(features @ [a, b] + c, -30, 30)))


def held_out(id: Column) -> Column:
    """Rows whose labels are never learned; a null id is not held out."""
    return F.coalesce(F.crc32(id.cast("string")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """``id``, ``text`` and ``label`` of the bounded sample: at most ``SAMPLE`` rows of each label."""
    known = labels.select(F.col(id).alias("id"), F.col(label).alias("label")).where(
        F.col("id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("id"))).groupBy("id").agg(F.max("label").alias("label"))
    order = F.xxhash64("id", F.lit(1))
    # Twice the sample, as some texts are too long; its size is fixed, so it is safe to broadcast.
    some = known.where("label = 1").orderBy(order, "id").limit(2 * SAMPLE).unionByName(
        known.where("label = 0").orderBy(order, "id").limit(2 * SAMPLE))
    texts = docs.select(F.col(id).alias("id"), F.col(text).alias("text")).where(F.length("text") <= LONGEST)
    rows = texts.join(F.broadcast(some), "id").groupBy("id").agg(F.min("text").alias("text"), F.max("label").alias("label"))
    nth = F.row_number().over(W.partitionBy("label").orderBy(order, "id"))
    return rows.withColumn("nth", nth).where(F.col("nth") <= SAMPLE).drop("nth")


def fit(docs: DataFrame, labels: DataFrame, **columns: str) -> Model:
    rows = sorted(training_rows(docs, labels, **columns).select("id", "text", "label").collect(), key=lambda r: r["id"])
    model = train([r["text"] for r in rows], [r["label"] for r in rows])
    # What training held would stay with the driver's Python beside all that comes after.
    del rows
    give_back()
    return model


def score(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",), name: str = "score") -> DataFrame:
    """The columns ``keep`` and ``name``, the score (0 to 1), of every whole text."""
    slim = docs.select(*(F.col(k) for k in keep), F.col(text).alias("__text"))
    wanted = [*keep, name]

    def run(batches):
        # One model at a time stays with a worker, by the numbers it was fitted to.
        home = worker_cache("toxicity", dict)
        if home.get("blend") != model.blend:
            home.update(blend=model.blend, scorer=Scorer(model))
        for batch in chunks(batches, "__text", 1 << 20):
            found = home["scorer"](batch.column(len(keep)).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.float64())], wanted)
        give_back()

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields[:-1])
    return slim.mapInArrow(run, f"{kinds}, `{name}` double")
