"""Operator 7, BPE encoding and decoding: speculate, then verify.

For each pre-token that a batch brings for the first time a greedy longest match
proposes tokens. A proposal is the true encoding exactly if every adjacent pair is:
walking back the merges at the border of the two tokens, the latest first, no pair
of symbols may meet that would have been merged across the border before. This test
runs over all adjacent pairs of the batch at once. Only pre-tokens with a failing
pair are merged step by step.

Null and empty texts give no ids and an empty decoded text. Rows are independent:
ties, repeated rows and extra columns change nothing. An id that the vocabulary does
not have decodes to nothing.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runledger.llm.bytepairs import NEVER, Vocabulary, vocabulary
from runledger.llm.common import chunks, drop_worker_caches, give_back, worker_cache
from runledger.llm.token_counts import SYMBOLS, merge

#: Pre-tokens a worker remembers, about 300 bytes each, and bytes of text it encodes at once.
KEPT_WORDS, AT_ONCE = 1_000_000, 1 << 20


def separable(vocab: Vocabulary, left: np.ndarray, right: np.ndarray, joined: bool = False) -> np.ndarray:
    """Whether each pair of tokens stays apart when its bytes are merged.

    ``joined`` ignores the two whole tokens and judges only what happened before they met.
    """
    left, right = left.copy(), right.copy()
    apart, limit = np.ones(len(left), bool), np.full(len(left), NEVER)
    open_, first = np.arange(len(left)), joined
    while len(open_):
        a, b = left[open_], right[open_]
        rank, _ = vocab.lookup(a, b)
        if not first:
            apart[open_[rank < limit[open_]]] = False
        first = False
        ra, rb = vocab.rank[a], vocab.rank[b]
        undo = ra > rb
        left[open_] = np.where(undo, vocab.right[a], a)
        right[open_] = np.where(undo, b, vocab.left[b])
        # Of equal merges the left one comes first.
        limit[open_] = np.where(undo, ra, rb + 1)
        open_ = open_[apart[open_] & (np.maximum(ra, rb) >= 0)]
    return apart


class Encoder:
    """Encodings of pre-tokens, kept as one growing ragged array."""

    def __init__(self, vocab: Vocabulary, kept: int = KEPT_WORDS):
        self.vocab, self.kept = vocab, kept
        made = np.flatnonzero(vocab.rank >= 0)
        whole = np.ones(vocab.size, bool)
        whole[made] = separable(vocab, vocab.left[made], vocab.right[made], joined=True)
        for t in made[np.argsort(vocab.rank[made])].tolist():
            whole[t] &= whole[vocab.left[t]] and whole[vocab.right[t]]
        special = set(vocab.added.values())
        self.ids = {vocab.token[t]: t for t in np.flatnonzero(whole).tolist() if t not in special}
        # Longest token by its first four bytes; without an entry a match has three bytes at most.
        self.longest: dict[bytes, int] = {}
        for token in self.ids:
            self.longest[token[:4]] = max(self.longest.get(token[:4], 3), len(token))
        self.clear()

    def clear(self) -> None:
        self.index = {text: i for i, text in enumerate(self.vocab.added)}
        self.length = np.ones(len(self.index), np.int64)
        self.flat = np.array(list(self.vocab.added.values()), np.int32)
        self.failed = 0

    def propose(self, data: bytes) -> list[int]:
        """Greedy longest match."""
        known, longest = self.ids.get, self.longest.get
        if (whole := known(data)) is not None:
            return [whole]
        out, at, n = [], 0, len(data)
        while at < n:
            for end in range(min(n, at + longest(data[at:at + 4], 3)), at, -1):
                if (token := known(data[at:end])) is not None:
                    out.append(token)
                    at = end
                    break
        return out

    def learn(self, words: set[str]) -> None:
        some, filled = [], 0
        for word in [*(w for w in words if w not in self.index), None]:
            if some and (word is None or filled + len(word) > SYMBOLS):
                self._learn(some)
                some, filled = [], 0
            if word is not None:
                some.append(word)
                filled += len(word)

    def _learn(self, new: list[str]) -> None:
        data = [w.encode() for w in new]
        found = [self.propose(d) for d in data]
        owner = np.repeat(np.arange(len(new)), [len(f) for f in found])
        flat = np.fromiter((t for f in found for t in f), np.int64, len(owner))
        near = np.flatnonzero(owner[1:] == owner[:-1])
        wrong = np.unique(owner[near[~separable(self.vocab, flat[near], flat[near + 1])]])
        self.failed += len(wrong)
        if len(wrong):
            exact, of = merge(self.vocab, [data[i] for i in wrong.tolist()])
            for i, ids in zip(wrong.tolist(), np.split(exact, np.flatnonzero(np.diff(of)) + 1)):
                found[i] = ids.tolist()
        self.index.update(zip(new, range(len(self.index), len(self.index) + len(new))))
        self.length = np.concatenate([self.length, np.array([len(f) for f in found], np.int64)])
        self.flat = np.concatenate([self.flat, np.fromiter((t for f in found for t in f), np.int32)])

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        split = [list(self.vocab.words(text or "")) for text in texts]
        if len(self.index) > self.kept:
            self.clear()
        self.learn(set().union(*(part for parts in split for part in parts)))
        start, out = np.cumsum(self.length) - self.length, []
        for parts in split:
            at = np.fromiter(map(self.index.__getitem__, chain.from_iterable(parts)), np.int64)
            n = self.length[at]
            place = np.arange(n.sum()) + np.repeat(start[at] - (np.cumsum(n) - n), n)
            out.append(self.flat[place])
        return out


def decode(vocab: Vocabulary, ids: list[int]) -> str:
    token, size = vocab.token, vocab.size
    return b"".join([token[t] if 0 <= t < size else b"" for t in ids]).decode("utf-8", "replace")


def encoder(path: str) -> Encoder:
    return worker_cache(f"encoder:{path}", lambda: Encoder(vocabulary(path)))


def encode(docs: DataFrame, path: str, id: str = "doc_id", text: str = "text", kept: int = KEPT_WORDS) -> DataFrame:
    """``id`` and ``ids``, the token ids of each whole text, under the vocabulary file at ``path``.

    A worker forgets its pre-tokens beyond ``kept``: fewer take less memory and more time, the ids are the same.
    """
    slim = docs.select(F.col(id).alias("_id"), F.col(text).alias("_text"))

    def run(batches):
        drop_worker_caches("vocabularies", f"encoder:{path}")
        coder = encoder(path)
        coder.kept = kept
        for batch in chunks(batches, "_text", AT_ONCE):
            found = coder.encode(batch.column("_text").to_pylist())
            ends = np.cumsum([0, *map(len, found)])
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(found), pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("_id"), ids], ["_id", "ids"])
        give_back()

    kind = slim.schema["_id"].dataType.simpleString()
    return slim.mapInArrow(run, f"_id {kind}, ids array<int>").withColumnRenamed("_id", id)


def decode_ids(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` with a column ``decoded``, read back from the column ``ids`` alone; a null list is an empty text."""
    names = encoded.columns

    def run(batches):
        vocab = vocabulary(path)
        for batch in chunks(batches, "ids"):
            texts = [decode(vocab, ids or []) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*names, "decoded"])

    return encoded.mapInArrow(run, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in encoded.schema)}, decoded string")
