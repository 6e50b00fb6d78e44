"""Operator 8, token counts by rank-synchronous merging of ragged numpy arrays.

The pre-tokens that a batch of texts brings for the first time are laid end to end
in one array. A pre-token is first cut into sequences wherever two bytes meet that no
token holds side by side: no merge crosses such a border, so the pieces of a very long word merge
like words of their own. In each round every sequence finds its own lowest-rank pair and all
sequences merge theirs at the same time; sequences without a pair retire with the
number of symbols left. Counts of pre-tokens are kept by the worker up to a bound.

Null and empty texts have 0 bytes and 0 tokens; a null limit is never exceeded.
Rows are independent: ties, repeated rows and extra columns change nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runledger.llm.bytepairs import NEVER, Vocabulary, vocabulary
from runledger.llm.common import chunks, sizes, worker_cache

#: Pre-tokens a worker remembers, and symbols merged in one go.
KEPT_WORDS, SYMBOLS = 1_000_000, 1 << 20


def merge(vocab: Vocabulary, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Exact merging of many words at once: the tokens laid end to end, and the word of each.

    Words are cut where no merge can cross. In each round every piece finds its own lowest-rank
    pair and all pieces merge theirs at the same time; pieces without a pair retire.
    """
    data = np.frombuffer(b"".join(words), np.uint8)
    word = np.repeat(np.arange(len(words)), [len(w) for w in words])
    begins = np.append(True, (word[1:] != word[:-1]) | ~vocab.inside[data[:-1], data[1:]])[:len(data)]
    symbols, owner, word = vocab.of_byte[data], np.cumsum(begins) - 1, word[begins]
    retired_symbols, retired_owner = [symbols[:0]], [owner[:0]]
    while len(symbols):
        inside = owner[1:] == owner[:-1]
        rank, made = vocab.lookup(symbols[:-1], symbols[1:])
        rank[~inside] = NEVER
        rank, made = np.append(rank, NEVER), np.append(made, -1)
        starts = np.flatnonzero(np.append(True, ~inside))
        lengths = np.diff(np.append(starts, len(symbols)))
        lowest = np.repeat(np.minimum.reduceat(rank, starts), lengths)
        over = lowest == NEVER
        retired_symbols.append(symbols[over])
        retired_owner.append(owner[over])
        hits = np.flatnonzero((rank == lowest) & ~over)
        # In a run of overlapping hits (aaaa) the first, third, ... are merged.
        fresh = np.append(True, np.diff(hits) != 1)[:len(hits)]
        place = np.arange(len(hits))
        hits = hits[(place - np.maximum.accumulate(np.where(fresh, place, 0))) % 2 == 0]
        symbols[hits] = made[hits]
        keep = ~over
        keep[hits + 1] = False
        symbols, owner = symbols[keep], owner[keep]
    symbols, owner = np.concatenate(retired_symbols), np.concatenate(retired_owner)
    order = np.argsort(owner, kind="stable")
    return symbols[order], word[owner[order]]


def merged_counts(vocab: Vocabulary, words: list[bytes]) -> np.ndarray:
    """Symbols left of each word after all merges."""
    return np.bincount(merge(vocab, words)[1], minlength=len(words))


def _learn(vocab: Vocabulary, counts: dict[str, int], new: set[str]) -> None:
    some, filled = [], 0
    for word in [*new, None]:
        if some and (word is None or filled + len(word) > SYMBOLS):
            counts.update(zip(some, merged_counts(vocab, [w.encode() for w in some]).tolist()))
            some, filled = [], 0
        if word is not None:
            some.append(word)
            filled += len(word)


def _counts_of(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[list[int]]:
    vocab = vocabulary(path)
    counts = worker_cache(f"counts:{path}", lambda: dict.fromkeys(vocab.added, 1))
    for batch in batches:
        split = [list(vocab.words(text or "")) for text in batch.column("_text").to_pylist()]
        if len(counts) > KEPT_WORDS:
            counts.clear()
            counts.update(dict.fromkeys(vocab.added, 1))
        _learn(vocab, counts, set().union(*(part for parts in split for part in parts)) - counts.keys())
        yield [sum(sum(map(counts.__getitem__, part)) for part in parts) for parts in split]


def count_tokens(docs: DataFrame, path: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id``, ``n_bytes`` and ``n_tokens`` of each row under the vocabulary file at ``path``."""
    slim = docs.select(F.col(id).alias("_id"), F.col(text).alias("_text"))

    def count(batches):
        for batch in chunks(batches, "_text"):
            for n in _counts_of([batch], path):
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_id"), sizes(batch.column("_text")), pa.array(n, pa.int64())], ["_id", "n_bytes", "n_tokens"])

    kind = slim.schema["_id"].dataType.simpleString()
    return slim.mapInArrow(count, f"_id {kind}, n_bytes long, n_tokens long").withColumnRenamed("_id", id)


def over_limit(tokens: Column, limit: int) -> Column:
    return tokens > F.lit(limit)
