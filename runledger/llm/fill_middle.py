"""Operator 13, the fill-in-middle transformation over a set of boundaries.

A text is cut into units: white space with the word after it, or white space at the end.
Its boundaries are offset 0 and the end of each unit, counted in code points, so that the
k-th boundary is where the first k units end. They are kept in a ``Boundaries`` set of
containers, one for each 65,536 offsets: a sorted array, a bitmap or runs, whichever is
smallest, with the cardinalities up to each container. A cut after k units searches the
container by these sums and selects inside it.

The hash of doc_id decides both cuts, whether the text is transformed at all and in which
order the parts stand: ``psm`` puts prefix, suffix, middle, ``spm`` suffix, prefix, middle, each
part behind its mark. Texts that are empty or hold a mark already stay as they are, so a
mark in an output is always a mark. ``restored`` rebuilds the text from output and form.

Null texts count as empty. A null doc_id hashes as the empty text. Repeated rows give
repeated results, empty tables no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runledger.llm.common import chunks, drop_worker_caches, give_back

MARKS = PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, FORM_PERCENT, SPM_PERCENT = 42, 50, 80
#: Values of an array container take two bytes, a bitmap has 8,192, a run takes four.
SPAN, BITMAP_BYTES = 1 << 16, 8192

_BLANK = np.array([32, *range(9, 14)], np.uint32)
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")


class Boundaries:
    """A sorted set of offsets in containers of 65,536, with ``select`` by position."""

    def __init__(self, offsets: np.ndarray):
        high = offsets >> 16
        first = np.flatnonzero(np.append(True, high[1:] != high[:-1]))
        self.bases = offsets[first] & ~(SPAN - 1)
        #: Members before each container, and all of them.
        self.before = np.append(first, len(offsets))
        self.containers = [self._container(part) for part in np.split(offsets & (SPAN - 1), first[1:])]

    @staticmethod
    def _container(low: np.ndarray) -> tuple:
        starts = np.flatnonzero(np.append(True, np.diff(low) != 1))
        if 4 * len(starts) < min(2 * len(low), BITMAP_BYTES):
            return "runs", low[starts].astype(np.uint16), starts
        if 2 * len(low) <= BITMAP_BYTES:
            return "array", low.astype(np.uint16)
        bits = np.zeros(SPAN, np.uint8)
        bits[low] = 1
        packed = np.packbits(bits, bitorder="little")
        words = np.cumsum(np.bitwise_count(packed.view(np.uint64)), dtype=np.int64)
        return "bitmap", packed, words

    def __len__(self) -> int:
        return int(self.before[-1])

    def select(self, k: int) -> int:
        """The k-th offset of the set, from 0."""
        at = int(np.searchsorted(self.before, k, side="right")) - 1
        rest = k - int(self.before[at])
        kind, data, *more = self.containers[at]
        if kind == "array":
            low = int(data[rest])
        elif kind == "runs":
            run = int(np.searchsorted(more[0], rest, side="right")) - 1
            low = int(data[run]) + rest - int(more[0][run])
        else:
            word = int(np.searchsorted(more[0], rest, side="right"))
            rest -= int(more[0][word - 1]) if word else 0
            low = word * 64 + int(np.flatnonzero(_BYTE_BITS[data[word * 8:word * 8 + 8]].ravel())[rest])
        return int(self.bases[at]) + low


def boundaries(text: str) -> Boundaries:
    """Offset 0 and the end of each unit of a text."""
    blank = np.isin(np.frombuffer(text.encode("utf-32-le"), np.uint32), _BLANK)
    ends = np.flatnonzero(~blank & np.append(blank[1:], True)) + 1 if len(blank) else np.zeros(0, np.int64)
    tail = [len(blank)] if len(blank) and blank[-1] else []
    return Boundaries(np.concatenate([[0], ends, tail]).astype(np.int64))


def draws(id: Column, seed: int = SEED) -> list[Column]:
    """Four unsigned 32-bit numbers from the hash of an id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def transform(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``n`` (units), ``form``, ``prefix_chars``, ``middle_chars`` and ``output`` of each row."""
    def one(t: str, h1: int, h2: int, h3: int, h4: int) -> tuple:
        cut = boundaries(t)
        n = len(cut) - 1
        if not t or any(m in t for m in MARKS) or h3 % 100 >= FORM_PERCENT:
            return n, "plain", None, None, t
        a, b = (cut.select(k) for k in sorted((h1 % (n + 1), h2 % (n + 1))))
        prefix, middle, suffix = PREFIX + t[:a], MIDDLE + t[a:b], SUFFIX + t[b:]
        spm = h4 % 100 < SPM_PERCENT
        return n, "spm" if spm else "psm", a, b - a, (suffix + prefix if spm else prefix + suffix) + middle

    def run(batches):
        drop_worker_caches()
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        for batch in chunks(batches, "text", 1 << 20):
            rows = zip(batch.column("text").to_pylist(), *(batch.column(f"h{i}").to_pylist() for i in range(1, 5)))
            done = zip(*(one(t or "", *h) for t, *h in rows))
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(c, k) for c, k in zip(done, kinds))],
                                             ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])
        give_back()

    kind = docs.schema[id].dataType.simpleString()
    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text"), *(h.alias(f"h{i}") for i, h in enumerate(draws(F.col(id)), 1)))
    return rows.mapInArrow(run, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that a row of ``transform`` was made of."""
    def after(mark):
        return F.locate(mark, output) + F.lit(len(mark))

    def until(start, mark):
        return F.substring(output, start, F.locate(mark, output) - start)

    rest = F.substring(output, after(MIDDLE), F.length(output))
    psm = F.concat(until(F.lit(1 + len(PREFIX)), SUFFIX), rest, until(after(SUFFIX), MIDDLE))
    spm = F.concat(until(after(PREFIX), MIDDLE), rest, until(F.lit(1 + len(SUFFIX)), PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
