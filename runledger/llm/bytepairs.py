"""Byte-level BPE vocabularies: loading, splitting texts into pre-tokens, exact merging.

The file of a vocabulary is only read; its path is an argument everywhere.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import regex

from runledger.llm.common import worker_cache

# Fixed value: the split pattern of byte-level BPE.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NEVER = np.int64(1 << 40)
LONG_TEXT = 1 << 20


def byte_characters() -> dict[str, int]:
    """The printable stand-in of each byte: itself where printable, else the next free code point above 255."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in sorted(plain)} | {chr(256 + i): b for i, b in enumerate(rest)}


def narrow_split() -> str:
    """SPLIT for texts below U+0100, its classes spelled out: the same words, found faster."""
    of = {kind: "".join(re.escape(chr(c)) for c in range(256) if regex.match(kind, chr(c))) for kind in (r"\p{L}", r"\p{N}", r"\s")}
    letter, digit, space = (of[k] for k in (r"\p{L}", r"\p{N}", r"\s"))
    return (f" ?[{letter}]+|'(?:[stmd]|re|ve|ll)| ?[{digit}]+| ?[^{space}{letter}{digit}]+|"
            f"[{space}]+(?![^{space}])|[{space}]+")


def is_narrow(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class Vocabulary:
    """Tokens as bytes, merges as arrays over token ids, and vectorised lookups.

    ``rank[t]`` is the place of the merge that makes token t, -1 for single bytes;
    ``left`` and ``right`` are the two parts it is made of.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        ids, stand_in = spec["model"]["vocab"], byte_characters()
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*ids.values(), *added.values()]) + 1
        self.token = [b""] * size
        for text, i in ids.items():
            self.token[i] = bytes(stand_in[c] for c in text)
        for text, i in added.items():
            self.token[i] = text.encode()
        self.size, self.added = size, added
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.of_byte = np.full(256, -1, np.int64)
        for text, b in stand_in.items():
            self.of_byte[b] = ids[text]
        self.rank = np.full(size, -1, np.int64)
        self.left, self.right = np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        first, second, made = (np.array([ids[x] for x in part], np.int64) for part in
                               zip(*((a, b, a + b) for a, b in merges)))
        self.rank[made], self.left[made], self.right[made] = np.arange(len(merges)), first, second
        keys = first * size + second
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = np.append(keys[order], NEVER), np.append(order, NEVER), np.append(made[order], -1)
        # Byte pairs inside some merged token; no merge ever crosses any other pair.
        self.inside = np.zeros((256, 256), bool)
        for t in np.flatnonzero(self.rank >= 0).tolist():
            held = np.frombuffer(self.token[t], np.uint8)
            self.inside[held[:-1], held[1:]] = True
        self.split, self.narrow = regex.compile(SPLIT), re.compile(narrow_split())

    def lookup(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and product of merging each adjacent pair; NEVER where no merge joins them."""
        key = left * self.size + right
        at = np.searchsorted(self.keys, key)
        known = self.keys[at] == key
        return np.where(known, self.ranks[at], NEVER), self.made[at]

    def words(self, text: str) -> Iterator[list[str]]:
        """Pre-tokens of a text in lists of bounded length; added tokens come out whole."""
        if not text:
            return
        parts = self.special.split(text) if self.special else [text]
        for k, part in enumerate(parts):
            if k % 2:
                yield [part]
                continue
            split = self.narrow if is_narrow(part) else self.split
            if len(part) <= LONG_TEXT:
                yield split.findall(part)
            else:
                found = split.finditer(part)
                while some := [m.group() for m in islice(found, LONG_TEXT // 8)]:
                    yield some


def vocabulary(path: str) -> Vocabulary:
    """The vocabulary at ``path``, loaded once by each worker."""
    known = worker_cache("vocabularies", dict)
    if path not in known:
        known[path] = Vocabulary(path)
    return known[path]
