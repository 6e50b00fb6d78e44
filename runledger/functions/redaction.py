"""Removal of credentials from text columns, arrays and structs.

Rules run in a fixed order because later rules see what earlier ones left.
Known secret values come as an argument; nothing is read from an environment.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runledger import fixed_values as V
from runledger.functions.text import BOUNDARY, SPACE, WORD, first_line, let

_START = rf"(?<![{WORD}])"  # a boundary before a word character


def shape(name: str, start: str, end: str, space: str, word: str) -> str:
    """A credential shape with the classes and boundaries of one text engine."""
    pattern = V.CREDENTIAL_SHAPES[name]
    for mark, value in (("<start>", start), ("<end>", end), ("<space>", space), ("<word>", word)):
        pattern = pattern.replace(mark, value)
    return pattern


def _shape(name: str, start: str = _START) -> str:
    return shape(name, start, BOUNDARY, SPACE, WORD)


_JWT, _BEARER, _URL_LOGIN = _shape("signed token"), "(?iU)" + _shape("bearer"), "(?U)" + _shape("login in a URL")
_VENDOR_KEY, _PEM = _shape("vendor key"), "(?s)" + _shape("private key")
_STORED_LABEL = "(?iU)" + _shape("stored label", BOUNDARY) + _shape("value")
_EVIDENCE_LABEL = "(?iU)" + _shape("evidence label") + _shape("value")


def _holds_any(*words: str):
    return lambda text: text.contains(words[0]) if len(words) == 1 else (
        text.contains(words[0]) | _holds_any(*words[1:])(text))


def _holds_label(text: Column) -> Column:
    # Letters that match a label letter without regard to case, but not in lower case.
    odd = text.rlike("[\u017f\u212a\u0130\u0131]")
    named = let(F.lower(text), _holds_any("passw", "secret", "token", "api", "authorization", "credential"))
    return _holds_any("=", ":")(text) & (odd | named)  # one of these ends every label


# (cheap test that the rule can apply at all, pattern, replacement)
_COMMON = ((_holds_any("eyJ"), _JWT, V.MASK),
           (lambda text: F.lower(text).contains("bearer"), _BEARER, f"Bearer {V.MASK}"),
           (_holds_any("://"), _URL_LOGIN, f"$1{V.MASK}@"))
_STORED_RULES = ((_holds_any("gsk_", "sk-"), _VENDOR_KEY, V.MASK), *_COMMON,
                 (_holds_label, _STORED_LABEL, f"$1{V.MASK}"), (_holds_any("-----BEGIN "), _PEM, V.MASK))
_EVIDENCE_RULES = (*_COMMON, (_holds_label, _EVIDENCE_LABEL, f"$1{V.MASK}"))


def _mask_known(text: Column, secrets: Iterable[str]) -> Column:
    for secret in sorted({s for s in secrets if s}, key=lambda s: (-len(s), s)):
        text = F.replace(text, F.lit(secret), F.lit(V.MASK))
    return text


def _apply(text: Column, rules) -> Column:
    """The rules in order. A text to which none can apply as it stands, as most, takes none of the steps."""
    def step(possible, pattern, replacement):
        return lambda t: F.when(possible(t), F.regexp_replace(t, pattern, replacement)).otherwise(t)

    def steps(text):
        return reduce(lambda t, rule: let(t, step(*rule)), rules, text)

    return let(text, lambda t: F.when(reduce(Column.__or__, [possible(t) for possible, *_ in rules]), steps(t)).otherwise(t))


def _cut(text: Column, limit: int | None) -> Column:
    return text if limit is None else F.substring(text, 1, limit)


def redact(text: Column, secrets: Iterable[str] = (), limit: int | None = V.STORED_TEXT_LIMIT) -> Column:
    """Redaction of text that is stored, of at most ``limit`` characters; None keeps the whole text."""
    return _cut(_apply(_mask_known(text, secrets), _STORED_RULES), limit)


def safe_text(text: Column, secrets: Iterable[str] = (), limit: int | None = V.EVIDENCE_TEXT_LIMIT,
              all_lines: bool = False) -> Column:
    """Redaction of short evidence: first line only unless ``all_lines``, at most ``limit`` characters unless None."""
    safe = _apply(_mask_known(text, secrets), _EVIDENCE_RULES)
    return _cut(safe if all_lines else first_line(safe), limit)


def mask_log_secrets(text: Column, secrets: Iterable[str], border: str | None = None) -> Column:
    """Mask given values in log text, both plain and in JSON-escaped form.

    ``border`` may stand for one line break of a value; it is kept, behind the mask.
    """
    for secret in (s for s in secrets if s):
        for at in (i for i, c in enumerate(secret) if border and c == "\n"):
            text = F.replace(text, F.lit(secret[:at] + border + secret[at + 1:]), F.lit(V.MASK + border))
        text = F.replace(text, F.lit(secret), F.lit(V.MASK))
        text = F.replace(text, F.lit(json.dumps(secret)[1:-1]), F.lit(V.MASK))
    return text


def over_leaves(value: Column, dtype: T.DataType, fn) -> Column:
    """Apply ``fn`` to every string inside a column of any nested type.

    Keys, numbers, booleans and nulls stay as they are. All plain texts of a
    record go through one array, so the rules appear once in the plan however
    many fields the record has.
    """
    texts: list[Column] = []
    lists: list[Column] = []

    def rebuild(node: Column, kind: T.DataType, parts) -> Column:
        """Collect leaves (``parts`` is None) or put the treated ones in place."""
        if isinstance(kind, T.StringType):
            texts.append(node)
            return node if parts is None else F.get(parts["texts"], F.lit(len(texts) - 1))
        if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType):
            lists.append(node)
            return node if parts is None else F.get(parts["lists"], F.lit(len(lists) - 1))
        if isinstance(kind, T.StructType):
            inner = F.struct(*[rebuild(node[f.name], f.dataType, parts).alias(f.name) for f in kind.fields])
            return F.when(node.isNotNull(), inner)
        if isinstance(kind, T.ArrayType):
            return F.transform(node, lambda x: over_leaves(x, kind.elementType, fn))
        if isinstance(kind, T.MapType):
            return F.transform_values(node, lambda _, x: over_leaves(x, kind.valueType, fn))
        return node

    rebuild(value, dtype, None)
    empty = "array<string>"
    parts = F.struct(F.transform(F.array(*texts).cast(empty), fn).alias("texts"),
                     F.transform(F.array(*lists).cast(f"array<{empty}>"), lambda a: F.transform(a, fn)).alias("lists"))

    def place(done: Column) -> Column:
        texts.clear()
        lists.clear()
        return rebuild(value, dtype, done)

    return let(parts, place)


def same_leaves(one: Column, other: Column, dtype: T.DataType) -> Column:
    """Whether :func:`over_leaves` has left a value as it was; not known of lists of structs or maps."""
    if isinstance(dtype, T.StructType):
        same = [same_leaves(one[f.name], other[f.name], f.dataType) for f in dtype.fields]
        return reduce(Column.__and__, same, one.isNull() == other.isNull())
    if isinstance(dtype, T.MapType):
        return same_leaves(F.map_values(one), F.map_values(other), T.ArrayType(dtype.valueType))
    if isinstance(dtype, T.ArrayType) and isinstance(dtype.elementType, (T.StructType, T.MapType, T.ArrayType)):
        return F.lit(False)
    return one.eqNullSafe(other) if isinstance(dtype, (T.StringType, T.ArrayType)) else F.lit(True)


def redact_record(value: Column, dtype: T.DataType, secrets: Iterable[str] = ()) -> Column:
    secrets = tuple(secrets)
    return over_leaves(value, dtype, lambda text: redact(text, secrets))


def safe_record(value: Column, dtype: T.DataType, secrets: Iterable[str] = ()) -> Column:
    secrets = tuple(secrets)
    return over_leaves(value, dtype, lambda text: safe_text(text, secrets))
