"""Tokens of a text: how many, and where they begin and end.

A tokenizer is named by a file of the tokenizers library (a model's tokenizer.json), or is
WORDS, which parts at white space. Workers open a file once. Offsets are in code points.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

WORDS = "words"
_WORD = re.compile(r"\S+")


@lru_cache(maxsize=4)
def opened(name: str):
    """A function from a text to the (start, stop) of its tokens, without special ones added."""
    if name == WORDS:
        return lambda text: [m.span() for m in _WORD.finditer(text)]
    from tokenizers import Tokenizer

    held = Tokenizer.from_file(name)
    held.no_truncation()
    held.no_padding()
    return lambda text: held.encode(text, add_special_tokens=False).offsets


def offsets(text: Column, name: str = WORDS) -> Column:
    """(start, stop) of each token; a null text has none."""

    @F.arrow_udf("array<struct<start: int, stop: int>>")
    def run(col: pa.Array) -> pa.Array:
        spans = opened(name)
        kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
        return pa.array([[{"start": a, "stop": b} for a, b in spans(x.as_py() or "")] for x in col], kind)

    return run(text)


def count(text: Column, name: str = WORDS) -> Column:
    @F.arrow_udf("bigint")
    def run(col: pa.Array) -> pa.Array:
        spans = opened(name)
        return pa.array([len(spans(x.as_py() or "")) for x in col], pa.int64())

    return run(text)


class Stream:
    """Tokens of a text that comes in parts, as if it came whole. A part is cut where white space follows something else, where tokenizers that part at white space begin a new token whatever comes next; the rest waits for the next part."""

    def __init__(self, name: str):
        self.spans, self.rest, self.at = opened(name), "", 0

    def add(self, text: str, last: bool = False) -> list[tuple[int, int]]:
        """The offsets, in the whole text, of the tokens that are certain now."""
        self.rest += text
        cut = len(self.rest) if last else self._edge()
        done, self.rest = self.rest[:cut], self.rest[cut:]
        found = [(a + self.at, b + self.at) for a, b in self.spans(done)] if done else []
        self.at += len(done)
        return found

    def _edge(self) -> int:
        """The last place before white space that follows something else."""
        i = len(self.rest)
        while i and self.rest[i - 1].isspace():
            i -= 1
        if i == len(self.rest):  # ends in something else
            while i and not self.rest[i - 1].isspace():
                i -= 1
            while i and self.rest[i - 1].isspace():
                i -= 1
        return i
