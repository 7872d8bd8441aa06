"""Benchmark decontamination by pigeonhole edit matching.

A test item of length n may occur with k = floor(n * error_rate) edits. Cut into k + 1
pieces, at least one piece must occur unchanged; an Aho-Corasick automaton finds all
exact piece hits in a document in one pass, and Myers' bit-parallel distance verifies
the item around each hit. Items under `border_chars` characters are one piece without
edits, and count only where no letter or digit adjoins them.

Texts are compared in lower case with each run of white space as one space; places are
code points of that form. Defined results: null and empty texts, and items without text,
match nothing; an item's id is given as it is, of any type, also null; an item occurring several times in a document gives its best place (the
first among equals) and the number of places; items with equal text are each reported; of
other columns `find` keeps the key alone, and `mark` all but one named like its result; very long texts are read whole; empty tables give an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, DataType, IntegerType, StructField, StructType


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """k + 1 pieces of nearly equal length with their places in the item."""
    n = len(item)
    cut = [round(i * n / (k + 1)) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cut, cut[1:], strict=False) if b > a]


def myers(pattern: str, text: str) -> tuple[int, int]:
    """(least edit distance of the pattern to a part of the text, end of the first such part), one text character a step on whole bit vectors."""
    m = len(pattern)
    peq: dict[str, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    best, end = m, 0
    for j, c in enumerate(text, 1):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (~(xh | pv) & full)
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = ph << 1 & full  # a match may start anywhere, so nothing enters at the bottom
        mh = mh << 1 & full
        pv = mh | (~(xv | ph) & full)
        mv = ph & xv
        if score < best:
            best, end = score, j
    return best, end


def located(pattern: str, text: str) -> tuple[int, int, int]:
    """(distance, start, end) of the best part of the text; the start comes from the same search backwards."""
    d, end = myers(pattern, text)
    back = text[max(0, end - len(pattern) - d) : end][::-1]
    _, length = myers(pattern[::-1], back)
    return d, end - length, end


@dataclass(frozen=True)
class ItemBlock:
    """Items whose automaton fits a worker."""

    items: tuple[tuple[object, str], ...]
    error_rate: float
    border_chars: int = 20

    def budget(self, item: str) -> int:
        return 0 if len(item) < self.border_chars else int(len(item) * self.error_rate)


@lru_cache(maxsize=2)
def _automaton(block: ItemBlock):
    import ahocorasick

    found: dict[str, list[tuple[int, int]]] = {}
    for i, (_, text) in enumerate(block.items):
        for at, piece in pieces(text, block.budget(text)):
            found.setdefault(piece, []).append((i, at))
    a = ahocorasick.Automaton()
    for piece, places in found.items():
        a.add_word(piece, (len(piece), places))
    if found:
        a.make_automaton()
    return a if found else None


def matches(block: ItemBlock, text: str | None) -> list[tuple[object, int, int, int, int]]:
    """(item_id, start, end, distance, places) of each item found in the text."""
    a = _automaton(block)
    if not text or a is None:
        return []
    low = normal(text)
    windows: dict[int, list[list[int]]] = {}
    exact: dict[int, list[int]] = {}
    for end, (size, places) in a.iter(low):
        for i, at in places:
            item = block.items[i][1]
            k = block.budget(item)
            start = end - size + 1 - at
            if len(item) < block.border_chars:
                if not (low[start - 1 : start].isalnum() and item[0].isalnum()) and not (low[end + 1 : end + 2].isalnum() and item[-1].isalnum()):
                    exact.setdefault(i, []).append(start)
                continue
            lo, hi = max(0, start - k), min(len(low), start + len(item) + k)
            own = windows.setdefault(i, [])
            if not own or lo >= own[-1][0] + len(item) - k or lo < own[-1][0]:
                own.append([lo, hi])
            else:
                own[-1][1] = max(own[-1][1], hi)
    out = [(block.items[i][0], at[0], at[0] + len(block.items[i][1]), 0, len(at)) for i, at in sorted(exact.items())]
    for i, own in sorted(windows.items()):
        id_, item = block.items[i]
        k, good = block.budget(item), set()
        for lo, hi in own:
            d, s, e = located(item, low[lo:hi])
            if d <= k:
                good.add((d, lo + s, lo + e))
        if good:
            d, s, e = min(good)
            out.append((id_, s, e, d, len(good)))
    return out


def blocks(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", error_rate: float = 0.05, block_chars: int = 8_000_000, border_chars: int = 20):
    """The items in blocks of bounded size, read one partition at a time."""
    held: list[tuple[object, str]] = []
    size = 0
    for r in benchmark.where(F.col(text).isNotNull()).select(item_id, text).orderBy(item_id, text).toLocalIterator():
        item = normal(r[1])
        if not item:
            continue
        if held and size + len(item) > block_chars:
            yield ItemBlock(tuple(held), error_rate, border_chars)
            held, size = [], 0
        held.append((r[0], item))
        size += len(item)
    yield ItemBlock(tuple(held), error_rate, border_chars)


def find(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """A row for each document and item found in it: key, item_id, start, end, distance, n_places."""
    out = None
    kind = benchmark.schema[options.get("item_id", "item_id")].dataType
    for block in blocks(benchmark, **options):
        found = docs.select(F.col(key).alias("key"), F.explode(_matcher(docs.sparkSession, block, kind)(F.col(text))).alias("m")).select(F.col("key").alias(key), "m.*")
        out = found if out is None else out.unionByName(found)
    return out


def mark(docs: DataFrame, benchmark: DataFrame, text: str = "text", name: str = "_leaks", **options) -> DataFrame:
    """`docs` with one more column, the matches of all items."""
    kind = benchmark.schema[options.get("item_id", "item_id")].dataType
    parts = [_matcher(docs.sparkSession, block, kind)(F.col(text)) for block in blocks(benchmark, **options)]
    return docs.withColumn(name, F.concat(*parts) if len(parts) > 1 else parts[0])


def _matcher(spark, block: ItemBlock, item_id: DataType):
    shared = spark.sparkContext.broadcast(block)
    kind = pa.list_(pa.struct([("item_id", to_arrow_type(item_id)), *((c, pa.int32()) for c in ("start", "end", "distance", "n_places"))]))
    names = ("item_id", "start", "end", "distance", "n_places")

    @F.arrow_udf(ArrayType(StructType([StructField("item_id", item_id), *(StructField(c, IntegerType()) for c in names[1:])])))
    def run(col: pa.Array) -> pa.Array:
        held = shared.value
        return pa.array([[dict(zip(names, m, strict=True)) for m in matches(held, x.as_py())] for x in col], kind)

    return run
