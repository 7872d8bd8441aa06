"""Chunks of articles and of statutes' running text."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type
from pyspark.sql.types import StructType

from lexspark.functions import tokens

MAX_TOKENS, OVERLAP, SPARE = 512, 64, 32
#: Mean interval lengths in a bin of the overlap join.
BIN_LENGTHS = 256
#: Rows of both sides that meet in a call, about.
SLOT_ROWS = 100_000


def greedy_groups(lengths: Column, limit: int, base: int = 0, gap: int = 0) -> Column:
    """Group number of each length: a new group starts where the running sum would pass the limit. As the sum starts anew with each group, it is followed in order, once."""

    @F.arrow_udf("array<int>")
    def run(col: pa.Array) -> pa.Array:
        out = []
        for xs in col.to_pylist():
            total, n, groups = base, 0, []
            for x in xs or []:
                if total + x + gap > limit and groups:
                    total, n = base, n + 1
                total += x + gap
                groups.append(n)
            out.append(groups if xs is not None else None)
        return pa.array(out, pa.list_(pa.int32()))

    return run(lengths)


CHUNK = "chunk_id string, law string, article_ids array<string>, text string, part int, parts int, start int, stop int"


def _tight(text: str) -> bool:
    return bool(text) and not text[0].isspace() and not text[-1].isspace()


def packed(header: str, blocks: list[str], limit: int, spans) -> list[list[str]]:
    """Blocks in runs whose text under the header stays within the limit, each run as long as it can be.

    Where lines begin and end in something else than white space, a line break parts tokens, and a run's tokens are the sum of its lines'; only around other lines is a run counted anew."""
    size = lambda *lines: len(spans("\n".join(lines)))
    if sum(len(b.encode()) + 1 for b in (header, *blocks)) <= limit:  # no more tokens than bytes
        return [blocks]
    parts: list[list[str]] = []
    cur: list[str] = []
    top = size(header)
    total, plain = top, True
    for b in blocks:
        own, tight = size("", b), _tight(b)
        if plain and tight:
            n = total + own
        else:
            n = size(header, *cur, b)
        if cur and n > limit:
            parts.append(cur)
            cur, plain = [], True
            n = top + own if tight else size(header, b)
        cur.append(b)
        total, plain = n, plain and tight
    return [*parts, cur]


def article_chunks(articles: DataFrame, limit: int = MAX_TOKENS, tokenizer: str = tokens.WORDS) -> DataFrame:
    """A chunk for each article under a header of law, chapter and label; longer articles are cut between paragraphs (and a paragraph that is too long alone between its items)."""
    schema = to_arrow_schema(StructType.fromDDL(CHUNK))

    def run(batches):
        spans = tokens.opened(tokenizer)
        for b in batches:
            out = []
            for r in b.to_pylist():
                header = "[" + " > ".join(x for x in (r["law"], r["chapter"], r["label"]) if x) + "]"
                blocks: list[str] = []
                for p in r["paragraphs"] or []:
                    lines = [p["text"] or "", *(p["items"] or [])]
                    whole = "\n".join(lines)
                    blocks += lines if len(whole.encode()) > limit - SPARE and len(spans(whole)) > limit - SPARE else [whole]
                parts = packed(header, blocks, limit, spans)
                for i, part in enumerate(parts, 1):
                    name = f"art:{r['article_id']}" + (f":{i}" if len(parts) > 1 else "")
                    out.append((name, r["law"], [r["article_id"]], "\n".join([header, *part]), i, len(parts), None, None))
            yield from _batches(out, schema)

    return articles.select("law", "article_id", "chapter", "label", "paragraphs").mapInArrow(run, CHUNK)


def _batches(rows: list[tuple], schema: pa.Schema, most: int = 2000):
    for a in range(0, len(rows), most):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[a : a + most], strict=True), schema.types, strict=True)], schema=schema)


def running_spans(rows: DataFrame, key: str, order: list[str], text: str) -> DataFrame:
    """Append start and stop: the place of each row's text in its key's concatenation."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    stop = F.sum(F.length(text)).over(w)
    return rows.withColumn("stop", stop).withColumn("start", F.col("stop") - F.length(text))


def windows(n: Column, size: int = MAX_TOKENS, overlap: int = OVERLAP) -> Column:
    """Starts of windows of `size` tokens that share `overlap`."""
    return F.sequence(F.lit(0), F.greatest(n - overlap, F.lit(1)) - 1, F.lit(size - overlap))


def _ranges(at: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of each `at` with the numbers of its range."""
    n = np.maximum(hi - lo, 0)
    first = np.cumsum(n) - n
    return np.repeat(at, n), np.arange(n.sum()) - np.repeat(first - lo, n)


def sweep(w: np.ndarray, s: np.ndarray, begin: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (in w, in s) of the overlapping pairs whose later start lies in [begin, end). w and s have a row of starts and one of stops. A span begins within a window, or a window after a span's start and within it: both are ranges of starts in order, so the work is that of sorting and of the pairs."""
    by_w, by_s = np.argsort(w[0], kind="stable"), np.argsort(s[0], kind="stable")
    cut = lambda starts, lo, hi: (np.searchsorted(starts, np.maximum(lo, begin)), np.searchsorted(starts, np.minimum(hi, end)))
    i, j = _ranges(np.arange(w.shape[1]), *cut(s[0][by_s], w[0], w[1]))
    k, m = _ranges(np.arange(s.shape[1]), *cut(w[0][by_w], s[0] + 1, s[1]))
    return np.concatenate([i, by_w[m]]), np.concatenate([by_s[j], k])


def overlapping(windows: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """Pairs of windows and spans of one key that share a character; touching ends don't, and nothing shares one with an interval without length. The windows' columns, then those of the spans, with their start and stop as s_start and s_stop.

    Both sides are cut into bins of some hundred mean lengths of the key's intervals, so a key with many of them is many groups, and an interval is in few. Each bin is swept, and a pair counts in the bin where the later of the two begins."""
    ends = lambda df: df.where("stop > start").select(key, (F.col("stop") - F.col("start")).alias("n"))
    width = ends(windows).unionByName(ends(spans)).groupBy(key).agg(F.ceil(F.avg("n") * BIN_LENGTHS).alias("_width"))
    first, last = F.floor(F.col("start") / F.col("_width")), F.floor((F.col("stop") - 1) / F.col("_width"))
    binned = lambda df: df.where("stop > start").join(width, key).withColumn("_bin", F.explode(F.sequence(first, last)))
    s = spans.withColumnsRenamed({"start": "s_start", "stop": "s_stop"})
    own_fields, names = [f for f in s.schema if f.name != key], windows.columns
    out = StructType([*windows.schema, *own_fields])

    def swept(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({f.name: pa.array([], to_arrow_type(f.dataType)) for f in out})
        of = lambda t, *cs: np.stack([t[c].to_numpy().astype(np.int64) for c in cs])
        w, s, at, width = of(left, "start", "stop"), of(right, "s_start", "s_stop"), left["_bin"].to_numpy(), left["_width"].to_numpy()
        # the bins of the slot, numbered alike on both sides
        marks = np.concatenate([of(left, "_h1", "_h2"), of(right, "_h1", "_h2")], axis=1)
        order = np.lexsort(marks)
        code = np.empty(len(order), np.int64)
        code[order] = np.cumsum(np.append(0, (np.diff(marks[:, order]) != 0).any(0)))
        lc, rc = code[: left.num_rows], code[left.num_rows :]
        lo, ro = np.argsort(lc, kind="stable"), np.argsort(rc, kind="stable")
        found = []
        for c in np.intersect1d(lc, rc):
            own = lo[slice(*np.searchsorted(lc, [c, c + 1], sorter=lo))]
            other = ro[slice(*np.searchsorted(rc, [c, c + 1], sorter=ro))]
            begin = at[own[0]] * width[own[0]]
            i, j = sweep(w[:, own], s[:, other], begin, begin + width[own[0]])
            found.append((own[i], other[j]))
        i, j = (pa.array(np.concatenate([f[k] for f in found]) if found else np.empty(0, np.int64)) for k in range(2))
        met = left.select(names).take(i)
        for f in own_fields:
            met = met.append_column(f.name, right[f.name].take(j))
        return met

    # a task's call takes many small bins, told apart by two hashes of 96 bits together
    slots = max(2 * windows.sparkSession.sparkContext.defaultParallelism, (windows.count() + spans.count()) // SLOT_ROWS)
    told = lambda df: df.withColumns({"_h1": F.xxhash64(key, "_bin"), "_h2": F.hash(key, "_bin")}).withColumn("_slot", F.pmod("_h1", F.lit(slots)))
    two = told(binned(spans)).withColumnsRenamed({"start": "s_start", "stop": "s_stop", key: "_key", "_bin": "_s_bin", "_width": "_s_width", "_slot": "_s_slot"})
    return told(binned(windows)).groupBy("_slot").cogroup(two.groupBy("_s_slot")).applyInArrow(swept, out)


def _windower(size: int, overlap: int, tokenizer: str):
    """A table function that reads a law's articles in order and gives each window as soon as its last token is certain. It holds the text and the articles of the windows that are open, not the law."""

    @F.udtf(returnType=CHUNK)
    class Windows:
        def __init__(self):
            self.law, self.stream = None, tokens.Stream(tokenizer)
            self.text, self.text_at, self.read = "", 0, 0  # what is held of the law's text, where that begins, and how much was read
            self.spans: list[tuple[int, int, str]] = []
            self.held: list[tuple[int, int]] = []  # tokens from number `first` on
            self.first, self.start, self.i = 0, 0, 0

        def eval(self, row):
            self.law = row["law"]
            text = (row["text"] or "") + "\n\n"
            self.spans.append((self.read, self.read + len(text), row["article_id"]))
            self.read += len(text)
            self.text += text
            self.held += self.stream.add(text)
            while self.first + len(self.held) >= self.start + size:
                yield self.window(self.start + size)

        def terminate(self):
            self.held += self.stream.add("", last=True)
            n = self.first + len(self.held)
            while n and self.start < max(n - overlap, 1):
                yield self.window(min(self.start + size, n))

        def window(self, stop: int):
            a, b = self.held[self.start - self.first][0], self.held[stop - 1 - self.first][1]
            ids = [name for s, e, name in self.spans if s < b and e > a]
            row = (f"fixed:{self.law}:{self.i}", self.law, ids, self.text[a - self.text_at : b - self.text_at].strip(), None, None, a, b)
            self.i, self.start = self.i + 1, self.start + size - overlap
            self.held, self.first = self.held[self.start - self.first :], max(self.start, self.first)
            keep = self.held[0][0] if self.held else b
            self.text, self.text_at = self.text[keep - self.text_at :], keep
            self.spans = [s for s in self.spans if s[1] > keep]
            return row

    return Windows


def fixed_chunks(articles: DataFrame, size: int = MAX_TOKENS, overlap: int = OVERLAP, tokenizer: str = tokens.WORDS) -> DataFrame:
    """Windows of tokens over each law's running text, with the articles that they overlap."""
    rows = articles.select("law", "pos", "article_id", "text").asTable().partitionBy("law").orderBy("pos")
    return _windower(size, overlap, tokenizer)(rows)
