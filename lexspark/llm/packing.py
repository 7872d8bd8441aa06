"""Packing documents into sequences with a grouping genetic algorithm.

Only documents longer than a sequence are cut; their full pieces are sequences already,
so what remains to pack is one piece a document, shorter than a sequence. Those pieces are
dealt by hash to blocks of bounded size, each block to several islands. An island keeps a
population of packings: crossover injects whole well-filled bins of one parent into the
other, drops bins that hold a document twice and best-fits the displaced documents.
Islands run as separate tasks; between epochs each sends its elite to its neighbour. What
ends in badly filled bins is pooled over all blocks and packed again.

Defined results: null and empty texts are documents of the end token alone; documents
with equal text or equal id are packed each on its own; other columns of the documents are left out; very long texts are cut into many
pieces; a null id stays null; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_left, insort
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspark.llm.common import pinned, written

LIMIT = 1024
END_ID = 2
BLOCK_ITEMS = 2000
ISLANDS = 2


# --- tokens -------------------------------------------------------------------------


def default_tokenizer() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def _byte_of_char() -> dict[str, int]:
    """Byte-level vocabularies write printable Latin-1 bytes as themselves and the others as the characters from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or (b >= 161 and b != 173)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=2)
def encoder(path: str):
    """A function from texts to lists of ids, those of the tokenizers library without special tokens added. The vocabulary's ids are its merge ranks, so tiktoken can run it; where a probe differs, or a text names a special token, the library does."""
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(path)
    usual = lambda x: slow.encode(x, add_special_tokens=False).ids
    probe = ["The  cat's 12 naïve, übergroße …\n\n x_y  ", "", "año\t ß😀 don't 3.14"]
    try:
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        special = {t["content"] for t in held.get("added_tokens", [])}
        chars = _byte_of_char()
        ranks = {bytes(chars[c] for c in token): i for token, i in held["model"]["vocab"].items() if token not in special}
        fast = tiktoken.Encoding("vocabulary", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        if [fast.encode_ordinary(x) for x in probe] == [usual(x) for x in probe]:
            return lambda x: usual(x) if any(s in x for s in special) else fast.encode_ordinary(x)
    except (KeyError, ImportError, ValueError):
        pass
    return usual


def cut(ids: list[int], limit: int = LIMIT) -> list[tuple[int, int, int, int]]:
    """(piece, start, length, crc32 of the ids) with all pieces full but the first."""
    n = len(ids)
    data = np.asarray(ids, "<u4").tobytes()
    first = n - (-(-n // limit) - 1) * limit
    edges = [0, *range(first, n + 1, limit)]
    return [(i, a, b - a, zlib.crc32(data[4 * a : 4 * b])) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]


def pieces(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str | None = None, limit: int = LIMIT, end_id: int = END_ID) -> DataFrame:
    """A row for each piece of each document: key, piece, start, length, ids_crc32."""
    path = tokenizer or default_tokenizer()
    names = ("piece", "start", "length", "ids_crc32")
    kind = pa.list_(pa.struct([("piece", pa.int32()), *((n, pa.int64()) for n in names[1:])]))

    @F.arrow_udf("array<struct<piece: int, start: bigint, length: bigint, ids_crc32: bigint>>")
    def run(col: pa.Array) -> pa.Array:
        encode = encoder(path)
        return pa.array([[dict(zip(names, p, strict=True)) for p in cut([*encode(x.as_py() or ""), end_id], limit)] for x in col], kind)

    return docs.select(F.col(key), F.explode(run(F.col(text))).alias("_p")).select(key, "_p.*")


# --- the genetic algorithm ----------------------------------------------------------


def best_fit(items: list[int], size, bins: list[list[int]], fill: list[int], limit: int) -> None:
    """Put each item, largest first, into the fullest bin that takes it, or a new one."""
    room = sorted((limit - f, b) for b, f in enumerate(fill) if f < limit)
    for i in sorted(items, key=lambda i: (-size[i], i)):
        at = bisect_left(room, (size[i], -1))
        if at < len(room):
            left, b = room.pop(at)
            bins[b].append(i)
            fill[b] += size[i]
        else:
            b, left = len(bins), limit
            bins.append([i])
            fill.append(size[i])
        if left > size[i]:
            insort(room, (left - size[i], b))


def fitness(fill: list[int], limit: int) -> tuple[int, float]:
    """Fewer bins first, then fuller ones: the mean square of the fill."""
    return -len(fill), float(np.square(np.asarray(fill, float) / limit).mean()) if fill else 0.0


def cross(a, b, size, limit: int, rng):
    """Inject a run of b's well-filled bins into a, drop a's bins that share an item, and best-fit what they held besides."""
    (bins_a, fill_a), (bins_b, fill_b) = a, b
    order = sorted(range(len(bins_b)), key=lambda j: -fill_b[j])
    n = max(1, int(len(order) * rng.uniform(0.1, 0.5)))
    first = int(rng.integers(0, max(1, len(order) // 2)))
    given = order[first : first + n]
    held = {i for j in given for i in bins_b[j]}
    bins, fill, loose = [list(bins_b[j]) for j in given], [fill_b[j] for j in given], []
    for own, f in zip(bins_a, fill_a, strict=True):
        if held.isdisjoint(own):
            bins.append(list(own))
            fill.append(f)
        else:
            loose += [i for i in own if i not in held]
    worst = sorted(range(len(bins)), key=lambda j: fill[j])[: max(1, len(bins) // 50)]  # mutation: empty the worst bins
    loose += [i for j in worst for i in bins[j]]
    gone = set(worst)
    bins = [x for j, x in enumerate(bins) if j not in gone]
    fill = [x for j, x in enumerate(fill) if j not in gone]
    best_fit(loose, size, bins, fill, limit)
    return bins, fill


def evolve(size, limit: int, seeds: list, rng, population: int = 4, children: int = 24):
    """The best packing after `children` crossovers; `seeds` are packings that came from elsewhere."""
    pop = list(seeds)
    low = -(-sum(size) // limit)
    noise = 0.0
    while len(pop) < population:
        jittered = [max(1, s + (rng.integers(-int(noise * limit), int(noise * limit) + 1) if noise else 0)) for s in size]
        bins, fill = [], []
        if noise:
            order = sorted(range(len(size)), key=lambda i: (-jittered[i], i))
            for part in (order[: len(order) // 2], order[len(order) // 2 :]):
                best_fit(part, size, bins, fill, limit)
        else:
            best_fit(list(range(len(size))), size, bins, fill, limit)
        pop.append((bins, fill))
        noise += 0.1
    rank = lambda p: fitness(p[1], limit)
    pop.sort(key=rank, reverse=True)
    for _ in range(children if len(size) > 2 else 0):
        if len(pop[0][1]) == low:
            break
        i, j = rng.choice(len(pop), 2, replace=False)
        child = cross(pop[max(i, j)], pop[min(i, j)], size, limit, rng)
        if rank(child) > rank(pop[-1]):
            pop[-1] = child
            pop.sort(key=rank, reverse=True)
    return pop[0]


def _packings(frame: pd.DataFrame, ids: list[int], place: dict[int, int], limit: int):
    out = []
    for _, own in frame[frame["bin"] >= 0].groupby("member", sort=True):
        bins: dict[int, list[int]] = {}
        for rid, b in zip(own["rid"], own["bin"], strict=True):
            bins.setdefault(b, []).append(place[rid])
        out.append(list(bins.values()))
    return out


def _island(limit: int, final: bool):
    """A grouped-map function: rows (block, island, member, rid, size, bin) of one island to its elite."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        items = frame.drop_duplicates("rid").sort_values("rid")
        ids, size = items["rid"].tolist(), items["size"].tolist()
        place = {r: i for i, r in enumerate(ids)}
        block, island = int(frame["block"].iloc[0]), int(frame["island"].iloc[0])
        seeds = [(bins, [sum(size[i] for i in b) for b in bins]) for bins in _packings(frame, ids, place, limit)]
        bins, fill = evolve(size, limit, seeds, np.random.default_rng([block, island, len(ids), len(seeds)]), population=max(3, len(seeds)), children=8 if final else 20)
        rows = []
        for b, own in enumerate(bins):
            at = 0
            name = min(ids[i] for i in own)
            for i in own:
                rows.append((block, island, ids[i], size[i], b, name, at, fill[b]))
                at += size[i]
        return pd.DataFrame(rows, columns=["block", "island", "rid", "size", "bin", "sequence_id", "offset", "fill"])

    return run


_ELITE = "block bigint, island int, rid bigint, size bigint, bin bigint, sequence_id bigint, offset bigint, fill bigint"


def pack_items(items: DataFrame, n: int, limit: int = LIMIT, salt: int = 0) -> DataFrame:
    """Pack rows (rid, size); n is their number. Two epochs on the islands with migration between, then each block's elites meet."""
    blocks = max(1, n // BLOCK_ITEMS)
    start = items.select(F.pmod(F.xxhash64("rid", F.lit(salt)), F.lit(blocks)).alias("block"), "rid", "size")
    start = start.select("block", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"), F.lit(0).alias("member"), "rid", "size", F.lit(-1).cast("bigint").alias("bin"))
    one = start.groupBy("block", "island").applyInPandas(_island(limit, False), _ELITE)
    goes = F.explode(F.array(F.struct(F.col("island").alias("to"), F.lit(0).alias("member")), F.struct(((F.col("island") + 1) % ISLANDS).alias("to"), F.lit(1).alias("member"))))
    moved = one.select("block", goes.alias("g"), "rid", "size", "bin").select("block", F.col("g.to").alias("island"), "g.member", "rid", "size", "bin")
    two = moved.groupBy("block", "island").applyInPandas(_island(limit, False), _ELITE)
    met = two.select("block", F.lit(0).alias("island"), F.col("island").alias("member"), "rid", "size", "bin")
    return met.groupBy("block").applyInPandas(_island(limit, True), _ELITE)


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str | None = None, limit: int = LIMIT, end_id: int = END_ID, slack: int = 12) -> DataFrame:
    """A row for each piece with its sequence and offset. Bins with more than `slack` tokens free are pooled over all blocks and packed once more."""
    cut_up = pieces(docs, key, text, tokenizer, limit, end_id)
    held = written(cut_up.withColumn("rid", F.monotonically_increasing_id()))
    items = held.where(F.col("length") < limit).select("rid", F.col("length").alias("size"))
    n = items.count()
    first = pinned(pack_items(items, n, limit))
    poor = first.where(F.col("fill") < limit - slack).select("rid", "size")
    again = pack_items(poor, poor.count(), limit, salt=1)
    found = first.where(F.col("fill") >= limit - slack).unionByName(again).select("rid", "sequence_id", "offset")
    rest = [c for c in held.columns if c != "rid"]
    joined = held.where(F.col("length") < limit).join(found, "rid").select(*rest, "sequence_id", "offset")
    full = held.where(F.col("length") >= limit).select(*rest, F.col("rid").alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    return joined.unionByName(full)
