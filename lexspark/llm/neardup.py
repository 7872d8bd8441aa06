"""Near-duplicate classes with ProbMinHash.

Each document is a bag of five-word shingles weighted by count. Every shingle emits
exponential arrivals at a rate of its weight into random signature slots; a slot keeps its
earliest arrival, and a shingle stops as soon as its next arrival comes later than the
latest slot. Equal slots estimate the probability Jaccard similarity. Bands of slots give
candidates, and candidates are verified exactly on the texts' shingles.

A band's bucket that holds many documents is not expanded into pairs. Its members are
compared with a pivot, the one with the most company over all bands, and it is split by
further bands: small parts are expanded in full, as small buckets are, and large ones are
compared with that pivot and a random one. Classes are connected components, so members
that are verified to be of one class need no pairs among themselves. Where a large bucket
still holds several classes, all similar pairs of its texts over classes are found, in
tiles of two bounded blocks of texts, by the rarest shingles of each text (`rare_pairs`);
a tile gives only the links that it finds, so no rows are made for pairs.

Defined results: equal texts (also empty ones) always share a class; a null text is a
class of its own; a text without words has no shingles and equals only its copies; a text
under five words has one shingle; the class id is the least id of its members (null for a
null id alone); very long texts are read whole; repeated rows are members each; an empty
table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexspark.llm.common import U64, mix, pinned, shingle_hashes, written


#: Text ids (16 bytes each) of which a list may be broadcast.
FEW = 200_000
#: Shingles of texts that a worker keeps while it verifies a batch of pairs.
HELD = 1_000_000


@dataclass(frozen=True)
class NearDup:
    width: int = 5
    similarity: float = 0.8
    bands: int = 24
    rows: int = 5
    #: Estimated similarity below which a candidate isn't verified: five standard errors under the threshold.
    estimate_slack: float = 0.18
    #: Buckets of at most so many texts are expanded into all pairs.
    small: int = 12
    #: Second bands by which a large bucket is split.
    second: int = 3
    #: Most texts, and about most bytes of text, of a block of a large bucket.
    block_texts: int = 1500
    block_bytes: int = 4_000_000

    @property
    def slots(self) -> int:
        return self.bands * self.rows


def signatures(bags: list[tuple[np.ndarray, np.ndarray]], slots: int) -> np.ndarray:
    """ProbMinHash signatures (32 bits a slot) of several bags of (shingle hashes, weights), all bags a round of arrivals at a time."""
    n = len(bags)
    first = np.full(n * slots, np.inf)
    who = np.zeros(n * slots, np.uint32)
    owner = np.repeat(np.arange(n), [len(h) for h, _ in bags])
    h = np.concatenate([h for h, _ in bags]) if n else np.empty(0, U64)
    w = np.concatenate([w for _, w in bags]) if n else np.empty(0)
    at = np.zeros(len(h))
    bag_id = (mix(h ^ U64(0x5851F42D4C957F2D)) >> U64(32)).astype(np.uint32) | np.uint32(1)
    step = 0
    while len(h):
        step += 1
        r = mix(h + U64(step * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        u = ((r >> U64(11)).astype(float) + 0.5) * 2.0**-53
        at = at - np.log(u) / w
        cell = owner * slots + (mix(r) % U64(slots)).astype(np.int64)
        better = np.flatnonzero(at < first[cell])
        order = better[np.argsort(-at[better], kind="stable")]  # the earliest is written last
        first[cell[order]] = at[order]
        who[cell[order]] = bag_id[order]
        latest = first.reshape(n, slots).max(axis=1)
        go = np.flatnonzero(at < latest[owner])
        h, w, at, owner, bag_id = h[go], w[go], at[go], owner[go], bag_id[go]
    return who.reshape(n, slots)


def bag(text: str | None, width: int) -> tuple[np.ndarray, np.ndarray]:
    h, n = np.unique(shingle_hashes(text, width), return_counts=True)
    return h, n.astype(float)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Probability Jaccard: the sum over common x of 1 / sum_y max(a_y / a_x, b_y / b_x), by sorting y on b_y / a_y."""
    (ha, wa), (hb, wb) = a, b
    if not len(ha) or not len(hb):
        return 0.0
    at = np.minimum(np.searchsorted(hb, ha), len(hb) - 1)
    ia = np.flatnonzero(hb[at] == ha)
    if not len(ia):
        return 0.0
    x, y = wa[ia], wb[at[ia]]
    only_a, only_b = wa.sum() - x.sum(), wb.sum() - y.sum()
    ratio = y / x
    order = np.argsort(ratio, kind="stable")
    x, y, ratio = x[order], y[order], ratio[order]
    # at common shingle i, y_j / y_i > x_j / x_i just where ratio_j > ratio_i
    below = np.concatenate([[0], np.cumsum(x)])
    above = np.concatenate([np.cumsum(y[::-1])[::-1], [0]])
    last = np.searchsorted(ratio, ratio, side="right")
    return float((1 / ((below[last] + only_a) / x + (above[last] + only_b) / y)).sum())


def _sign(p: NearDup):
    fields = [("sig", pa.binary()), ("bands", pa.list_(pa.int64()))]

    @F.arrow_udf("struct<sig: binary, bands: array<bigint>>")
    def run(col: pa.Array) -> pa.Array:
        sig: list[bytes | None] = [None] * len(col)
        bands: list = [None] * len(col)
        seeds = mix(np.arange(1, p.bands + 1, dtype=U64))

        def flush(part: list) -> None:
            if not part:
                return
            s = signatures([b for _, b in part], p.slots)
            key = np.zeros((len(part), p.bands), U64) + seeds
            for j in range(p.rows):
                key = mix(key * U64(0x100000001B3) + s.reshape(len(part), p.bands, p.rows)[:, :, j])
            for (i, _), row, k in zip(part, s, key.view(np.int64), strict=True):
                sig[i], bands[i] = row.astype(np.uint16).tobytes(), k  # half of a slot's bits do for the estimate

        part, size = [], 0
        for i, x in enumerate(col):
            b = bag(x.as_py(), p.width)
            if len(b[0]):
                part.append((i, b))
                size += len(b[0]) + 50
            if size > 150_000:
                flush(part)
                part, size = [], 0
        flush(part)
        return pa.StructArray.from_arrays([pa.array(sig, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], [n for n, _ in fields])

    return run


def _estimate():
    @F.arrow_udf("double")
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        x, y = a.to_pylist(), b.to_pylist()
        return pa.array([float((np.frombuffer(p, np.uint16) == np.frombuffer(q, np.uint16)).mean()) for p, q in zip(x, y, strict=True)])

    return run


def _verify(width: int):
    @F.arrow_udf("double")
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        room = 0

        def of(text: str) -> tuple[np.ndarray, np.ndarray]:
            nonlocal room
            own = held.get(text)
            if own is None:
                own = bag(text, width)
                if room > HELD:
                    held.clear()
                    room = 0
                held[text] = own
                room += len(own[0])
            return own

        return pa.array([similarity(of(p.as_py()), of(q.as_py())) for p, q in zip(a, b, strict=True)], pa.float64())

    return run


def _pairs(rows: DataFrame) -> DataFrame:
    """All pairs (a < b) in buckets that are small."""
    l, r = rows.select("bucket", "tid").alias("l"), rows.select("bucket", "tid").alias("r")
    return l.join(r, (F.col("l.bucket") == F.col("r.bucket")) & (F.col("l.tid") < F.col("r.tid"))).select(F.col("l.tid").alias("a"), F.col("r.tid").alias("b"))


def _stars(rows: DataFrame, n_random: int) -> DataFrame:
    """Pairs of a bucket's members with its pivots: the member with most company, and random ones."""
    drawn = [F.min(F.struct(F.xxhash64("bucket", "tid", F.lit(k)).alias("h"), "tid"))["tid"].alias(f"p{k}") for k in range(n_random)]
    pivots = rows.groupBy("bucket").agg(F.max(F.struct("company", "tid"))["tid"].alias("p"), *drawn)
    every = F.array_distinct(F.array("p", *[f"p{k}" for k in range(n_random)]))
    star = rows.join(pivots, "bucket").select("tid", F.explode(every).alias("pivot")).where("tid <> pivot")
    return star.select(F.least("tid", "pivot").alias("a"), F.greatest("tid", "pivot").alias("b"))


def candidates(signed: DataFrame, p: NearDup) -> tuple[DataFrame, DataFrame]:
    """Distinct pairs (a < b) of text ids that share a band, and the members (bucket, tid) of large buckets. Those give pairs with their pivot, and are split by further bands: small parts give all their pairs, large ones pairs with two pivots."""
    rows = signed.select("tid", F.posexplode("bands").alias("band", "bucket"))
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    kept = pinned(rows.join(sizes, "bucket").select("bucket", "tid", "n"))
    # how much company a text has over all its bands
    company = kept.groupBy("tid").agg(F.sum("n").alias("company"), F.max("n").alias("most")).where(F.col("most") > p.small)
    large = pinned(kept.where(F.col("n") > p.small).join(company, "tid").select("bucket", "tid", "company"))
    # a text's large buckets travel together, so that each text's bands are joined once
    own = large.groupBy("tid", "company").agg(F.collect_set("bucket").alias("buckets")).join(signed.select("tid", "bands"), "tid")
    picks = lambda whole: F.transform(F.sequence(F.lit(1), F.lit(p.second)), lambda k: F.xxhash64(whole, k, F.element_at("bands", (F.pmod(F.xxhash64(whole, k), F.lit(p.bands)) + 1).cast("int"))))
    fine = own.select("tid", "company", F.explode(F.array_distinct(F.flatten(F.transform("buckets", picks)))).alias("bucket"))
    parts = fine.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    split = pinned(fine.join(parts, "bucket").select("bucket", "tid", "company", "n"))
    small = kept.where(F.col("n") <= p.small).select("bucket", "tid").unionByName(split.where(F.col("n") <= p.small).select("bucket", "tid"))
    return _pairs(small).unionByName(_stars(large, 0)).unionByName(_stars(split.where(F.col("n") > p.small), 1)).distinct(), large


def unsettled(large: DataFrame, roots: DataFrame) -> DataFrame:
    """(bucket, tid, class) of the members of large buckets that hold more than one class."""
    own = large.select("bucket", "tid").join(roots.select(F.col("node").alias("tid"), "root"), "tid", "left").select("bucket", "tid", F.coalesce("root", "tid").alias("class"))
    mixed = own.groupBy("bucket").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).where("lo <> hi").select("bucket")
    return own.join(mixed, "bucket", "left_semi")


@dataclass(frozen=True)
class Bags:
    """Bags of shingles one after another: the bag, the shingle's number, its weight and the number of bags that hold it, of each entry; and where each bag starts."""

    owner: np.ndarray
    name: np.ndarray
    weight: np.ndarray
    often: np.ndarray
    start: np.ndarray

    @staticmethod
    def of(bags: list[tuple[np.ndarray, np.ndarray]]) -> Bags:
        size = [len(h) for h, _ in bags]
        _, name, often = np.unique(np.concatenate([h for h, _ in bags] or [np.empty(0, U64)]), return_inverse=True, return_counts=True)
        return Bags(np.repeat(np.arange(len(bags)), size), name, np.concatenate([w for _, w in bags] or [np.empty(0)]), often[name], np.concatenate([[0], np.cumsum(size)]).astype(np.int64))

    @property
    def whole(self) -> np.ndarray:
        return np.bincount(self.owner, self.weight, len(self.start) - 1)


def rare_pairs(bags: Bags, kind: np.ndarray, similar: float) -> np.ndarray:
    """A matrix that is true for pairs (i, j) of bags of different kinds, among them (one way round at least) every one whose similarity reaches `similar`.

    Let P and Q be the shares of two texts' weight that lies on common shingles. Their probability Jaccard is at most PQ / (P + Q - PQ), as each term is at most 1 / (1 / a_x + (1 - Q) / b_x), which is concave. So at a similarity of s the greater of P and Q is at least 2s / (1 + s), and the other at least s. With the shingles in one order for all texts, the first common one has at most (1 - s) / (1 + s) of the weight of the one text before it, and at most 1 - s of the other's. Rare shingles are first, so few texts meet; a shingle of one text alone meets none.
    """
    n = len(bags.start) - 1
    found = np.zeros((n, n), bool)
    order = np.lexsort((bags.name, bags.often, bags.owner))
    owner, name, weight, often = bags.owner[order], bags.name[order], bags.weight[order], bags.often[order]
    total = np.cumsum(weight) - weight
    share = (total - np.append(total, 0)[bags.start[:-1]][owner]) / bags.whole[owner]
    meets = (often > 1) & (share <= 1 - similar + 1e-9)
    owner, name, rarest = owner[meets], name[meets], share[meets] <= (1 - similar) / (1 + similar) + 1e-9
    order = np.argsort(name, kind="stable")
    owner, name, rarest = owner[order], name[order], rarest[order]
    if len(name):
        edge = np.flatnonzero(np.append(True, name[1:] != name[:-1]))
        own = kind[owner]
        worth = (np.minimum.reduceat(own, edge) != np.maximum.reduceat(own, edge)) & np.logical_or.reduceat(rarest, edge)
        for a, b in zip(edge[worth], np.append(edge[1:], len(name))[worth], strict=True):
            found[np.ix_(owner[a:b][rarest[a:b]], owner[a:b])] = True
    return found & (kind[:, None] != kind[None, :])


def bounded(bags: Bags, pairs: np.ndarray, similar: float) -> Iterator[tuple[int, int]]:
    """Those of the pairs (a matrix of truth values) whose common weight lets their similarity reach `similar`, by the bound of `rare_pairs`."""
    whole, size = bags.whole, np.diff(bags.start)
    weigh = np.zeros(int(bags.name.max(initial=-1)) + 1)
    for x in np.flatnonzero(pairs.any(1)).tolist():
        ys = np.flatnonzero(pairs[x])
        own = slice(bags.start[x], bags.start[x + 1])
        weigh[bags.name[own]] = bags.weight[own]
        first = np.cumsum(size[ys]) - size[ys]
        at = np.arange(int(size[ys].sum())) + np.repeat(bags.start[ys] - first, size[ys])
        of_x = weigh[bags.name[at]]
        p, q = np.add.reduceat(of_x, first) / whole[x], np.add.reduceat(bags.weight[at] * (of_x > 0), first) / whole[ys]
        weigh[bags.name[own]] = 0
        for y in ys[p * q >= (similar - 1e-9) * (p + q - p * q)].tolist():
            yield x, y


def _linked(p: NearDup):
    """A grouped-map function: the texts of one tile (of a bucket's blocks `i` and `j`) to similar pairs over classes, no more than connect the classes. A pair is looked at in the first of the buckets that its texts share, and if their blocks differ, in the tile of both."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        bucket, apart = frame["bucket"].iloc[0], frame["i"].iloc[0] != frame["j"].iloc[0]
        bags = [bag(t, p.width) for t in frame["t"]]
        coded = Bags.of(bags)
        _, kind = np.unique(np.array([c.hex() for c in frame["class"]]), return_inverse=True)
        found = rare_pairs(coded, kind, p.similarity)
        found = np.triu(found | found.T)
        if apart:
            block = frame["block"].to_numpy()
            found &= block[:, None] != block[None, :]
        before = [[x for x in m if x < bucket] for m in frame["mine"]]
        column = {x: k for k, x in enumerate(sorted({x for m in before for x in m}))}
        if column and found.any():
            held = np.zeros((len(bags), len(column)), np.float32)
            for k, m in enumerate(before):
                held[k, [column[x] for x in m]] = 1
            found &= held @ held.T == 0
        up = list(range(int(kind.max()) + 1))

        def top(x: int) -> int:
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        links = []
        for x, y in bounded(coded, found, p.similarity):
            k, l = top(kind[x]), top(kind[y])
            if k != l and similarity(bags[x], bags[y]) >= p.similarity:
                up[k] = l
                links.append((frame["class"].iloc[x], frame["class"].iloc[y]))
        return pd.DataFrame(links, columns=["a", "b"])

    return run


def components(links: DataFrame, most_rounds: int = 40) -> DataFrame:
    """(node, root) of each node of the links (a, b), with one root for each component.

    By contraction: each node points to its least neighbour (or itself) in an order that is random anew in each round, and then to where that one points; links between nodes that now point to one place are done, the others join the places. Links shrink fast, so rounds are few and the later ones small.
    """
    edges = links.select(F.col("a").alias("src"), F.col("b").alias("dst"))
    steps: list[DataFrame] = []
    for n in range(most_rounds):
        edges = pinned(edges)
        if edges.isEmpty():
            break
        both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        rank = lambda c: F.struct(F.xxhash64(c, F.lit(n)).alias("h"), F.col(c).alias("v"))  # noqa: B023, E731
        least = both.groupBy(F.col("src").alias("node")).agg(F.min(rank("dst")).alias("near")).select("node", F.least(rank("node"), "near")["v"].alias("to"))
        step = pinned(least.join(least.select(F.col("node").alias("to"), F.col("to").alias("next")), "to").select("node", F.col("next").alias("to")))
        steps.append(step)
        ends = edges.join(step.select(F.col("node").alias("src"), F.col("to").alias("s")), "src").join(step.select(F.col("node").alias("dst"), F.col("to").alias("d")), "dst")
        edges = ends.where("s <> d").select(F.least("s", "d").alias("src"), F.greatest("s", "d").alias("dst")).distinct()
    else:
        raise RuntimeError("components did not settle")
    if not steps:
        return links.select(F.col("a").alias("node"), F.col("a").alias("root"))
    roots = steps[-1].withColumnRenamed("to", "root")
    for step in reversed(steps[:-1]):
        later = roots.select(F.col("node").alias("to"), F.col("root"))
        roots = step.join(later, "to", "left").select("node", F.coalesce("root", "to").alias("root"))
    return roots


def verified(pairs: DataFrame, signed: DataFrame, texts: DataFrame, p: NearDup) -> DataFrame:
    """Those of the pairs whose texts are similar: by the signatures' estimate first, then exactly."""
    sig_a, sig_b = (signed.select(F.col("tid").alias(c), F.col("sig").alias(f"sig_{c}")) for c in "ab")
    near = pinned(pairs.join(sig_a, "a").join(sig_b, "b").where(_estimate()("sig_a", "sig_b") >= p.similarity - p.estimate_slack).select("a", "b"))
    wanted = pinned(near.select(F.explode(F.array("a", "b")).alias("tid")).distinct())
    n = wanted.limit(FEW + 1).count()
    own = written(texts.join(F.broadcast(wanted) if n <= FEW else wanted, "tid", "left_semi").groupBy("tid").agg(F.first("t").alias("t"))) if n else texts.limit(0)
    text_a, text_b = (own.select(F.col("tid").alias(c), F.col("t").alias(f"t_{c}")) for c in "ab")
    return pinned(near.join(text_a, "a").join(text_b, "b").where(_verify(p.width)("t_a", "t_b") >= p.similarity).select("a", "b"))


def across(roots: DataFrame, left: DataFrame, signed: DataFrame, texts: DataFrame, p: NearDup) -> DataFrame:
    """The roots (node, root) after the classes of the texts `left` (bucket, tid, class) are joined by all similar pairs over them that share a bucket.

    A bucket's texts are dealt to blocks of bounded bytes and number, and each two blocks make a tile, in which one task compares them; only links leave it.
    """
    left = pinned(left)
    if left.isEmpty():
        return roots
    each = left.groupBy("tid", "class").agg(F.collect_set("bucket").alias("mine"))
    wanted = pinned(left.select("tid").distinct())
    own = written(texts.join(F.broadcast(wanted) if wanted.limit(FEW + 1).count() <= FEW else wanted, "tid", "left_semi").groupBy("tid").agg(F.first("t").alias("t")).join(each, "tid"))
    sizes = left.join(signed.select("tid", "bytes"), "tid").groupBy("bucket").agg(F.ceil(F.greatest(F.count("*") / p.block_texts, F.sum("bytes") / p.block_bytes)).alias("n"))
    dealt = left.join(sizes, "bucket").select("bucket", "tid", "n", F.pmod(F.xxhash64("tid", "bucket"), F.col("n")).alias("block"))
    tiles = dealt.select("bucket", "tid", "block", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("o")).select("bucket", "tid", "block", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"))
    edges = pinned(tiles.join(own, "tid").groupBy("bucket", "i", "j").applyInPandas(_linked(p), "a binary, b binary").distinct())
    later = components(edges).select(F.col("node").alias("root"), F.col("root").alias("to"))
    every = roots.unionByName(left.select(F.col("tid").alias("node"), F.col("class").alias("root"))).distinct()
    return every.join(later, "root", "left").select("node", F.coalesce("to", "root").alias("root"))


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", p: NearDup = NearDup()) -> DataFrame:
    """A row for each document: key, class_id, class_size, tid (its text's digest), root (the digest that all texts of the class share; null for a null text)."""
    tid = F.unhex(F.md5(F.col(text)))
    members = docs.select(F.col(key).alias("key"), tid.alias("tid"), F.octet_length(F.col(text)).alias("bytes"), _sign(p)(F.col(text)).alias("s"))
    members = written(members.select("key", "tid", "bytes", "s.sig", "s.bands"))
    signed = members.where(F.col("sig").isNotNull()).groupBy("tid").agg(F.first("sig").alias("sig"), F.first("bands").alias("bands"), F.max("bytes").alias("bytes"))
    signed = written(signed)
    texts = docs.where(F.col(text).isNotNull()).select(tid.alias("tid"), F.col(text).alias("t"))
    pairs, large = candidates(signed, p)
    roots = components(verified(pairs, signed, texts, p))
    roots = across(roots, unsettled(large, roots), signed, texts, p).select(F.col("node").alias("tid"), "root")
    joined = members.select("key", "tid").join(roots, "tid", "left").select("key", "tid", F.coalesce("root", "tid").alias("root"))
    # only classes of several documents are joined back, and broadcast if they are few, so that a large class needn't meet in one task
    least = pinned(joined.where(F.col("root").isNotNull()).groupBy("root").agg(F.min("key").alias("class_id"), F.count("*").alias("class_size")).where("class_size > 1"))
    out = joined.join(F.broadcast(least) if least.limit(FEW + 1).count() <= FEW else least, "root", "left")
    return out.select(F.col("key").alias(key), F.coalesce("class_id", "key").alias("class_id"), F.coalesce("class_size", F.lit(1)).alias("class_size"), "tid", "root")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", p: NearDup = NearDup()) -> DataFrame:
    """One document of each class, the one with the least id; among rows that repeat it, any."""
    found = classes(docs, key, text, p)
    tid = F.unhex(F.md5(F.col(text)))
    # one (id, text) pair for each class: the least id, and among texts with that id the least digest; a null text stays
    best = found.where(F.col("tid").isNotNull()).groupBy("root").agg(F.min(F.struct(F.col(key).isNull().alias("k"), F.col(key).alias("id"), "tid")).alias("b"))
    own, least, text_of = (f"_{uuid.uuid4().hex}" for _ in range(3))
    best = pinned(best.select(F.col("b.id").alias(least), F.col("b.tid").alias(text_of)))
    out = docs.withColumn(own, tid).join(best, (F.col(own) == F.col(text_of)) & F.col(key).eqNullSafe(F.col(least)), "left_semi").drop(own)
    doubled = found.groupBy(key, "tid").count().where("count > 1").limit(1).count()
    if doubled:
        out = out.dropDuplicates([key, text])
    return out.unionByName(docs.where(F.col(text).isNull()))
