"""I-Match fingerprints, in DataFrame operations alone.

A term is kept if its document frequency lies in a band (too common terms say nothing, too
rare ones are typing errors). A document's kept terms, distinct and sorted, are hashed once
for each of several randomised subsets of the lexicon. Large subsets change with nearly
any edit, small ones with few; the share of equal subset hashes is the likeness.

The band's lower end bounds the lexicon: at most (mean distinct terms a document) / low
terms can reach it, however large the corpus. So it travels as one array of buckets, and
looking a term up needs no join.

Defined results: a null text counts as empty; a text without kept terms gets a hash of its
terms and is like only an equal one; the next document is the next in order of id, then of
text digest (null ids first), and after the last comes the first; a table of one document
follows itself; ids may be numbers or strings; other columns are kept; very long texts are
read whole; equal texts have equal fingerprints; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import math
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, StringType

BUCKETS = 16384
#: One in so many lexicon terms belongs to a subset; each rate has several subsets, which share no term.
RATES = (32, 64, 128, 256, 512)
PER_RATE = 8
#: What xxhash64 makes of an empty array: its seed.
EMPTY = 42
RANGE_ROWS = 4000
RANGES = 16384


def terms(text: Column) -> Column:
    """64-bit hashes of the distinct lower-case words."""
    words = F.split(F.lower(text), r"[^\p{L}\p{N}]+")
    return F.array_distinct(F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w)))


def lexicon(docs: DataFrame, text: str = "text", low: float = 0.002, high: float = 0.12, least: int = 2) -> DataFrame:
    """One row with one column `lex`: BUCKETS arrays of the term hashes with a document frequency in the band."""
    n = docs.where(F.length(text) > 0).count()
    df = docs.select(F.explode(terms(F.col(text))).alias("h")).groupBy("h").agg(F.count("*").alias("df"))
    kept = df.where((F.col("df") >= max(least, low * n)) & (F.col("df") <= max(high * n, least)))
    held = kept.groupBy(F.pmod("h", F.lit(BUCKETS)).alias("b")).agg(F.sort_array(F.collect_list("h")).alias("hs"))
    every = docs.sparkSession.range(BUCKETS).join(held, F.col("id") == F.col("b"), "left").select("id", F.coalesce("hs", F.array().cast("array<bigint>")).alias("hs"))
    return every.agg(F.transform(F.sort_array(F.collect_list(F.struct("id", "hs"))), lambda x: x["hs"]).alias("lex"))


def lexicon_terms(ts: Column, lex: Column) -> Column:
    """Those of the terms that the lexicon holds, in order."""
    return F.array_sort(F.filter(ts, lambda h: F.array_contains(F.element_at(lex, (F.pmod(h, F.lit(BUCKETS)) + 1).cast("int")), h)))


def _hash_subsets(kept: Column) -> Column:
    """A hash for each randomised subset of the lexicon, EMPTY where it holds none of the terms. Families draw on different bits of the term's hash, none of which chooses its bucket."""

    def one(own: Column, rate: int, shift: int, j: int) -> Column:
        return F.xxhash64(F.filter(own, lambda h: F.shiftright(h, shift).bitwiseAND(F.lit(rate - 1)) == j))

    def family(rate: int, shift: int) -> Column:
        own = F.filter(kept, lambda h: F.shiftright(h, shift).bitwiseAND(F.lit(rate - 1)) < PER_RATE)
        return F.transform(F.array(own), lambda a: F.array(*[one(a, rate, shift, j) for j in range(PER_RATE)]))

    shifts = [14 + sum(r.bit_length() - 1 for r in RATES[:i]) for i in range(len(RATES))]
    return F.flatten(F.flatten(F.array(*map(family, RATES, shifts))))


def likeness(a: Column, b: Column, whole_a: Column, whole_b: Column) -> Column:
    """Equal subset hashes as a share of those that either text has; 1 for equal fingerprints."""
    both = F.zip_with(a, b, lambda x, y: F.when(x != y, 0.0).when(x != EMPTY, 1.0))
    there = F.filter(both, lambda x: x.isNotNull())
    share = F.aggregate(there, F.lit(0.0), lambda s, x: s + x) / F.size(there)
    return F.when(whole_a == whole_b, 1.0).otherwise(F.coalesce(F.when(F.size(there) > 0, share), F.lit(0.0)))


def _name(subsets: Column, ts: Column) -> Column:
    """The fingerprint as text: 8 hex digits a subset, and for a text without kept terms the hash of all its terms."""
    own = F.concat_ws("", F.transform(subsets, lambda x: F.when(x == EMPTY, "-").otherwise(F.lower(F.right(F.lpad(F.hex(x), 16, "0"), F.lit(8))))))
    none = F.forall(subsets, lambda x: x == EMPTY)
    return F.when(none, F.concat(F.lit("t"), F.lower(F.lpad(F.hex(F.xxhash64(F.array_sort(ts))), 16, "0")))).otherwise(own)


def subsets(docs: DataFrame, lex: DataFrame, text: str, name: str) -> DataFrame:
    """Append `name`, the subset hashes of the text. `lex` is one row, read as a scalar subquery."""
    view = f"lex_{uuid.uuid4().hex}"
    lex.createOrReplaceTempView(view)
    held, kept = (f"_{uuid.uuid4().hex}" for _ in range(2))
    # the optimiser folds the lexicon into its one use, so no row carries it
    got = docs.withColumn(held, F.expr(f"(select lex from {view})"))
    got = got.withColumn(kept, lexicon_terms(_terms_of(text), F.col(held))).drop(held)
    return got.withColumn(name, _hash_subsets(F.col(kept))).drop(kept)


def _terms_of(text: str) -> Column:
    return terms(F.coalesce(F.col(text), F.lit("")))


def named(subs: str, text: str) -> Column:
    """The fingerprint of a text with the given subset hashes."""
    return _name(F.col(subs), _terms_of(text))


def fingerprint(docs: DataFrame, lex: DataFrame, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """Append the fingerprint and `<name>_subsets`, its array of hashes."""
    return subsets(docs, lex, text, f"{name}_subsets").withColumn(name, named(f"{name}_subsets", text))


def _number(docs: DataFrame, key: str) -> Column:
    """A value that rises (not always strictly) with the key, least for null: integers and strings as they are, and the double of what else."""
    kind, k = docs.schema[key].dataType, F.col(f"`{key}`")
    if isinstance(kind, IntegralType):
        return F.coalesce(k.cast("bigint"), F.lit(-(2**63)))
    if isinstance(kind, StringType):
        return F.coalesce(k, F.lit(""))
    return F.coalesce(k.cast("double"), F.lit(float("-inf")))


def _cuts(kept: DataFrame, parts: int) -> list:
    """About parts - 1 values that part the rows evenly: by an approximate quantile sketch of numbers, and of strings from those of `parts` x 10 rows with the least hashes."""
    if isinstance(kept.schema["k"].dataType, StringType):
        drawn = sorted(r.k for r in kept.select("k", F.xxhash64("k", F.monotonically_increasing_id()).alias("h")).orderBy("h").limit(10 * parts).collect())
        return sorted({drawn[i * len(drawn) // parts] for i in range(1, parts)}, key=lambda x: x.encode())
    return sorted(set(kept.select(F.percentile_approx("k", [i / parts for i in range(1, parts)], 10 * parts)).first()[0]))


def _range_of(docs: DataFrame, key: str) -> Column:
    """The number of a row's range of keys, found in two steps through equal groups of cuts. Ranges hold about RANGE_ROWS rows; beyond RANGES of them they grow."""
    k = _number(docs, key)
    kept = docs.select(k.alias("k"))
    parts = min(RANGES, kept.count() // RANGE_ROWS)
    if parts < 2:
        return F.lit(0)
    cuts = _cuts(kept, parts)
    width = math.isqrt(len(cuts) - 1) + 1
    groups = [cuts[i : i + width] for i in range(0, len(cuts), width)]
    kind = kept.schema["k"].dataType.simpleString()
    # one constant is read much faster than arrays are built of literals
    array = lambda xs, t: F.from_json(F.lit(json.dumps(xs)), t)
    count = lambda xs: F.size(F.filter(xs, lambda b: b < k))
    coarse = F.greatest(count(array([g[0] for g in groups], f"array<{kind}>")) - 1, F.lit(0))
    return coarse * width + count(F.element_at(array(groups, f"array<array<{kind}>>"), coarse + 1))


def with_next(docs: DataFrame, key: str, text: str, derive) -> DataFrame:
    """Append what `derive` adds to a row, and next_<column> of it and of the text: the following row's in order of key.

    Rows are dealt to ranges of the key, so no task holds all. Each range also gets a copy of the first row of the next range that has any, and ends in it. Only one row's number and key a range meet in one task.
    """
    mark = uuid.uuid4().hex[:8]
    part, tie, last, nxt = (f"_{n}_{mark}" for n in ("range", "tie", "last", "next"))
    dealt = docs.withColumn(part, _range_of(docs, key))
    firsts = dealt.groupBy(part).agg(F.min(F.struct(F.col(key).alias("k")))["k"].alias("first"))
    ring = Window.partitionBy(F.lit(0)).orderBy(part)
    whole = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    firsts = firsts.select(F.col(part).alias("own"), "first", F.coalesce(F.lag(part).over(ring), F.last(part).over(whole)).alias("before"))
    # at most RANGES + 1 rows
    lead = dealt.join(F.broadcast(firsts), (F.col(part) == F.col("own")) & F.col(key).eqNullSafe(F.col("first")))
    lead = lead.groupBy(F.col("before").alias(part)).agg(F.min_by(text, F.xxhash64(text)).alias(text))
    full = derive(dealt.withColumn(tie, F.xxhash64(text)).withColumn(last, F.lit(False)))
    own = [text, *(c for c in full.columns if c not in (*dealt.columns, tie, last))]
    full = full.unionByName(derive(lead).withColumn(last, F.lit(True)), allowMissingColumns=True)
    order = Window.partitionBy(part).orderBy(last, F.col(key).asc_nulls_first(), tie)
    out = full.withColumn(nxt, F.lead(F.struct(*own)).over(order)).where(~F.col(last))
    return out.select(*docs.columns, *own[1:], *[F.col(f"{nxt}.{c}").alias(f"next_{c}") for c in own])
