"""Fill-in-middle: a text is cut at two line ends, and its middle goes last.

A Split pre-tokenizer of the tokenizers library, which needs no vocabulary and no training,
isolates each match of a pattern (lines with their ends) and gives its place in code
points. A text's row gets the array of these places; its length is the number of units,
and a place looked up by rank is a cut. The ranks come from a digest of a seed and the id,
so they are the same on every run and machine. Everything but the places is in DataFrame
functions; no row meets another, so nothing is shuffled.

Defined results: a null text counts as empty; an empty text, and one that holds a sentinel,
stays plain (nothing could tell its sentinels from ours); so do those whose draw is not
below the rate; a null id draws as an empty one; equal ids have equal draws, so rows that
repeat come out alike; a text without a line end is one unit; very long texts are cut whole;
other columns are kept, and of those that have the name of a new one the new one is kept;
an empty table gives an empty result.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspark.llm.common import with_struct

LINES = r"[^\n]*\n|[^\n]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 7
FIELDS = ["n", "form", "prefix_chars", "middle_chars", "output"]


def unit_ends(text: Column, pattern: str = LINES) -> Column:
    """The ends of the pattern's matches, left to right, in code points; a match is a unit."""

    @F.arrow_udf("array<int>")
    def run(col: pa.Array) -> pa.Array:
        from tokenizers import Regex
        from tokenizers.pre_tokenizers import Split

        split = Split(Regex(pattern), behavior="isolated")
        return pa.array([[stop for _, (_, stop) in split.pre_tokenize_str(x.as_py())] for x in col], pa.list_(pa.int32()))

    return run(text)


def draws(key: Column, seed: int = SEED, n: int = 4) -> list[Column]:
    """`n` numbers below 2**32 from the digest of the seed and a row's key."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint") for i in range(n)]


def transform(docs: DataFrame, key: str = "doc_id", text: str = "text", pattern: str = LINES, rate: int = 100, spm: int = 50, seed: int = SEED) -> DataFrame:
    """Append n, form (plain, psm or spm), prefix_chars, middle_chars and output. Of a hundred texts `rate` are cut, and of a hundred cut ones `spm` have their suffix first."""
    ends, at = (f"_{uuid.uuid4().hex}" for _ in range(2))
    whole = F.coalesce(docs[f"`{text}`"].cast("string"), F.lit(""))
    rows = docs.withColumn(ends, unit_ends(whole, pattern))
    n = F.size(ends).cast("bigint")
    h1, h2, h3, h4 = draws(F.col(f"`{key}`"), seed)
    a, b = h1 % (n + 1), h2 % (n + 1)
    place = lambda rank: F.when(rank > 0, F.get(ends, (rank - 1).cast("int"))).otherwise(0)
    has = lambda mark: F.contains(whole, F.lit(mark))
    plain = (n == 0) | has(PREFIX) | has(SUFFIX) | has(MIDDLE) | (h3 % 100 >= rate)
    form = F.when(plain, "plain").when(h4 % 100 < spm, "spm").otherwise("psm")
    rows = rows.withColumn(at, F.struct(n.alias("n"), form.alias("form"), place(F.least(a, b)).alias("i"), place(F.greatest(a, b)).alias("j")))
    i, j = F.col(f"{at}.i"), F.col(f"{at}.j")
    part = lambda start, length: F.substring(whole, start + 1, length)
    prefix, middle, suffix = part(F.lit(0), i), part(i, j - i), part(j, F.length(whole) - j)
    cut = F.col(f"{at}.form")
    output = (
        F.when(cut == "plain", whole)
        .when(cut == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
        .otherwise(F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
    )
    chars = lambda c: F.when(cut != "plain", c.cast("bigint"))
    made = F.struct(F.col(f"{at}.n").alias("n"), cut.alias("form"), chars(i).alias("prefix_chars"), chars(j - i).alias("middle_chars"), output.alias("output"))
    return with_struct(rows, "fim", made, FIELDS).drop(ends, at)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from, from the output and its form alone. No sentinel can begin inside a text and end in another sentinel, so the first of each is ours."""
    cut = F.split(output, "|".join((PREFIX, SUFFIX, MIDDLE)), 4)
    piece = lambda parts, k: F.get(parts, F.lit(k))
    joined = lambda *at: F.element_at(F.transform(F.array(cut), lambda parts: F.concat(*[piece(parts, k) for k in at])), 1)
    return F.when(form == "psm", joined(1, 3, 2)).when(form == "spm", joined(2, 3, 1)).otherwise(output)
