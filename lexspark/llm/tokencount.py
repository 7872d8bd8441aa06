"""Token counts over a cache of digests.

A count is stored under two digests: that of the text, as normalised, and that of the
tokenizer, which covers its file, its library's version and how it is called. Documents
meet the cache by digest; only digests that it lacks are encoded, each once however many
documents have the text, and what was counted is appended. A job that dies leaves the
cache as it was or with whole rows more, and the next one encodes only the rest.

Texts are shuffled once at most, when misses are many, and copies are merged ahead of that.
Few misses (a bounded number, counted first) are broadcast instead, and no text moves. What
is joined with documents are digests, so of a text that a third of them share only short
rows meet in one key, which adaptive execution splits.

Normalisation is a parameter: what it maps to one string is counted as that string. The
default makes a null an empty text and changes nothing else, as the library counts any
other change.

Defined results: null and empty texts have no tokens; texts that repeat and ids that repeat
or are null have each their row; the names of special tokens inside a text count as the
library takes them by default; very long texts are encoded whole; other columns are kept,
and of those that have the name of a new one the new one is kept; an empty table gives an
empty result and appends nothing.
"""

from __future__ import annotations

import hashlib
import os
import uuid
from functools import lru_cache

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark.llm.common import borrowed, with_struct

LIMIT = 1024
#: Misses up to which their digests (32 bytes each) are broadcast and texts stay where they are.
FEW_MISSES = 100_000
#: Bytes of text that a task hands to the tokenizer at a time.
SLICE_BYTES = 1 << 20
FIELDS = ["n_bytes", "n_tokens", "over_limit"]
SCHEMA = "digest binary, n_tokens bigint"


def default_tokenizer() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


@lru_cache(maxsize=2)
def counter(path: str):
    """A function from a list of texts to their numbers of tokens, by the library for the kind of file; nothing is added, cut or padded."""
    if path.endswith(".model"):
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in pieces.encode(texts, num_threads=1)]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    held = Tokenizer.from_file(path)
    held.no_truncation()
    held.no_padding()
    return lambda texts: [len(x) for x in held.encode_batch_fast(texts, add_special_tokens=False)]


def version_digest(path: str) -> str:
    """What counts depend on besides the text: the file, the library's version and the way it is called."""
    if path.endswith(".model"):
        import sentencepiece as library
    else:
        import tokenizers as library
    with open(path, "rb") as f:
        return hashlib.sha256(f"{library.__name__} {library.__version__} plain ".encode() + f.read()).hexdigest()


def plain(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def stored(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """The cache's counts of one tokenizer, each digest once, also where two jobs appended it; none if there is no cache yet."""
    try:
        rows = spark.read.schema(SCHEMA).parquet(f"{cache.rstrip('/')}/version={version}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], SCHEMA)
    return rows.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def encoded(texts: DataFrame, path: str) -> DataFrame:
    """(digest, text) to (digest, n_tokens), a slice of bounded bytes at a time."""

    def run(batches):
        count = counter(path)
        for b in batches:
            found, held, size = [], [], 0
            for x in b.column(1):
                held.append(x.as_py())
                size += len(held[-1])
                if size >= SLICE_BYTES:
                    found += count(held)
                    held, size = [], 0
            found += count(held) if held else []
            yield pa.record_batch([b.column(0), pa.array(found, pa.int64())], names=["digest", "n_tokens"])

    return texts.select("digest", "text").mapInArrow(run, SCHEMA)


def fill(docs: DataFrame, cache: str, text: str = "text", tokenizer: str | None = None, normal=plain, few: int = FEW_MISSES) -> None:
    """Encode the texts that the cache lacks, each once, and append their counts."""
    path = tokenizer or default_tokenizer()
    version, spark = version_digest(path), docs.sparkSession
    whole = normal(docs[f"`{text}`"])
    lacking = docs.select(digest(whole).alias("digest")).distinct().join(stored(spark, cache, version).select("digest"), "digest", "left_anti")
    with borrowed(lacking) as misses:
        n = misses.limit(few + 1).count()
        if not n:
            return
        texts = docs.select(digest(whole).alias("digest"), whole.alias("text"))
        one = lambda rows: rows.groupBy("digest").agg(F.first("text").alias("text"))
        asked = one(texts.join(F.broadcast(misses), "digest", "left_semi")) if n <= few else one(texts).join(misses, "digest", "left_semi")
        encoded(asked, path).write.mode("append").parquet(f"{cache.rstrip('/')}/version={version}")


def counts(docs: DataFrame, cache: str, text: str = "text", tokenizer: str | None = None, limit: int = LIMIT, normal=plain, few: int = FEW_MISSES) -> DataFrame:
    """Append n_bytes (UTF-8), n_tokens and over_limit; the cache holds every text's count afterwards."""
    path = tokenizer or default_tokenizer()
    fill(docs, cache, text, path, normal, few)
    key, found, n = (f"_{uuid.uuid4().hex}" for _ in range(3))
    whole = normal(docs[f"`{text}`"])
    held = stored(docs.sparkSession, cache, version_digest(path)).withColumnsRenamed({"digest": found, "n_tokens": n})
    rows = docs.withColumn(key, digest(whole)).join(held, F.col(key) == F.col(found), "left")
    made = F.struct(F.octet_length(normal(F.col(f"`{text}`"))).cast("bigint").alias("n_bytes"), F.col(n).alias("n_tokens"), (F.col(n) > limit).alias("over_limit"))
    return with_struct(rows, "counts", made, FIELDS).drop(key, found, n)
