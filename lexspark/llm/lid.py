"""Language identification by compression.

A text is encoded once per language with a Zstandard compressor primed with that
language's raw-content dictionary; the language whose dictionary gives the fewest
bytes wins, and a narrow lead is a rejection.

Defined results: a null text, or one without letters, gets `und`, score 0 and is
rejected; very long texts are encoded whole, block by block, so the dictionary counts
as much at the end as at the start; equal sizes go to the language first in order;
equal texts get equal answers; an empty table gives an empty result. Other columns are
kept, and one named like a result is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspark.llm.common import hashed_share, with_struct

FIELDS = ["lang_pred", "score", "margin", "rejected"]
BLOCK = 4096
#: Bytes that each frame has besides its data.
FRAME = 9
#: A run that ends every dictionary and begins every block: its match makes the encoder write a compressed frame where it would store a few bytes as they are, and so shows which dictionary helps.
RUN = bytes(97 + (7 * i * i + 3 * i) % 26 for i in range(120))


@dataclass(frozen=True)
class LanguageModel:
    langs: tuple[str, ...]
    dictionaries: tuple[bytes, ...]
    level: int = 12
    #: Lead of the best over the second, as a share of the best, below which the answer is rejected.
    reject_below: float = 0.004


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", docs_per_lang: int = 400, snippet: int = 1500, dictionary_bytes: int = 100_000, thin: float = 0.2) -> LanguageModel:
    """Dictionaries from a bounded sample: about `docs_per_lang` documents a language, `snippet` characters from the middle of each, `dictionary_bytes` in all.

    Dictionaries have one common size, so that none wins by its size. Languages with less than the share `thin` of the best filled one's bytes have no say in it and keep all they have.
    """
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    counts = {r[0]: r[1] for r in known.groupBy(lang).count().collect()}
    if not counts:
        return LanguageModel((), ())
    share = F.coalesce(*[F.when(F.col(lang) == k, F.lit(min(1.0, docs_per_lang / n))) for k, n in sorted(counts.items())])
    middle = F.greatest(F.lit(1), (F.length(text) - snippet) / 2).cast("int")
    picked = known.where(hashed_share(F.col(key), share)).select(F.col(lang).alias("lang"), F.substring(F.col(text), middle, F.lit(snippet)).alias("s"))
    found: dict[str, dict[str, None]] = {k: {} for k in counts}
    for r in picked.collect():
        found[r.lang][r.s.lower()] = None
    langs = tuple(sorted(found))
    per = {k: [s.encode() for s in sorted(v)] for k, v in found.items()}
    held = {k: min(dictionary_bytes, sum(map(len, v))) for k, v in per.items()}
    size = min((n for n in held.values() if n and n >= thin * max(held.values())), default=8)
    return LanguageModel(langs, tuple(_fill(per[k], max(size, 8)) for k in langs))


def _fill(parts: list[bytes], size: int) -> bytes:
    """About `size` bytes with an equal share of every sampled document."""
    each = max(1, size // max(1, len(parts)))
    out = b"\n".join(p[:each] for p in parts)[:size]
    return out if len(out) >= 8 else out.ljust(8)


@lru_cache(maxsize=2)
def _compressors(model: LanguageModel):
    import zstandard

    out = []
    for d in model.dictionaries:
        held = zstandard.ZstdCompressionDict(d + RUN, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        held.precompute_compress(level=model.level)
        out.append(zstandard.ZstdCompressor(level=model.level, dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False))
    return out


def sizes(model: LanguageModel, text: str) -> list[int]:
    """Compressed bytes of the whole text under each language's dictionary."""
    data = text.lower().encode("utf-8", "surrogatepass")
    blocks = [RUN + data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]
    return [sum(len(c.compress(b)) for b in blocks) - FRAME * len(blocks) for c in _compressors(model)]


def classify(model: LanguageModel, text: str | None) -> tuple[str, float, float, bool]:
    if not text or not model.langs or not any(map(str.isalpha, text)):
        return "und", 0.0, 0.0, True
    got = sizes(model, text)
    order = sorted(range(len(got)), key=lambda i: (got[i], i))
    best = order[0]
    margin = (got[order[1]] - got[best]) / max(1, got[best]) if len(order) > 1 else 1.0
    score = margin / (margin + 4 * model.reject_below)
    return model.langs[best], score, margin, margin < model.reject_below


def predict(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """Append lang_pred, score (0 to 1), margin and rejected; only the text column goes to Python."""

    @F.arrow_udf("struct<lang_pred string, score double, margin double, rejected boolean>")
    def run(col: pa.Array) -> pa.Array:
        rows = [classify(model, x.as_py()) for x in col]
        kinds = (pa.string(), pa.float64(), pa.float64(), pa.bool_())
        return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], FIELDS)

    return with_struct(docs, "lid", run(F.col(text)), FIELDS)
