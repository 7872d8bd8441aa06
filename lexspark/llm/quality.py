"""Document quality by co-training.

Two views of a document, its text and its metadata, each train a calibrated logistic
classifier on the labelled rows. In each round every view labels those of all unlabelled
rows that it is surest of and that the other wasn't told yet, and hands them to the other
view's training set; how sure it must be is measured on labelled rows it never saw. At the end both views are
calibrated on rows that neither saw, and a small logistic model of their log-odds scores
every document.

Defined results: a null text counts as empty; an empty or wordless text is scored by what
the views make of it and never crashes; null metadata is a value of its own; very long
texts are read whole; equal rows score equally; missing metadata columns count as null; an
empty table gives an empty result; without labels of both kinds every document scores 0.5
and is accepted. Other columns are kept, and one named like a result is replaced.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexspark.llm.common import borrowed, hashed_share, held_out, mix, with_struct, word_hashes

FIELDS = ["score", "text_score", "metadata_score", "accepted"]
N_TEXT, N_META = 256 + 14, 64 + 16 + 18


def text_view(text: str | None) -> np.ndarray:
    """Byte shares (square roots) and figures of repetition, shape and punctuation."""
    out = np.zeros(N_TEXT, np.float32)
    data = (text or "").encode("utf-8", "surrogatepass")
    if not data:
        return out
    raw = np.frombuffer(data, np.uint8)
    share = np.bincount(raw, minlength=256) / len(raw)
    out[:256] = np.sqrt(share)
    h, starts = word_hashes(data)
    n = len(h)
    upper, letters = share[65:91].sum(), share[65:91].sum() + share[97:123].sum() + share[128:].sum()
    figures = [np.log1p(n) / 10, upper / max(letters, 1e-9), letters, share[48:58].sum(), share[10], share[32]]
    if n:
        _, count = np.unique(h, return_counts=True)
        figures += [len(count) / n, count.max() / n, (count * (count - 1.0)).sum() / max(1, n * (n - 1.0)), len(raw) / n / 20]
        if n > 1:
            pair = mix(h[1:] * np.uint64(31) + h[:-1])
            figures += [(h[1:] == h[:-1]).mean(), len(np.unique(pair)) / (n - 1)]
    lines = [x for x in data.split(b"\n") if x.strip()]
    out[256 : 256 + len(figures)] = figures
    out[256 + 12] = 1 - len(set(lines)) / len(lines) if lines else 0
    out[256 + 13] = sum(len(x) for x in lines) / max(1, len(lines)) / 1000
    return out


def metadata_view(source, lang, n_chars) -> np.ndarray:
    """Hashed one-hot source and language, and the length's power of two."""
    out = np.zeros(N_META, np.float32)
    out[zlib.crc32(str(source).encode()) % 64] = 1
    out[64 + zlib.crc32(str(lang).encode()) % 16] = 1
    out[80 + (min(17, max(0, int(n_chars)).bit_length()) if n_chars is not None else 0)] = 1
    return out


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, l2: float = 1.0, steps: int = 12) -> np.ndarray:
    """Ridge logistic regression by Newton's method; the last weight is the intercept."""
    x = np.hstack([x, np.ones((len(x), 1))]).astype(float)
    w, c = np.zeros(x.shape[1]), np.ones(len(y)) if weight is None else weight
    pull = np.full(x.shape[1], l2)
    pull[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (c * p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(pull), x.T @ (c * (y - p)) - pull * w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w


def logit(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.clip(x @ w[:-1] + w[-1], -30, 30)


def sure(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-z))


@dataclass
class QualityModel:
    text: np.ndarray | None = None
    metadata: np.ndarray | None = None
    #: Intercept and slopes over the two calibrated log-odds.
    calibration: list = field(default_factory=list)
    stack: np.ndarray | None = None
    #: Score from which a document is accepted: it goes only where bad is three times likelier than good.
    threshold: float = 0.25
    #: Pseudo-labels of each round, all and as (those told the text view, those told the metadata view).
    rounds: list = field(default_factory=list)
    exchanged: list = field(default_factory=list)

    def scores(self, t: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self.text is None:
            half = np.full(len(t), 0.5)
            return half, half, half
        z = [logit(c, logit(w, x)[:, None]) for c, w, x in zip(self.calibration, (self.text, self.metadata), (t, m), strict=True)]
        return sure(logit(self.stack, np.stack(z, 1))), sure(z[0]), sure(z[1])


@dataclass
class Question:
    """What a round asks of the unlabelled rows: each view's weights, calibration and bars (for bad, for good), how many of each kind to name, and the rows that each view was told about."""

    weights: list
    calibration: list
    bars: list
    quota: tuple[int, int]
    taken: list

    def wanted(self, t: np.ndarray, m: np.ndarray, ids: np.ndarray) -> Iterator[tuple[int, int, float, int]]:
        """(view, kind, confidence, id) of these rows' surest, no more than the quota of each view and kind; equal rows have one id and count once."""
        for v, x in enumerate((t, m)):
            p = sure(logit(self.calibration[v], logit(self.weights[v], x)[:, None]))
            new = ~np.isin(ids, self.taken[1 - v])
            for kind in (0, 1):
                c = np.round(p if kind else 1 - p, 9)
                at = np.flatnonzero(new & (c >= self.bars[v][kind]))
                _, first = np.unique(ids[at], return_index=True)
                at = at[first]
                for i in at[np.lexsort((ids[at], -c[at]))][: self.quota[kind]].tolist():
                    yield v, kind, float(c[i]), int(ids[i])


def bar(p: np.ndarray, y: np.ndarray, kind: int, confident: float) -> float:
    """The least confidence from which on rows that the view never saw are of the kind with probability `confident`; more than 1 if there is none."""
    c = p if kind else 1 - p
    order = np.argsort(-c, kind="stable")
    right = np.cumsum(y[order] == kind)
    n = np.arange(1, len(c) + 1)
    good = np.flatnonzero((right + 1) / (n + 2) >= confident)
    return float(c[order][good[-1]]) if len(good) else 2.0


def co_train(t: np.ndarray, m: np.ndarray, y: np.ndarray, ask: Callable[[Question], list[tuple[int, int, int, np.ndarray, np.ndarray]]] | None, rounds: int = 4, most: int = 300, confident: float = 0.85) -> QualityModel:
    """Train on rows with y. `ask` answers a round's question about the unlabelled rows with (view, kind, id, text row, metadata row) of those that the view is surest of; the other view learns from them. Every third labelled row is kept for calibration and never trained on."""
    if not len(y) or y.min() == y.max() or len(y) < 12:
        return QualityModel()
    held = np.arange(len(y)) % 3 == 2
    if y[held].min() == y[held].max():
        return QualityModel()
    base = y[~held]
    views = (t, m)
    told: list[list[tuple[int, int, np.ndarray]]] = [[], []]  # (id, kind, row) that each view was told
    log: list[tuple[int, int]] = []
    quota = (max(1, int(most * (1 - base.mean()))), max(1, int(most * base.mean())))
    for step in range(rounds + 1):
        fitted, calibration, bars = [], [], []
        for v in (0, 1):
            own = sorted(told[v], key=lambda r: r[0])
            x = np.vstack([views[v][~held], *[r[2][None] for r in own]])
            fitted.append(logistic(x, np.append(base, [r[1] for r in own]), np.append(np.ones(len(base)), np.full(len(own), 0.5))))
            z = logit(fitted[v], views[v][held])[:, None]
            calibration.append(logistic(z, y[held], l2=0.1))
            p = sure(logit(calibration[v], z))
            bars.append((bar(p, y[held], 0, confident), bar(p, y[held], 1, confident)))
        if step == rounds or ask is None:
            break
        answer = ask(Question(fitted, calibration, bars, quota, [np.array([r[0] for r in told[v]], np.int64) for v in (0, 1)]))
        for v, kind, id_, t_row, m_row in answer:
            told[1 - v].append((id_, kind, m_row if v == 0 else t_row))
        log.append((sum(a[0] == 1 for a in answer), sum(a[0] == 0 for a in answer)))
        if not answer:
            break
    z = np.stack([logit(c, logit(fitted[v], views[v][held])[:, None]) for v, c in enumerate(calibration)], 1)
    return QualityModel(fitted[0], fitted[1], calibration, logistic(z, y[held], l2=0.5), rounds=[a + b for a, b in log], exchanged=log)


def surest(found: DataFrame, quota: tuple[int, int]) -> DataFrame:
    """The quota's surest rows of each view and kind, with their place."""
    place = F.row_number().over(Window.partitionBy("view", "kind").orderBy(F.desc("confidence"), "rid"))
    # the bound that holds for both kinds is a literal, so Spark ranks within each partition before the shuffle
    return found.withColumn("place", place).where((F.col("place") <= max(quota)) & (F.col("place") <= F.when(F.col("kind") == 0, quota[0]).otherwise(quota[1])))


def asked_of(rows: DataFrame) -> Callable[[Question], list[tuple[int, int, int, np.ndarray, np.ndarray]]]:
    """Answers from all rows (rid, t, m): each batch names its surest, and the surest of all are ranked by view and kind."""

    def ask(q: Question) -> list[tuple[int, int, int, np.ndarray, np.ndarray]]:
        def run(batches):
            for batch in batches:
                t, m = (_matrix([x.as_py() for x in batch[c]], c) for c in "tm")
                found = list(q.wanted(t, m, np.array(batch["rid"].to_pylist(), np.int64)))
                columns = [pa.array([f[i] for f in found], k) for i, k in enumerate((pa.int32(), pa.int32(), pa.float64(), pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["view", "kind", "confidence", "rid"])

        found = rows.select("rid", "t", "m").mapInArrow(run, "view int, kind int, confidence double, rid bigint").distinct()
        best = surest(found, q.quota).collect()
        if not best:
            return []
        wanted = sorted({r.rid for r in best})
        of = {r.rid: (_matrix([r.t], "t")[0], _matrix([r.m], "m")[0]) for r in rows.where(F.col("rid").isin(wanted)).select("rid", "t", "m").dropDuplicates(["rid"]).collect()}
        return [(r.view, r.kind, r.rid, *of[r.rid]) for r in sorted(best, key=lambda r: (r.view, r.kind, r.place))]

    return ask


#: How the views of a row are kept: half floats for the text's figures, bytes for the metadata's zeros and ones.
KEPT = {"t": (np.float16, N_TEXT), "m": (np.uint8, N_META)}


def _matrix(rows: list[bytes], view: str) -> np.ndarray:
    kind, n = KEPT[view]
    return np.frombuffer(b"".join(rows), kind).reshape(-1, n).astype(float)


def _columns(docs: DataFrame, names: tuple[str, str, str]):
    return [F.col(f"`{c}`") if c in docs.columns else F.lit(None).cast("string") for c in names]


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text", metadata: tuple[str, str, str] = ("source", "lang", "n_chars"), max_labelled: int = 6000, **options) -> QualityModel:
    """Fit on about `max_labelled` labelled documents, chosen by a hash of the id, and on all unlabelled ones, which are written once as vectors and removed at the end; held-out ids are left out."""

    @F.arrow_udf("struct<t: binary, m: binary>")
    def views(text: pa.Array, source: pa.Array, lang: pa.Array, n: pa.Array) -> pa.Array:
        t = [text_view(x.as_py()).astype(KEPT["t"][0]).tobytes() for x in text]
        m = [metadata_view(*(x.as_py() for x in row)).astype(KEPT["m"][0]).tobytes() for row in zip(source, lang, n, strict=True)]
        return pa.StructArray.from_arrays([pa.array(t, pa.binary()), pa.array(m, pa.binary())], ["t", "m"])

    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out(F.col(key))).groupBy(F.col(key).alias("key")).agg(F.max(label).cast("int").alias("y"))
    share = min(1.0, max_labelled / max(1, known.count()))
    own = docs.where(F.col(key).isNotNull() & ~held_out(F.col(key)))
    own = own.select(F.col(key).alias("key"), views(F.col(text), *_columns(docs, metadata)).alias("v")).select("key", "v.*")
    with borrowed(own.join(known, "key", "left").select("key", "y", F.xxhash64("t", "m").alias("rid"), "t", "m")) as rows:
        have = rows.where(F.col("y").isNotNull() & hashed_share(F.col("key"), share)).select("y", "rid", "t", "m").collect()
        have.sort(key=lambda r: (zlib.crc32(r.t + r.m), r.y))
        return co_train(_matrix([r.t for r in have], "t"), _matrix([r.m for r in have], "m"), np.array([r.y for r in have], float), asked_of(rows.where(F.col("y").isNull())), **options)


def score(docs: DataFrame, model: QualityModel, text: str = "text", metadata: tuple[str, str, str] = ("source", "lang", "n_chars")) -> DataFrame:
    """Append score, text_score, metadata_score (0 to 1) and accepted."""

    @F.arrow_udf("struct<score: double, text_score: double, metadata_score: double, accepted: boolean>")
    def run(text: pa.Array, source: pa.Array, lang: pa.Array, n: pa.Array) -> pa.Array:
        parts = []
        for a in range(0, len(text), 512):
            t = np.array([text_view(x.as_py()) for x in text[a : a + 512]], float)
            m = np.array([metadata_view(*(x.as_py() for x in row)) for row in zip(source[a : a + 512], lang[a : a + 512], n[a : a + 512], strict=True)], float)
            parts.append(np.stack(model.scores(t, m), 1))
        s = np.round(np.concatenate(parts), 12) if parts else np.empty((0, 3))  # a product's last digits depend on a row's place in the batch; equal rows are to have equal scores
        return pa.StructArray.from_arrays([*(pa.array(np.ascontiguousarray(s[:, i])) for i in range(3)), pa.array(s[:, 0] >= model.threshold)], FIELDS)

    return with_struct(docs, "quality", run(F.col(text), *_columns(docs, metadata)), FIELDS)
