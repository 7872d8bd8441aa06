"""Models outside the engine: embedder, generator, judge, reranker, query rewriter.

Each is a callable made by a factory inside the worker, so a model loads once a process.
The offline stand-ins are deterministic and make no claim of quality.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspark.functions import text as X
from lexspark.sources import cache
from lexspark.tables import shared_dir, stored


class HashEmbedder:
    """Character bigrams hashed into a unit vector."""

    def __init__(self, dim: int = 64, prefix: str = ""):
        self.dim, self.prefix = dim, prefix

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), np.float32)
        for i, t in enumerate(texts):
            s = re.sub(r"\s+", "", self.prefix + (t or ""))
            for a in range(len(s) - 1):
                h = int.from_bytes(hashlib.blake2b(s[a : a + 2].encode(), digest_size=8).digest(), "little")
                out[i, h % self.dim] += 1 if h >> 40 & 1 else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm == 0, 1, norm)


@lru_cache(maxsize=4)
def _made(factory: Callable, *args):
    return factory(*args)


def embedded(df: DataFrame, text: str = "text", name: str = "embedding", factory: Callable = HashEmbedder, args: tuple = ()) -> DataFrame:
    """Append unit vectors of a text column, a batch at a time."""

    @F.arrow_udf("array<float>")
    def run(col: pa.Array) -> pa.Array:
        got = _made(factory, *args)([x.as_py() or "" for x in col])
        return pa.array(list(np.asarray(got, np.float32)), pa.list_(pa.float32()))

    return df.withColumn(name, run(F.col(text)))


def rescored(df: DataFrame, question: str, text: str, factory: Callable, name: str = "rescore") -> DataFrame:
    """Append a cross encoder's score of (question, text)."""

    @F.arrow_udf("double")
    def run(q: pa.Array, t: pa.Array) -> pa.Array:
        return pa.array([float(x) for x in _made(factory)(list(zip(q.to_pylist(), t.to_pylist(), strict=True)))], pa.float64())

    return df.withColumn(name, run(F.col(question), F.col(text)))


def overlap_reranker() -> Callable:
    """Stands in for a cross encoder: shared bigrams."""
    grams = lambda s: {s[i : i + 2] for i in range(len(s) - 1)}
    return lambda pairs: [len(grams(q) & grams(t)) for q, t in pairs]


NOT_CALLED = "not called: too many failures before"
CAPPED = "not called: the cap on calls is reached"


def whole_json(response: str) -> None:
    """A check for `called`: the response must hold a whole JSON object between its outermost braces, so that one cut short is asked for again."""
    json.loads(response[response.index("{") : response.rindex("}") + 1])


def called(jobs: DataFrame, factory: Callable, key: list[str], prompt: str = "prompt", kind: str = "string", tries: int = 1, most_errors: int | None = None, check: Callable[[str], object] | None = None, stop: str | None = None) -> DataFrame:
    """Rows (key, response, error) of an external call for each job; an exception, also one that `check` raises for the response, becomes the row's error, not the job's end. A call is tried `tries` times; after `most_errors` failed rows a task makes no further calls. `stop` is a file in a folder that all machines share: the first failure makes it, and where it is no task begins another call; rows that are done stay. It is a plan: each job that reads it calls again, so `stored` or `called_once` comes first."""
    kinds = dict(jobs.dtypes)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call, failed = _made(factory), 0
        for f in frames:
            answers, errors = [], []
            for p in f[prompt]:
                answer, error = None, NOT_CALLED
                down = most_errors is not None and failed >= most_errors or stop is not None and _marked(stop)
                for _ in range(0 if down else tries):
                    try:
                        answer, error = call(p), None
                        if check is not None:
                            check(answer)
                        break
                    except Exception as e:  # noqa: BLE001  any failure of a service is a row's failure
                        answer = None
                        error = f"{type(e).__name__}: {e}"
                failed += error is not None
                if stop is not None and error is not None and not down:
                    _mark(stop)
                answers.append(answer)
                errors.append(error)
            yield f[key].assign(response=answers, error=errors)

    return jobs.select(*key, prompt).mapInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in key) + f", response {kind}, error string")


def _place(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if re.match(r"[a-z0-9]+:/", path) else (fs.LocalFileSystem(), path)


def _marked(path: str) -> bool:
    from pyarrow import fs

    system, at = _place(path)
    return system.get_file_info(at).type == fs.FileType.File


def _mark(path: str) -> None:
    system, at = _place(path)
    system.open_output_stream(at).close()


class BudgetError(RuntimeError):
    pass


#: Shares of the jobs after which errors and spending are looked at: a service that is down, or a budget too small, is seen after a hundredth.
WAVES = (0.01, 0.1, 1.0)


def called_once(jobs: DataFrame, factory: Callable, key: list[str], prompt: str = "prompt", most_errors: int | None = None, budget: float | None = None, price: float = 0.0, max_calls: int | None = None, stop_at_failure: bool = False, **options) -> DataFrame:
    """`called`, stored, so that each job is called once however often the result is read. With `most_errors` or a `budget` (of `price` a character of prompts and responses) the jobs go in growing waves by a hash of their key: after `most_errors` failures the rest isn't called, and once the spending has reached the budget it is an error. `max_calls` caps the jobs that are called in the whole run, chosen by a hash of their key; with `stop_at_failure` no task begins a call after any task's first failure."""
    if stop_at_failure:
        options |= {"stop": f"{shared_dir(jobs.sparkSession).rstrip('/')}/stop-{uuid.uuid4().hex}"}
    if max_calls is not None:
        # a limit leaves one partition, so the calls are dealt out again
        own = stored(jobs.orderBy(F.xxhash64(*key), *key).limit(max_calls)).repartition(jobs.sparkSession.sparkContext.defaultParallelism, *key)
        made = called_once(own, factory, key, prompt, most_errors, budget, price, **options)
        rest = jobs.join(own.select(*key), key, "left_anti").select(*key, F.lit(None).cast(made.schema["response"].dataType).alias("response"), F.lit(CAPPED).alias("error"))
        return made.unionByName(rest)
    if most_errors is None and budget is None:
        return stored(called(jobs, factory, key, prompt, **options))
    place = F.pmod(F.xxhash64(*key), F.lit(1000))
    out, failed, spent, below = None, 0, 0.0, 0
    for share in WAVES:
        own = jobs.where((place >= below) & (place < int(1000 * share)))
        below = int(1000 * share)
        if budget is not None and spent >= budget and not own.isEmpty():
            raise BudgetError(f"spent {spent:.2f} of {budget:.2f}")
        if most_errors is not None and failed >= most_errors:
            wave = called(own, factory, key, prompt, **options | {"most_errors": 0})
        else:
            wave = stored(called(own, factory, key, prompt, most_errors=most_errors, **options))
            cost = F.sum(F.length(prompt) + F.coalesce(F.length("response"), F.lit(0)))
            seen = wave.join(own.select(*key, prompt), key).agg(F.count_if(F.col("error").isNotNull()), cost).first()
            failed, spent = failed + seen[0], spent + price * (seen[1] or 0)
        out = wave if out is None else out.unionByName(wave)
    return out


def cached_calls(jobs: DataFrame, held: DataFrame, factory: Callable, prompt: str = "prompt", budget: float | None = None, price: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """(answers, fresh): jobs (id, prompt) answered from the cache (key, response) or by a call, made once. The prompts' cost is checked before any call is made, and what is spent while they are."""
    keyed = jobs.withColumn("key", X.request_hash(F.col(prompt)))
    todo = keyed.join(held.select("key"), "key", "left_anti").dropDuplicates(["key"])
    if budget is not None and (spend := (todo.agg(F.sum(F.length(prompt)) * price).first()[0] or 0)) > budget:
        raise BudgetError(f"the calls would cost {spend:.2f}, the budget is {budget:.2f}")
    fresh = called_once(todo, factory, ["key"], prompt, budget=budget, price=price)
    every = held.select("key", "response").unionByName(fresh.where("error is null").select("key", "response"))
    found = cache.looked_up(keyed, every).join(fresh.select("key", "error"), "key", "left")
    return found.select("id", "key", "response", "error"), fresh


def quoting_generator() -> Callable[[str], str]:
    """Stands in for a generator: cites the first block, or declines when there is none."""

    def answer(prompt: str) -> str:
        m = re.search(r"\[S(\d+)\][^\n]*\n(?:시행 상태[^\n]*\n)?([^\n]*)", prompt)
        return f"{m[2]}입니다. [S{m[1]}]" if m else "[정보 부족] 근거가 없습니다."

    return answer


def literal_judge() -> Callable[[str], str]:
    """Stands in for a judge: a key point is met if the answer holds it. The prompt is JSON with `answer` and `key_points`."""

    def judge(prompt: str) -> str:
        p = json.loads(prompt)
        flat = re.sub(r"\s+", "", p["answer"] or "")
        points = [{"index": i, "key_point": k, "asserted": re.sub(r"\s+", "", k) in flat, "quote": ""} for i, k in enumerate(p["key_points"], 1)]
        return "verdict: " + json.dumps({"key_points": points, "temporal_error": False}, ensure_ascii=False)

    return judge


def grounding_judge() -> Callable[[str], str]:
    """Stands in for a judge of grounding: a sentence of the answer is supported if the context holds it. The prompt is JSON with `answer` and `context`."""

    def judge(prompt: str) -> str:
        p = json.loads(prompt)
        flat = lambda s: re.sub(r"\s+|\[S\d+\]|[.!?]", "", s or "")
        held = flat(p["context"])
        claims = [s.strip() for s in re.split(r"(?<=[.!?])\s+", p["answer"] or "") if flat(s)]
        return json.dumps({"claims": [{"index": i, "claim": c, "supported": flat(c) in held} for i, c in enumerate(claims, 1)]}, ensure_ascii=False)

    return judge


def split_rewriter(questions: DataFrame) -> DataFrame:
    """Stands in for a rewriter: the clauses of a question of several as questions of their own (query_id, n, question)."""
    parts = F.filter(F.split("question", r"[,;?]\s*"), lambda x: F.length(x) > 1)
    return questions.select("query_id", F.posexplode(parts).alias("n", "question"))
