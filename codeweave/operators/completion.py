"""Model boundary: batch chat completion with a content-addressed cache.

Design for scale and retries:

* every prompt gets ``prompt_key = sha256(model, role/content pairs)``;
* only *distinct* keys that are *not yet cached* reach the model
  (``dropDuplicates`` + ``left_anti`` against the cache table);
* ``repartition(concurrency)`` bounds how many tasks call the endpoint at
  once; each task sends Arrow batches through ``mapInPandas``;
* answers are appended to the cache table (or materialised in the shared
  checkpoint folder) before they are joined back, so later actions never call
  the model twice, and a retried task reproduces the same key.

The model itself is a user-supplied ``chat_fn(list_of_messages) -> list[str]``;
tests use a deterministic stub.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeweave.session import cut_lineage, read_if_there

ChatFn = Callable[[list], list]
ANSWER_SCHEMA = "prompt_key string, content string, error string"


def prompt_key(messages: str | Column = "messages", model: str = "", index: Column | None = None) -> Column:
    """sha256 over model, role/content pairs and (for n > 1) the completion index."""
    m = F.col(messages) if isinstance(messages, str) else messages
    pairs = F.transform(m, lambda x: F.concat(x["role"], F.lit("\x1e"), x["content"]))
    parts = [F.lit(model), F.array_join(pairs, "\x1f")]
    if index is not None:
        parts.append(index.cast("string"))
    return F.sha2(F.concat_ws("\x1f", *parts), 256)


def with_prompt_key(df: DataFrame, model: str = "", n: int = 1) -> DataFrame:
    """Key every row; with ``n`` > 1 each row becomes n rows (``completion_index``), each its own key."""
    if n <= 1:
        return df.withColumn("prompt_key", prompt_key("messages", model))
    df = df.withColumn("completion_index", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return df.withColumn("prompt_key", prompt_key("messages", model, F.col("completion_index")))


def cache_misses(prompts: DataFrame, cache: DataFrame | None) -> DataFrame:
    """Distinct prompts that still need an answer (one row per key)."""
    todo = prompts.dropDuplicates(["prompt_key"])
    if cache is not None:
        todo = todo.join(cache.select("prompt_key").distinct(), "prompt_key", "left_anti")
    return todo


def _call_batches(chat_fn: ChatFn, options: dict | None = None, attempts: int = 3):
    """A batch is asked at once; if that fails, or the answers don't number the prompts, each
    prompt is asked alone up to ``attempts`` times, so only its own failure marks it."""
    opts = dict(options or {})

    def ask(msgs: list) -> list:
        out = list(chat_fn(msgs, **opts))
        if len(out) != len(msgs):
            raise ValueError(f"{len(out)} answers to {len(msgs)} prompts")
        return out

    def alone(msg: list) -> tuple:
        for _ in range(attempts):
            try:
                return ask([msg])[0], None
            except Exception as e:  # noqa: BLE001 -- recorded per row, retried on the next run
                error = f"{type(e).__name__}: {e}"
        return None, error

    def run(batches):
        for pdf in batches:
            msgs = [[{"role": m["role"], "content": m["content"]} for m in row] for row in pdf["messages"]]
            try:
                out, err = ask(msgs), [None] * len(msgs)
            except Exception:  # noqa: BLE001 -- asked one by one
                both = [alone(m) for m in msgs]
                out, err = [x for x, _ in both], [e for _, e in both]
            yield pd.DataFrame({"prompt_key": pdf["prompt_key"], "content": out, "error": err})
    return run


def complete(prompts: DataFrame, chat_fn: ChatFn, model: str = "", cache_path: str | None = None,
             concurrency: int | None = None, n: int = 1, options: dict | None = None, attempts: int = 3) -> DataFrame:
    """Answer every row's ``messages``; returns the rows with ``content`` and ``error`` added.

    ``n`` completions per prompt (rows gain ``completion_index``); ``options``
    (e.g. ``{"temperature": 0, "response_format": {"type": "json_object"}}``)
    are passed to ``chat_fn`` as keyword arguments.  ``concurrency`` is the number of
    tasks that call the model (what its endpoint bears; default: the cluster's cores).
    """
    spark = prompts.sparkSession
    keyed = with_prompt_key(prompts, model, n)
    cache = read_if_there(spark, cache_path) if cache_path else None
    concurrency = concurrency or spark.sparkContext.defaultParallelism
    todo = cache_misses(keyed.select("prompt_key", "messages"), cache)
    answers = todo.repartition(concurrency).mapInPandas(_call_batches(chat_fn, options, attempts), ANSWER_SCHEMA)
    if cache_path:
        # failed calls are not cached, so the next run retries exactly those keys
        answers = cut_lineage(answers)
        answers.where(F.col("error").isNull()).write.mode("append").parquet(cache_path)
        all_answers = spark.read.parquet(cache_path).unionByName(answers.where(F.col("error").isNotNull()))
    else:
        all_answers = cut_lineage(answers)
    return keyed.join(all_answers.dropDuplicates(["prompt_key"]), "prompt_key", "left")


def extract_content(df: DataFrame, col: str = "content", start_tag: str = "", end_tag: str = "",
                    out: str = "extracted_data") -> DataFrame:
    """Text between tags; empty tags mean the whole content."""
    if not start_tag and not end_tag:
        return df.withColumn(out, F.col(col))
    import re
    pat = "(?s)" + re.escape(start_tag) + "(.*?)" + (re.escape(end_tag) if end_tag else "$")
    return df.withColumn(out, F.regexp_extract(col, pat, 1))


def echo_metadata_stub(messages: list) -> list[str]:
    """Deterministic stand-in for a chat model: a metadata JSON built from the prompt."""
    out = []
    for msgs in messages:
        user = next((m["content"] for m in msgs if m["role"] == "user"), "")
        body = user.split("code:", 1)[-1].strip()
        out.append(json.dumps({"purpose": body[:60], "imports": [], "classes": [], "methods": []}))
    return out
