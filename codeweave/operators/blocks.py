"""Block registry and declarative flows.

A block is ``fn(df, config) -> DataFrame``; a flow is a list of
``{"block_type": ..., "block_config": {...}}`` folded with ``DataFrame.transform``
-- the whole flow stays one lazy plan for Catalyst.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweave.operators import completion as C
from codeweave.operators import generation as GEN

Block = Callable[[DataFrame, dict], DataFrame]
_REGISTRY: dict[str, tuple[Block, str, str]] = {}


def register_block(name: str, category: str = "custom", doc: str = ""):
    def deco(fn: Block) -> Block:
        _REGISTRY[name] = (fn, category, doc)
        return fn
    return deco


def blocks() -> dict[str, tuple[str, str]]:
    return {k: (cat, doc) for k, (_, cat, doc) in _REGISTRY.items()}


def _need(df: DataFrame, cols) -> None:
    cols = [cols] if isinstance(cols, str) else list(cols or [])
    missing = sorted(set(cols) - set(df.columns))
    if missing:
        raise ValueError(f"Block input columns {missing} not in the dataset")


@register_block("prompt", "prompt", "render source/config chat messages (P2, P3)")
def _prompt(df, cfg):
    out = GEN.render_prompts(df)
    return out.withColumnRenamed("messages", cfg["output_cols"]) if cfg.get("output_cols") else out


@register_block("chat", "llm", "batch completion through a user chat function (P4)")
def _chat(df, cfg):
    src = cfg.get("input_cols", "messages")
    _need(df, src)
    d = df.withColumnRenamed(src, "messages") if src != "messages" else df
    out = C.complete(d, cfg["chat_fn"], cfg.get("model", ""), cfg.get("cache_path"), cfg.get("concurrency"))
    return out.withColumnRenamed("content", cfg.get("output_cols", "content"))


@register_block("content", "parse", "keep the answer text (P6)")
def _content(df, cfg):
    src = cfg.get("input_cols", "content")
    _need(df, src)
    return df.withColumn(cfg.get("output_cols", f"{src}_content"), F.col(src))


@register_block("text_parse", "parse", "text between start/end tags (P6)")
def _text_parse(df, cfg):
    src = cfg["input_cols"]
    _need(df, src)
    starts, ends = cfg.get("start_tags", [""]), cfg.get("end_tags", [""])
    return C.extract_content(df, src, starts[0], ends[0], cfg.get("output_cols", "extracted_data"))


@register_block("drop", "transform", "checked column drop (P7)")
def _drop(df, cfg):
    return GEN.drop_columns(df, list(cfg.get("input_cols") or []))


def run_flow(df: DataFrame, flow: list[dict], required: list[str] | None = None) -> DataFrame:
    """Apply blocks in order; ``required`` columns are checked first."""
    if required:
        GEN.check_required(df, required)
    for step in flow:
        kind = step["block_type"]
        if kind not in _REGISTRY:
            raise KeyError(f"unknown block type {kind}; known: {sorted(_REGISTRY)}")
        fn = _REGISTRY[kind][0]
        cfg = dict(step.get("block_config", {}))
        df = df.transform(lambda d, fn=fn, cfg=cfg: fn(d, cfg))
    return df
