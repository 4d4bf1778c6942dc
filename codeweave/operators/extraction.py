"""Model-driven extraction over text units (I2/I3 model route, gleaning, I15 claims).

Each text unit becomes one chat prompt (the entity-extraction template with
``{input_text}`` substituted JVM-side); answers go through the cached,
concurrency-bounded ``completion.complete``; the JSON answer is parsed into
VARIANT and exploded into typed rows.  A *gleaning* pass re-asks with the
first answer in context and unions what it adds.

Output contract (the template names fields but no format, so we fix one):
``{"entities": [{"entity_name", "entity_type", "entity_description"}],
   "relationships": [{"source", "target", "relationship_type",
                      "relationship_strength", "description"}]}``.

Mentions stay a normalised table ``(title, type, text_unit_id)``; merged
entities carry counts, never an unbounded array of unit ids per hub entity.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache
from importlib import resources

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweave.functions.text import extract_json
from codeweave.operators import completion as C

GLEAN_PROMPT = "Read the text again. List only what your last answer left out, entities and relationships alike, as JSON of the same shape."
CLAIM_PROMPT = ("Extract factual claims about software entities from the text below as JSON "
                '{"claims": [{"subject", "object", "claim_type", "status", "description"}]}.\n\ntext: {input_text}')


# FIXED VALUE: resources/entity_prompt.txt holds the prompt text that must match.
@lru_cache(maxsize=None)
def entity_template() -> str:
    return resources.files("codeweave.resources").joinpath("entity_prompt.txt").read_text(encoding="utf-8")


def _user(template: str, text_col: str = "text"):
    return F.replace(F.lit(template), F.lit("{input_text}"), F.coalesce(F.col(text_col), F.lit("")))


def _msg(role: str, content):
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def _parse_rows(answered: DataFrame, unit_col: str, path: str) -> DataFrame:
    v = extract_json(F.col("content"))
    return answered.select(unit_col, F.explode(F.try_variant_get(v, path, "array<variant>")).alias("x"))


def _entities(rows: DataFrame, unit_col: str) -> DataFrame:
    g = lambda p: F.try_variant_get("x", p, "string")
    return rows.select(F.upper(F.trim(g("$.entity_name"))).alias("title"),
                       F.lower(F.trim(g("$.entity_type"))).alias("type"),
                       g("$.entity_description").alias("description"),
                       F.col(unit_col).alias("text_unit_id")).where(F.col("title") != "")


def _relationships(rows: DataFrame, unit_col: str) -> DataFrame:
    g = lambda p: F.try_variant_get("x", p, "string")
    strength = F.try_variant_get("x", "$.relationship_strength", "double")
    return rows.select(F.upper(F.trim(g("$.source"))).alias("source"), F.upper(F.trim(g("$.target"))).alias("target"),
                       F.upper(F.trim(g("$.relationship_type"))).alias("type"),
                       F.least(F.lit(10.0), F.greatest(F.lit(1.0), F.coalesce(strength, F.lit(1.0)))).alias("weight"),
                       g("$.description").alias("description"), F.col(unit_col).alias("text_unit_id")) \
        .where((F.col("source") != "") & (F.col("target") != ""))


def model_extraction(units: DataFrame, chat_fn, model: str = "", cache_path: str | None = None,
                     gleanings: int = 1, concurrency: int | None = None, unit_col: str = "id",
                     text_col: str = "text") -> dict[str, DataFrame]:
    """Returns ``mentions``, ``entities``, ``relationships`` (merged) from model answers."""
    tmpl = entity_template()
    first_msgs = F.array(_msg("user", _user(tmpl, text_col)))
    asked = units.select(unit_col, text_col, first_msgs.alias("messages"))
    ans = C.complete(asked, chat_fn, model, cache_path, concurrency).select(unit_col, text_col, "messages", "content")
    rounds = [ans.select(unit_col, "content")]
    prev = ans
    for _ in range(gleanings):
        follow = F.concat(F.col("messages"), F.array(_msg("assistant", F.coalesce(F.col("content"), F.lit(""))),
                                                     _msg("user", F.lit(GLEAN_PROMPT))))
        more = prev.select(unit_col, text_col, follow.alias("messages"))
        prev = C.complete(more, chat_fn, model, cache_path, concurrency).select(unit_col, text_col, "messages", "content")
        rounds.append(prev.select(unit_col, "content"))
    allans = rounds[0]
    for r in rounds[1:]:
        allans = allans.unionByName(r)
    mentions = _entities(_parse_rows(allans, unit_col, "$.entities"), unit_col)
    rel_rows = _relationships(_parse_rows(allans, unit_col, "$.relationships"), unit_col)
    entities = mentions.groupBy("title", "type").agg(
        F.countDistinct("text_unit_id").alias("frequency"),
        F.min("description").alias("description"))
    ent_titles = entities.select("title").distinct()
    rels = (rel_rows.groupBy("source", "target", "type").agg(
        F.sum("weight").alias("weight"), F.countDistinct("text_unit_id").alias("n_units"),
        F.min("description").alias("description"))
        .join(ent_titles.select(F.col("title").alias("source")), "source", "left_semi")
        .join(ent_titles.select(F.col("title").alias("target")), "target", "left_semi"))
    return {"mentions": mentions.select("title", "type", "text_unit_id").distinct(),
            "entities": entities, "relationships": rels}


def extract_claims(units: DataFrame, chat_fn, model: str = "", cache_path: str | None = None,
                   concurrency: int | None = None, unit_col: str = "id", text_col: str = "text") -> DataFrame:
    """I15 (off by default in the original): claims/covariates per text unit."""
    asked = units.select(unit_col, F.array(_msg("user", _user(CLAIM_PROMPT, text_col))).alias("messages"))
    ans = C.complete(asked, chat_fn, model, cache_path, concurrency)
    rows = _parse_rows(ans, unit_col, "$.claims")
    g = lambda p: F.try_variant_get("x", p, "string")
    return rows.select(F.upper(F.trim(g("$.subject"))).alias("subject"), F.upper(F.trim(g("$.object"))).alias("object"),
                       g("$.claim_type").alias("claim_type"), g("$.status").alias("status"),
                       g("$.description").alias("description"), F.col(unit_col).alias("text_unit_id"))


# ----------------------------------------------------------------- test stub
_CAP = re.compile(r"\b[A-Z][a-z]+\b")


def capitalised_words_stub(messages: list) -> list[str]:
    """Deterministic model stand-in: capitalised words are entities, neighbours relate.

    The first call extracts from even positions, a gleaning call from odd ones,
    so the gleaning pass has something to add.
    """
    out = []
    for msgs in messages:
        text = msgs[0]["content"].split("text:", 1)[-1].split("######", 1)[0]
        words = _CAP.findall(text)
        parity = 1 if len(msgs) > 1 else 0
        picked = words[parity::2]
        ents = [{"entity_name": w, "entity_type": "module", "entity_description": f"{w} module"} for w in picked]
        rels = [{"source": a, "target": b, "relationship_type": "USES", "relationship_strength": 12,
                 "description": f"{a} uses {b}"} for a, b in zip(picked, picked[1:]) if a != b]
        claims = [{"subject": w, "object": w, "claim_type": "exists", "status": "TRUE",
                   "description": f"{w} exists"} for w in picked[:1]]
        out.append("Result: " + json.dumps({"entities": ents, "relationships": rels, "claims": claims}))
    return out
