"""A corpus pipeline of five of the operators in ``codeweave.llm``.

``STAGES`` lists (name, function).  A function takes ``(spark, docs, sf_dir)`` and
returns a DataFrame; it is written as Parquet and read again as the next one's
``docs``.  All but the last return the columns of ``documents``:

1. toxicity: documents predicted toxic go (labels: ``labels`` of ``sf_dir``);
2. n-gram Jaccard join: one document of each group of near copies stays;
3. decontamination: documents that hold too much of ``benchmark`` go;
4. PII: personal data are replaced by surrogates in the texts;
5. byte-level BPE: ``(doc_id, n_tokens, ids, decoded)`` of the texts that are left.

Cases (nulls, empty and very long texts, repeated rows, empty tables, further
columns) are those of the operators: rows with a null text pass every filter and
end with no tokens; further columns pass through stages 1 to 4 as they are.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweave.llm import bpe, decontaminate, jaccard, pii, toxicity
from codeweave.llm.common import materialise, table

#: Near copies: five words to a shingle, a Jaccard similarity of 0.8 or more.
SHINGLE, NUM, DEN = 5, 80, 100


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs, SHINGLE, NUM, DEN)


def remove_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.replace_entities(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = bpe.encode_texts(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return out.select("doc_id", F.expr("octet_length(ids) div 4").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("toxicity", remove_toxic),
    ("jaccard_join", remove_near_copies),
    ("decontamination", remove_contaminated),
    ("pii", replace_personal_data),
    ("byte_bpe", encode),
]

#: The learned toxicity model and the surrogates can't be said in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; between them the rows are written under the checkpoint folder."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
