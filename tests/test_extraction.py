"""Model-route extraction with gleaning and claims, against a deterministic stub."""
import os
import re

from codeweave.operators import extraction as EX


def test_model_extraction_with_gleaning(spark, tmp_dir):
    units = spark.createDataFrame([("u1", "Alpha calls Beta then Gamma and Delta."), ("u2", "Beta meets Alpha.")],
                                  "id string, text string")
    out = EX.model_extraction(units, EX.capitalised_words_stub, "stub", os.path.join(tmp_dir, "c"), gleanings=1)
    ents = {r.title: r.frequency for r in out["entities"].collect()}
    # first pass picks even positions, gleaning picks odd ones: together every word
    words = {w.upper() for t in ["Alpha calls Beta then Gamma and Delta.", "Beta meets Alpha."]
             for w in re.findall(r"\b[A-Z][a-z]+\b", t)}
    assert set(ents) == words
    assert ents["ALPHA"] == 2 and ents["BETA"] == 2
    rels = {(r.source, r.target): r.weight for r in out["relationships"].collect()}
    assert rels[("ALPHA", "GAMMA")] == 10.0          # strength 12 clipped to 10
    claims = EX.extract_claims(units, EX.capitalised_words_stub, "stub", os.path.join(tmp_dir, "c2"))
    assert {r.subject for r in claims.collect()} == {"ALPHA", "BETA"}
