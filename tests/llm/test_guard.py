"""What reaches the driver is bounded, and no lineage is cut on executors' own disks."""
import pathlib
import re

LLM = pathlib.Path(__file__).resolve().parents[2] / "codeweave" / "llm"
#: .collect() calls and what bounds their rows.
COLLECTS = {
    "decontaminate.py": 2,  # kinds of shingles (SHINGLE at most); shingles up to IN_PLACE + 1
    "htmltext.py": 1,  # BROADCAST_BRANCHES + 1
    "langid.py": 2,  # a row a language; SLOTS for every BITS languages
    "licences.py": 1,  # words of the fixed vocabulary
    "jaccard.py": 1,  # one bitmap of fixed size
    "lexical.py": 1,  # terms of a block of queries (BLOCK_TERMS)
    "tokenfiles.py": 1,  # one row a file
    "toxicity.py": 3,  # stems and words (CANDIDATES each); cells of powers of two
}


def test_bounded_collects():
    for p in sorted(LLM.glob("*.py")):
        code = "\n".join(x for x in p.read_text().splitlines() if not x.strip().startswith("#"))
        assert len(re.findall(r"\.collect\(\)", code)) == COLLECTS.get(p.name, 0), p.name
        assert not re.search(r"\.(localCheckpoint|toPandas|crossJoin)\(|\.rdd\b", code), p.name


def test_nothing_else_imports_this_subpackage():
    for p in LLM.parent.rglob("*.py"):
        if LLM not in p.parents:
            assert "codeweave.llm" not in p.read_text(), p
