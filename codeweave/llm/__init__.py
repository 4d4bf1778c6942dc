"""Training-data operators: language id, decontamination, PII, URL filters, HTML
extraction, embedding and n-gram near-duplicates, byte-level BPE, licences, toxicity.

Nothing else in the library imports this subpackage.
"""
