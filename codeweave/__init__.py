"""codeweave: a Spark-native engine for code-corpus knowledge graphs.

Scan source trees into tables, annotate files with structured metadata,
chunk text, extract entities and relationships, group the graph into nested
communities with reports, and answer dependency questions -- all as
DataFrame plans that Catalyst optimises and Spark distributes.
"""

from codeweave.session import get_spark, checkpoint_dir, cut_lineage

__all__ = ["get_spark", "checkpoint_dir", "cut_lineage"]
__version__ = "0.1.0"
