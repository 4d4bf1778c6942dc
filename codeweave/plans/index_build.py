"""End-to-end: corpus preparation -> index build -> questions, as one set of lazy plans.

``prepare_corpus``  : files -> passes -> prompts -> model -> accepted metadata
                      -> headers -> annotated texts (+ metadata texts), one writer
                      per target path.
``build_index``     : corpus + metadata -> text units, entities, relationships,
                      communities, community reports, membership (the index tables).
``Index``           : the analysis API over a written index (dependencies,
                      dependents, cycles, layers, impact, waves, risk, search).

Each model boundary and each iterative stage materialises its output in the
shared checkpoint folder, so retries never re-call the model and lineage stays
short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweave.operators import analysis as A
from codeweave.operators import communities as CM
from codeweave.operators import completion as C
from codeweave.operators import generation as GEN
from codeweave.operators import graph as G
from codeweave.operators import indexing as IX
from codeweave.operators import report_index as RI
from codeweave.operators import search as S
from codeweave.sources import index_io as IO
from codeweave.session import cut_lineage


def prepare_corpus(files: DataFrame, languages: list[str], chat_fn, model: str = "",
                   cache_path: str | None = None, concurrency: int | None = None) -> dict[str, DataFrame]:
    """Returns ``annotated`` (one row per written file), ``rejected`` and ``missing`` tables."""
    keys = ["git_repo", "pass_seq", "file_path"]
    passes = GEN.select_passes(files, languages)
    prompts = GEN.render_prompts(passes)
    answered = C.complete(prompts, chat_fn, model, cache_path, concurrency)
    parsed = GEN.accept_metadata(GEN.parse_metadata_text(answered, "content"))
    # a row without comment delimiters can't carry a header: rejected, not written bare
    parsed = GEN.comment_delimiters(parsed).withColumn("reject_reason", F.coalesce(
        "reject_reason", F.when(F.col("comment_begin").isNull(), "no_comment_delimiters"))).drop("comment_begin", "comment_end")
    parsed = cut_lineage(parsed.drop("messages"))
    rejected = parsed.where(F.col("reject_reason").isNotNull()).select(*keys, "reject_reason")
    ok = parsed.where(F.col("reject_reason").isNull())
    ann = GEN.annotated_text(GEN.comment_header(GEN.typed_metadata(ok)))
    # the raw span: document order decides which of two colliding key paths wins
    flat = GEN.flatten_metadata(ok.select(*keys, F.col("content").alias("text")), "text", keys, types=True)
    ann = ann.join(GEN.metadata_yaml(flat, keys), keys, "left")
    winners = GEN.target_path_winner(ann, ["pass_seq", "file_path"])
    # a file that lost its target path was processed all the same
    missing = GEN.reconcile_missing(passes, ok, ["git_repo", "file_path"])
    return {"annotated": winners, "rejected": rejected, "missing": missing}


def metadata_rows(annotated: DataFrame) -> DataFrame:
    """Typed per-method rows for structural extraction (file lists only on the first method row)."""
    v = F.col("metadata")
    base = annotated.select(
        "file_path", "package", "imports", "classes",
        F.posexplode_outer(F.try_variant_get(v, "$.methods", "array<variant>")).alias("pos", "m"))
    first = F.coalesce(F.col("pos"), F.lit(0)) == 0
    empty = F.array().cast("array<string>")
    return base.select(
        "file_path", F.when(first, F.col("package")).alias("package"),
        F.when(first, F.coalesce("imports", empty)).otherwise(empty).alias("imports"),
        F.when(first, F.coalesce("classes", empty)).otherwise(empty).alias("classes"),
        F.try_variant_get("m", "$.method_name", "string").alias("method_name"),
        F.coalesce(F.try_variant_get("m", "$.callees", "array<string>"), empty).alias("callees"))


def library_rows(annotated: DataFrame) -> DataFrame:
    """``(file_path, library_name, library_version, deprecated, vulnerabilities)`` of configuration files."""
    entries = annotated.select("file_path", F.explode(F.try_variant_get("metadata", "$.methods", "array<variant>")).alias("m"))
    return entries.select(
        "file_path", F.try_variant_get("m", "$.library_name", "string").alias("library_name"),
        F.try_variant_get("m", "$.library_version", "string").alias("library_version"),
        F.coalesce(F.try_variant_get("m", "$.deprecated", "boolean"), F.lit(False)).alias("deprecated"),
        F.coalesce(F.try_variant_get("m", "$.vulnerabilities", "array<string>"), F.array().cast("array<string>")).alias("vulnerabilities")) \
        .where("library_name is not null")


def build_index(corpus: DataFrame, md_rows: DataFrame, chunk_size: int = 1200, chunk_overlap: int = 100,
                max_cluster_size: int = 10, libraries: DataFrame | None = None) -> dict[str, DataFrame]:
    """Index tables from the corpus ``(id, path, text)``, typed metadata rows and, if given, library rows."""
    units = IX.chunk_text(corpus, "text", "id", chunk_size, chunk_overlap).select(
        F.sha2(F.concat_ws(":", "id", F.col("chunk_index").cast("string")), 256).alias("id"),
        F.col("id").alias("document_id"), "chunk_index", "text", "n_tokens")
    entities = IX.structural_entities(md_rows)
    rels = IX.structural_relationships(md_rows)
    rels = rels.withColumn("description", F.concat_ws(" ", "source", F.lower("type"), "target")) \
        .withColumn("weight", F.col("weight").cast("double"))
    deg = G.degree(rels).select(F.col("node").alias("title"), "degree")
    entities = entities.join(deg, "title", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    membership = CM.hierarchical_communities(rels, max_size=max_cluster_size)
    communities = CM.community_table(membership)
    reports = cut_lineage(CM.community_reports(membership, rels))
    methods = md_rows.where("method_name is not null").select("file_path", "method_name", "callees")
    out = {"entities": entities, "relationships": rels, "text_units": units, "communities": communities,
           "community_reports": reports, "membership": membership, "methods": methods, **RI.build(reports)}
    return out if libraries is None else out | {"libraries": libraries}


class Index:
    """Analysis API over an index folder (or in-memory tables)."""

    def __init__(self, spark: SparkSession, root: str | None = None, tables: dict | None = None):
        self.spark = spark
        self.tables = tables if tables is not None else IO.load_index(spark, root)

    def raw_data(self) -> dict[str, DataFrame]:
        return dict(self.tables)

    @property
    def relationships(self) -> DataFrame:
        return self.tables["relationships"]

    def find_dependencies(self, module: str, literal: bool = False) -> DataFrame:
        return A.find_dependencies(self.relationships, module, literal)

    def find_dependents(self, module: str, literal: bool = False) -> DataFrame:
        return A.find_dependents(self.relationships, module, literal)

    def circular_dependencies(self) -> DataFrame:
        return G.cycle_nodes(self.relationships)

    def short_cycles(self) -> DataFrame:
        return G.short_cycles(self.relationships)

    def cycle_list(self) -> DataFrame:
        """Q3: one shortest cycle of every strongly connected component, as a list of modules."""
        return G.shortest_cycles(self.relationships)

    def reach_sizes(self) -> DataFrame:
        return G.reach_sizes(self.relationships)

    def dependency_layers(self) -> DataFrame:
        return A.dependency_layers(self.relationships)

    def root_modules(self) -> DataFrame:
        return A.root_modules(self.relationships, self.tables["entities"])

    def dependency_report(self, module: str, dependents_of: str = "database") -> DataFrame:
        return A.dependency_report(self.relationships, module, dependents_of)

    def impact_set(self, package: str) -> DataFrame:
        return G.impact_set(self.relationships, package)

    def migration_waves(self) -> DataFrame:
        return G.migration_waves(self.relationships)

    def risk_rank(self, k: int = 20, ascending: bool = False) -> DataFrame:
        return G.risk_rank(self.relationships, k, ascending)

    def local_search(self, question: str, k: int = 10, budget: int = S.CONTEXT_BUDGET) -> DataFrame:
        """Hashed-TF similarity of the question to entity titles, top-k, 1-hop relationships."""
        ents = self.tables["entities"].select(F.col("title").alias("doc_id"),
                                              F.regexp_replace("title", "[^A-Za-z0-9]+", " ").alias("text"))
        q = self.spark.createDataFrame([(0, question)], "doc_id long, text string")
        qv = IX.text_embedding(q).select(F.col("doc_id").alias("query_id"), F.col("embedding").alias("query"))
        hits = S.vector_topk(IX.text_embedding(ents), qv, k=k, id_col="doc_id", qid_col="query_id")
        return S.one_hop_context(hits.where(F.col("score") > 0), self.relationships, budget)

    def global_search(self, question: str, dynamic: bool = True, budget: int = S.CONTEXT_BUDGET) -> DataFrame:
        """BM25 over the community reports, selected by level and token budget."""
        return S.search_reports(self.search_tables, question, dynamic, budget)

    def ask(self, question: str, chat_fn, model: str = "", dynamic: bool = True) -> DataFrame:
        """Global search whose reduce step is a model's answer."""
        return S.answer_by_model(self.global_search(question, dynamic), question, chat_fn, model)

    def migration_report(self, questions: list[str] = S.MIGRATION_QUESTIONS) -> DataFrame:
        """The fixed questions over the community reports, one section each."""
        return S.index_migration_report(self.search_tables, questions)

    def library_inventory(self) -> DataFrame:
        return A.library_inventory(self.tables["libraries"])

    def library_versions(self) -> DataFrame:
        return A.library_versions(self.tables["libraries"])

    def call_graph(self, callee_is_caller: bool = True) -> DataFrame:
        return A.call_graph(self.tables["methods"], callee_is_caller)

    @property
    def search_tables(self) -> dict[str, DataFrame]:
        """The tables with the report index, which an index of older make lacks and gets here."""
        if RI.TABLES[0] not in self.tables:
            made = RI.build(self.tables["community_reports"])
            self.tables |= {name: cut_lineage(df) for name, df in made.items()}
        return self.tables
