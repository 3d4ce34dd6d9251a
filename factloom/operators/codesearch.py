"""Routes of code search: a structural operation fused over five channels, or words where structure finds nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom import session
from factloom.functions import text as fx

from . import codegraph, fusion, lexical

POOL, CONSTANT = 200, 60


def id_overlap(queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """candidates (query_id, id) with overlap, the different tokens that the asked target's id and theirs share."""
    asked = queries.select("query_id", F.array_distinct(fx.code_tokens(F.col("target"))).alias("asked"))
    return candidates.join(asked, "query_id").withColumn("overlap", F.size(F.array_intersect("asked", fx.code_tokens(F.col("id"))))).drop("asked")


def fallback(queries: DataFrame, documents: DataFrame, dense: DataFrame | None = None, index: lexical.Index | None = None) -> DataFrame:
    """query_id, doc, rank and score of the first 200 documents by words; fused in equal parts with dense (query_id, doc, rank) where it is given.

    Documents without a hit fill up in the order of the corpus. A score is a sum of reciprocal ranks, not of words. index: that of
    documents, made here where it is not given.
    """
    hits = lexical.first_float(queries, index or lexical.indexed(documents, fx.code_tokens), fx.code_tokens, POOL)
    words = lexical.filled(hits.select("query_id", "doc", F.col("score").cast("double").alias("score")), queries, documents, POOL)
    rankings = [words] if dense is None else [dense, words]
    return lexical.top(fusion.fused(rankings, [1.0] * len(rankings), CONSTANT), POOL)


def routed(queries: DataFrame, found: DataFrame, documents: DataFrame, degrees: DataFrame, operation: str, dense: DataFrame | None = None, references: DataFrame | None = None, mode: str = "references", definitions: DataFrame | None = None) -> DataFrame:
    """query_id, id, corpus_order, rank, score, signals and route of each query (query_id, text, target), with the candidate's text, source and definition line, the edge and witnesses that speak for it, and its definitions.

    found: (query_id, id, place, frequency) of the structural operation. documents: (doc, id, text), doc being the
    corpus order, and source and definition_line where they are known. references, definitions: of codegraph.graph(). The route is the operation's own. A query without
    a structural result is answered by words, unless it was a lookup.
    """
    texts = documents.select("doc", "text")
    index = lexical.indexed(texts, fx.code_tokens)
    # words are asked for what structure found, not for all documents
    pairs = found.select("query_id", "id").distinct().join(documents.select("id", "doc"), "id").select("query_id", "doc")
    words = lexical.bm25_float(queries.join(found.select("query_id"), "query_id", "left_semi"), texts, fx.code_tokens, pairs, index).join(documents.select("doc", "id"), "doc").select("query_id", "id", F.col("score").cast("double").alias("lexical"))
    rows = found.join(documents.select("id", F.col("doc").alias("corpus_order")), "id").join(words, ["query_id", "id"], "left").join(degrees, "id", "left")
    rows = id_overlap(queries, rows.fillna(0.0, ["lexical"]).fillna(0, ["degree"]))
    ranked = fusion.channel_ranks(rows, {"structural_order": "place", "bm25": "lexical", "edge_frequency": "frequency", "graph_degree": "degree", "id_overlap": "overlap"})
    whole = fusion.explained(ranked, operation).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "corpus_order")))
    out = whole.select("query_id", "id", "corpus_order", "rank", "score", "signals", F.lit(codegraph.CONFIDENCE[operation][0].format(mode=mode) if operation in codegraph.CONFIDENCE else operation).alias("route"))
    if operation != "lookup":
        rest = queries.join(found.select("query_id").distinct(), "query_id", "left_anti")
        plain = fallback(session.written(rest, "plain"), texts, dense, index).join(documents.select("doc", "id"), "doc")
        none = F.array().cast(dict(out.dtypes)["signals"])
        label = "bm25_fallback" if dense is None else "recorded_dense_bm25_fallback"
        out = out.unionByName(plain.select("query_id", "id", F.col("doc").alias("corpus_order"), "rank", "score", none.alias("signals"), F.lit(label).alias("route")))
    more = [c for c in ("text", "source", "definition_line") if c in documents.columns]
    out = out.join(documents.select("id", *more), "id")
    return out if references is None else evidenced(out.withColumn("operation", F.lit(operation)), queries, references, mode, definitions).drop("operation")


WITNESS = ("path", "first_line", "last_line", "text", "source_hash", "available")


def evidenced(candidates: DataFrame, queries: DataFrame, references: DataFrame, mode: str = "references", definitions: DataFrame | None = None) -> DataFrame:
    """candidates (query_id, id, operation, ...) with edge (source, relation, target), witnesses, the places that speak for it, and definitions, where the candidate is defined; null and empty without any.

    queries: (query_id, target). An edge runs from the candidate to the target for callers, the other way for all others.
    """
    used = references if mode == "references" else references.where("is_call")
    proof = used.groupBy("src", "dst").agg(F.sort_array(F.collect_list(F.struct(*WITNESS))).alias("witnesses"))
    incoming = F.col("operation") == "callers"
    rows = candidates.join(queries.select("query_id", "target"), "query_id").withColumn("src", F.when(incoming, F.col("id")).otherwise(F.col("target"))).withColumn("dst", F.when(incoming, F.col("target")).otherwise(F.col("id")))
    met = rows.join(proof, ["src", "dst"], "left")
    edge = F.when(F.col("witnesses").isNotNull(), F.struct(F.col("src").alias("source"), F.lit(mode).alias("relation"), F.col("dst").alias("target")))
    none = F.array().cast(dict(proof.dtypes)["witnesses"])
    out = met.withColumn("edge", edge).withColumn("witnesses", F.coalesce("witnesses", none)).drop("src", "dst", "target")
    if definitions is None:
        return out
    said = definitions.groupBy("id").agg(F.sort_array(F.collect_list(F.struct(*WITNESS))).alias("definitions"))
    return out.join(said, "id", "left").withColumn("definitions", F.coalesce("definitions", none))
