"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeloom.llm import docpairs, mixing, neighbours, pieces, provenance, residue, secrets, tokens
from lakeloom.sources.tables import table


def _contents(spark, sf_dir):
    return pieces.contents(table(spark, sf_dir, "chunks"), table(spark, sf_dir, "large_chunks"))


def p1_pieces(spark, sf_dir):
    return pieces.split(_contents(spark, sf_dir))


def p1_found(spark, sf_dir):
    """Items that the splitter cut: those with more than one piece."""
    return p1_pieces(spark, sf_dir).where("piece_no = 1 and n_pieces > 1").select("source_table", "id")


def p2_found(spark, sf_dir):
    return secrets.found(table(spark, sf_dir, "chunks")).select("id", "line_no").distinct()


def p2_redacted(spark, sf_dir):
    """Path and text of every row with a secret in either, only the secrets replaced."""
    return secrets.rewritten(table(spark, sf_dir, "chunks")).select("id", "module_path", "content", (F.col("n_path") + F.col("n_content")).alias("n_redacted"))


def _vector_fields(spark, sf_dir):
    chunks, notes = table(spark, sf_dir, "chunks"), table(spark, sf_dir, "notes")
    return {
        "notes.embedding": (notes, "id", "embedding"),
        "chunks.embedding": (chunks, "id", "embedding"),
        "chunks.signature_embedding": (chunks, "id", "signature_embedding"),
    }


def p4_found(spark, sf_dir):
    """A pair over 0.95 in one of two lists is enough to be found, so few lists are visited."""
    # The answers of further copies are one-sided, so no pair is theirs.
    s = neighbours.Search(k=5, least=0.95, probes=4, copies=False)
    return neighbours.mutual(neighbours.neighbours(spark, _vector_fields(spark, sf_dir), s))


#: Lists that a query of p4_neighbours visits: so many, and this share of them; README gives the recall.
NEIGHBOUR_PROBES, NEIGHBOUR_SHARE = 256, 0.5


def p4_neighbours(spark, sf_dir):
    """The five most similar ids of every hundredth id, by a hash, against all rows of each field."""
    s = neighbours.Search(k=5, probes=NEIGHBOUR_PROBES, share=NEIGHBOUR_SHARE)
    asked = F.pmod(F.xxhash64("id"), F.lit(100)) == 0
    return neighbours.neighbours(spark, _vector_fields(spark, sf_dir), s, asked).select("field", "id", "other", F.round("cosine", 6).alias("cosine"), "place")


def p6_found(spark, sf_dir):
    return docpairs.found(table(spark, sf_dir, "chunks"))


def p6_pairs(spark, sf_dir):
    return docpairs.pairs(table(spark, sf_dir, "chunks"))


def p7_found(spark, sf_dir):
    return provenance.found(spark, table(spark, sf_dir, "chunks")).select("repo_name", "module_path")


def p7_kinds(spark, sf_dir):
    """How many files are of each kind, per repository."""
    kinds = provenance.classify(spark, table(spark, sf_dir, "chunks"))
    return kinds.groupBy("repo_name", F.coalesce("kind", F.lit("hand_written")).alias("kind")).agg(F.count(F.lit(1)).alias("n_files"))


def p8_ids(spark, sf_dir):
    return tokens.encode(spark, table(spark, sf_dir, "documents"))


def p8_decoded(spark, sf_dir):
    """The texts that the ids of p8_ids stand for, through the join with the pieces."""
    ids = p8_ids(spark, sf_dir)
    back = tokens.decode(ids, tokens.piece_table(spark)).select("doc_id", F.decode("bytes", "UTF-8").alias("text"))
    return ids.select("doc_id").join(back, "doc_id", "left").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def _mix(spark, sf_dir):
    return mixing.mixed(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p9_mix(spark, sf_dir):
    return _mix(spark, sf_dir).drawn.select("doc_id", "source", "n_tokens", "copies")


def p9_report(spark, sf_dir):
    return _mix(spark, sf_dir).report


def p9_margins(spark, sf_dir):
    return _mix(spark, sf_dir).margins


def p10_found(spark, sf_dir):
    return residue.scored(spark, table(spark, sf_dir, "documents")).where("residue").select("doc_id")


def p10_scores(spark, sf_dir):
    return residue.scored(spark, table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_pieces, p2_found, p2_redacted, p4_found, p4_neighbours, p6_found, p6_pairs, p7_found, p7_kinds, p8_ids, p8_decoded, p9_mix, p9_report, p9_margins, p10_found, p10_scores)}

SQL: dict[str, str] = {
    "p1_found": """
SELECT DISTINCT source_table, id FROM (
  SELECT 'chunks' AS source_table, id, content FROM chunks UNION ALL SELECT 'large_chunks', id, content FROM large_chunks)
WHERE strlen(content) > 5120""",
    "p8_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
}
