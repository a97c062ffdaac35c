"""The thin queries of this subpackage, one per operator, over whole tables."""

from __future__ import annotations

import public_tokenizers


def table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ann(spark, sf_dir):
    from . import ann

    return ann.nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op2_vectors(spark, sf_dir):
    from . import near_vectors

    return near_vectors.dedup_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


def op3_lm(spark, sf_dir):
    from . import lm

    return lm.score_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_pii(spark, sf_dir):
    from . import pii

    return pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_quality(spark, sf_dir):
    from . import quality

    return quality.score_documents(table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars"), table(spark, sf_dir, "labels"))


def op6_lines(spark, sf_dir):
    from . import line_dedup

    return line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_html(spark, sf_dir):
    from . import html_text

    return html_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op8_bpe(spark, sf_dir):
    from . import bpe

    return bpe.encode_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op9_packing(spark, sf_dir):
    from . import packing

    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_jaccard(spark, sf_dir):
    from . import jaccard

    return jaccard.link_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_filters(spark, sf_dir):
    from . import filter_audit

    return filter_audit.audit(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), table(spark, sf_dir, "labels"))


def op12_search(spark, sf_dir):
    from . import lexical

    return lexical.rank_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def op13_pivots(spark, sf_dir):
    from . import pivots

    return pivots.top_products(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def queries() -> dict:
    return {"op1_ann": op1_ann, "op2_vectors": op2_vectors, "op3_lm": op3_lm, "op4_pii": op4_pii, "op5_quality": op5_quality, "op6_lines": op6_lines, "op7_html": op7_html, "op8_bpe": op8_bpe, "op9_packing": op9_packing, "op10_jaccard": op10_jaccard, "op11_filters": op11_filters, "op12_search": op12_search, "op13_pivots": op13_pivots}


def oracle_sql() -> dict:
    from . import filter_audit, lexical, pivots

    return {"op11_filters": filter_audit.SQL, "op12_search": lexical.SQL, "op13_pivots": pivots.SQL}
