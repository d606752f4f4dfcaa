"""The queries of this subpackage and their SQL, as __spark_entry__.py registers them."""

from proselens.llm import decontaminate, hnsw, jaccard_join, licenses, line_dedup, mixing, passages, secrets, toxicity, warc

QUERIES = {
    "op1_decontaminate": decontaminate.query,
    "op2_warc": warc.query,
    "op3_hnsw": hnsw.query,
    "op4_toxicity": toxicity.query,
    "op5_line_dedup": line_dedup.query,
    "op6_secrets": secrets.query,
    "op7_mix": mixing.query,
    "op8_passages": passages.query,
    "op9_licenses": licenses.query,
    "op10_jaccard_join": jaccard_join.query,
}

ORACLES = {
    "op1_decontaminate": decontaminate.ORACLE,
    "op2_warc": warc.ORACLE,
    "op3_hnsw": hnsw.ORACLE,
    "op5_line_dedup": line_dedup.ORACLE,
    "op6_secrets": secrets.ORACLE,
    "op10_jaccard_join": jaccard_join.ORACLE,
}
