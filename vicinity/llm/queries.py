"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from vicinity.llm import bpe, collocations, langid, lattice, merkle, minhash, mixing, pii, quality, secret_scan, token_counts, toxicity, warc

QUERIES = {
    "op1_near_duplicates": minhash.op1_near_duplicates,
    "op2_pii": pii.op2_pii,
    "op3_embedding_links": lattice.op3_embedding_links,
    "op4_quality_cascade": quality.op4_quality_cascade,
    "op5_token_counts": token_counts.op5_token_counts,
    "op6_warc_derivatives": warc.op6_warc_derivatives,
    "op7_bpe": bpe.op7_bpe,
    "op8_secrets": secret_scan.op8_secrets,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_mix_sources": mixing.op10_mix_sources,
    "op11_language": langid.op11_language,
    "op12_collocations": collocations.op12_collocations,
    "op13_merkle_manifest": merkle.op13_merkle_manifest,
}

SQL = {
    "op2_pii": pii.SQL,
    "op3_embedding_links": lattice.SQL,
    "op4_quality_cascade": quality.SQL,
    "op10_mix_sources": mixing.SQL,
    "op12_collocations": collocations.SQL,
    "op13_merkle_manifest": merkle.SQL,
}
