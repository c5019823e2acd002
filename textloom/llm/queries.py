"""Queries of this subpackage and their SQL."""

from . import decontam, html_text, linkgraph, mixing, neardup, quality, tiff, token_files, toxicity, warc

QUERIES = {
    f.__name__: f
    for f in (
        toxicity.op1_toxicity, token_files.op2_token_files, tiff.op3_tiff, mixing.op4_mix, neardup.op5_neardup,
        linkgraph.op6_linkgraph, decontam.op7_decontam, quality.op8_quality, warc.op9_warc, html_text.op10_html_text, linkgraph.trust_rank,
    )
}

ORACLES = {"op4_mix": mixing.OP4_SQL, "op5_neardup": neardup.OP5_SQL, "op7_decontam": decontam.OP7_SQL, "op9_warc": warc.OP9_SQL, "trust_rank": linkgraph.TRUST_SQL}
