"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import bpe, compact, decontaminate, htmlmain, katz, langid, mixing, neardup, quality, secrets, urlfilter, warc, whiten

QUERIES = {
    "op1_katz_scores": katz.op1_katz_scores,
    "op2_html_extraction": htmlmain.op2_html_extraction,
    "op3_ngram_jaccard": neardup.op3_ngram_jaccard,
    "op4_url_filter": urlfilter.op4_url_filter,
    "op5_decontamination": decontaminate.op5_decontamination,
    "op6_mixing": mixing.op6_mixing,
    "op7_warc": warc.op7_warc,
    "op8_language_id": langid.op8_language_id,
    "op9_quality_rules": quality.op9_quality_rules,
    "op10_secret_scan": secrets.op10_secret_scan,
    "op11_compaction": compact.op11_compaction,
    "op12_byte_bpe": bpe.op12_byte_bpe,
    "op13_whitening": whiten.op13_whitening,
}
ORACLE_SQL = {"op3_ngram_jaccard": neardup.OP3_SQL, "op7_warc": warc.OP7_SQL, "op4_url_filter": urlfilter.OP4_SQL, "op5_decontamination": decontaminate.OP5_SQL}
