"""The opN_ queries: thin digests over the operators of this subpackage."""

from __future__ import annotations

from . import ann, html_text, jaccard, langid, lexical, lm_score, mixing, packing, quality, repeats, spotsigs, url_filter, vector_codes
from .common import table


def op1_nearest(spark, sf_dir):
    return ann.digest(table(spark, sf_dir, "embeddings"))


def op2_language_id(spark, sf_dir):
    return langid.digest(table(spark, sf_dir, "documents"))


def op3_packing(spark, sf_dir):
    return packing.digest(table(spark, sf_dir, "documents"))


def op8_quality(spark, sf_dir):
    return quality.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_jaccard_join(spark, sf_dir):
    return jaccard.classes(table(spark, sf_dir, "documents"))


def op4_html_text(spark, sf_dir):
    return html_text.digest(table(spark, sf_dir, "pages"))


def op5_fingerprints(spark, sf_dir):
    return spotsigs.digest(table(spark, sf_dir, "documents"))


def op6_lm_score(spark, sf_dir):
    return lm_score.digest(table(spark, sf_dir, "documents"))


def op7_mixing(spark, sf_dir):
    return mixing.digest(table(spark, sf_dir, "documents"))


def op10_url_filters(spark, sf_dir):
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op11_vector_codes(spark, sf_dir):
    return vector_codes.digest(table(spark, sf_dir, "embeddings"))


def op12_repeats(spark, sf_dir):
    return repeats.digest(table(spark, sf_dir, "documents"))


def op13_ranked_search(spark, sf_dir):
    return lexical.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {
        "op5_fingerprints": spotsigs.oracle(),
        "op10_url_filters": url_filter.oracle(),
        "op11_vector_codes": vector_codes.oracle(),
        "op13_ranked_search": lexical.oracle(),
    }
