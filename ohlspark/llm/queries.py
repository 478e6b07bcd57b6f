"""The registered queries of this folder and their SQL."""

from __future__ import annotations

from ohlspark.llm import (
    op01_decontaminate,
    op02_revisits,
    op03_bagminhash,
    op04_url_filter,
    op05_line_crf,
    op06_sharding,
    op07_secrets,
    op08_perplexity,
    op09_packing,
    op10_language,
    op11_runs,
    op12_importance,
    op13_gray_simhash,
)

QUERIES = {
    "op1_decontaminate": op01_decontaminate.op1_decontaminate,
    "op2_revisits": op02_revisits.op2_revisits,
    "op3_bagminhash": op03_bagminhash.op3_bagminhash,
    "op4_url_filter": op04_url_filter.op4_url_filter,
    "op5_line_crf": op05_line_crf.op5_line_crf,
    "op6_sharding": op06_sharding.op6_sharding,
    "op7_secrets": op07_secrets.op7_secrets,
    "op8_perplexity": op08_perplexity.op8_perplexity,
    "op9_packing": op09_packing.op9_packing,
    "op10_language": op10_language.op10_language,
    "op11_periodic_runs": op11_runs.op11_periodic_runs,
    "op12_importance_resampling": op12_importance.op12_importance_resampling,
    "op13_gray_simhash": op13_gray_simhash.op13_gray_simhash,
}
SQL = {
    "op1_decontaminate": op01_decontaminate.SQL,
    "op2_revisits": op02_revisits.SQL,
    "op4_url_filter": op04_url_filter.SQL,
    "op11_periodic_runs": op11_runs.SQL,
    "op12_importance_resampling": op12_importance.SQL,
}
