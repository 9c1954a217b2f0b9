"""The queries of this subpackage, by name, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from leafloom.llm.decontaminate import OP9_SQL, op9_benchmark_decontamination
from leafloom.llm.fill_in_middle import OP12_SQL, op12_fill_in_middle
from leafloom.llm.language_id import op4_language_id
from leafloom.llm.minhash_dedup import OP3_SQL, op3_minhash_near_dedup
from leafloom.llm.nearest import op10_nearest_neighbours
from leafloom.llm.secret_scan import op7_secret_scan
from leafloom.llm.sentencepiece_codec import op6_sentencepiece
from leafloom.llm.simhash_dedup import op11_simhash_near_dedup
from leafloom.llm.substring_dedup import OP2_SQL, op2_substring_dedup
from leafloom.llm.suffix_dedup import op1_suffix_array_dedup
from leafloom.llm.toxicity import op8_toxicity
from leafloom.llm.url_filter import OP5_SQL, op5_url_filter
from leafloom.llm.vector_codes import OP13_SQL, op13_vector_codes

QUERIES = {
    "op1_suffix_array_dedup": op1_suffix_array_dedup,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_minhash_near_dedup": op3_minhash_near_dedup,
    "op4_language_id": op4_language_id,
    "op5_url_filter": op5_url_filter,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_secret_scan": op7_secret_scan,
    "op8_toxicity": op8_toxicity,
    "op9_benchmark_decontamination": op9_benchmark_decontamination,
    "op10_nearest_neighbours": op10_nearest_neighbours,
    "op11_simhash_near_dedup": op11_simhash_near_dedup,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_vector_codes": op13_vector_codes,
}

ORACLE_SQL: dict[str, str] = {
    "op2_substring_dedup": OP2_SQL,
    "op3_minhash_near_dedup": OP3_SQL,
    "op5_url_filter": OP5_SQL,
    "op9_benchmark_decontamination": OP9_SQL,
    "op12_fill_in_middle": OP12_SQL,
    "op13_vector_codes": OP13_SQL,
}
