"""Operators of a training-data pipeline and their queries. Nothing else in the library imports this package."""
from modelscout.llm.alignment import op13_alignment
from modelscout.llm.exact_dedup import OP7_SQL, op7_exact_dedup
from modelscout.llm.fill_middle import OP12_SQL, op12_fill_middle
from modelscout.llm.jaccard_join import op3_ngram_jaccard
from modelscout.llm.maxent import op9_maxent
from modelscout.llm.mixing import OP8_SQL, op8_mixing
from modelscout.llm.nearest import op1_nearest
from modelscout.llm.pieces import op10_pieces
from modelscout.llm.quality import op5_quality
from modelscout.llm.secret_scan import op4_secret_scan
from modelscout.llm.sketch_dedup import op11_sketch_dedup
from modelscout.llm.substring_dedup import op6_substring_dedup
from modelscout.llm.url_filter import OP2_SQL, op2_url_filter

QUERIES = {
    "op1_nearest": op1_nearest,
    "op2_url_filter": op2_url_filter,
    "op3_ngram_jaccard": op3_ngram_jaccard,
    "op4_secret_scan": op4_secret_scan,
    "op5_quality": op5_quality,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_mixing": op8_mixing,
    "op9_maxent": op9_maxent,
    "op10_pieces": op10_pieces,
    "op11_sketch_dedup": op11_sketch_dedup,
    "op12_fill_middle": op12_fill_middle,
    "op13_alignment": op13_alignment,
}
ORACLE = {"op2_url_filter": OP2_SQL, "op7_exact_dedup": OP7_SQL, "op8_mixing": OP8_SQL, "op12_fill_middle": OP12_SQL}
