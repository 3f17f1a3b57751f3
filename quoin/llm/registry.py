"""The queries of this subpackage and, where SQL can express them, their DuckDB twins."""

from quoin.llm.decontaminate import OP6_SQL, op6_decontaminate
from quoin.llm.fingerprint import op7_fingerprint
from quoin.llm.language import op10_language
from quoin.llm.licenses import op9_license_scan
from quoin.llm.line_dedup import op3_line_dedup
from quoin.llm.mixing import OP4_SQL, op4_mixing
from quoin.llm.nearest import op12_nearest
from quoin.llm.ngram_join import OP5_SQL, op5_ngram_join
from quoin.llm.prefix_trie import OP11_SQL, op11_prefix_trie
from quoin.llm.quality import op8_quality
from quoin.llm.tokens import op1_token_counts
from quoin.llm.warc import OP2_SQL, op2_warc
from quoin.llm.whitening import op13_whitening

QUERIES = {f.__name__: f for f in (op1_token_counts, op2_warc, op3_line_dedup, op4_mixing, op5_ngram_join, op6_decontaminate, op7_fingerprint, op8_quality, op9_license_scan, op10_language, op11_prefix_trie, op12_nearest, op13_whitening)}
ORACLES = {"op2_warc": OP2_SQL, "op4_mixing": OP4_SQL, "op5_ngram_join": OP5_SQL, "op6_decontaminate": OP6_SQL, "op11_prefix_trie": OP11_SQL}
