"""Registered queries of this subpackage, and SQL that gives the same rows where SQL can."""

from __future__ import annotations

from .bm25 import OP7_SQL, op7_blockmax_wand
from .bpe_automaton import op10_bpe_automaton
from .language import op13_segmentation_language
from .packing import op1_mixture_packing
from .pair_bounds import OP12_SQL, op12_pair_bound_maxscore
from .prefix_trie import OP11_SQL, op11_prefix_trie
from .quality import op9_ordinal_quality
from .secrets import op2_secret_battery
from .simhash import op4_pigeonring_simhash
from .sketch import op8_threshold_sketch
from .substring_dedup import OP3_SQL, op3_countmin_substrings
from .token_counts import op5_token_counts
from .url_filter import OP6_SQL, REDIRECTED_SQL, op6_redirect_equivalence, redirected_pages

QUERIES = {f.__name__: f for f in (op1_mixture_packing, op2_secret_battery, op3_countmin_substrings, op4_pigeonring_simhash, op5_token_counts, op6_redirect_equivalence, op7_blockmax_wand, op8_threshold_sketch, op9_ordinal_quality, op10_bpe_automaton, op11_prefix_trie, op12_pair_bound_maxscore, op13_segmentation_language, redirected_pages)}
ORACLE_SQL: dict[str, str] = {"op3_countmin_substrings": OP3_SQL, "op6_redirect_equivalence": OP6_SQL, "op7_blockmax_wand": OP7_SQL, "op11_prefix_trie": OP11_SQL, "op12_pair_bound_maxscore": OP12_SQL, "redirected_pages": REDIRECTED_SQL}
