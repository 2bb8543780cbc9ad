"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from .byte_bpe import op2_byte_bpe
from .collocations import OP12_SQL, op12_collocations
from .exact_dedup import OP6_SQL, op6_exact_dedup
from .jaccard_join import OP7_SQL, op7_jaccard_join
from .language_id import op5_language_id
from .license_scan import op1_license_scan
from .packing import op9_packing
from .product_codes import OP13_SQL, op13_product_codes
from .quality_pu import op10_quality_pu
from .substring_dedup import OP8_SQL, op8_substring_dedup
from .toxicity_pu import op11_toxicity_pu
from .url_filter import op4_url_filter
from .vp_search import op3_vp_search

QUERIES = {
    f.__name__: f
    for f in (op1_license_scan, op2_byte_bpe, op3_vp_search, op4_url_filter, op5_language_id, op6_exact_dedup, op7_jaccard_join, op8_substring_dedup, op9_packing, op10_quality_pu, op11_toxicity_pu, op12_collocations, op13_product_codes)
}
ORACLE_SQL = {"op6_exact_dedup": OP6_SQL, "op7_jaccard_join": OP7_SQL, "op8_substring_dedup": OP8_SQL, "op12_collocations": OP12_SQL, "op13_product_codes": OP13_SQL}
