"""The queries of this subpackage and their SQL, as __spark_entry__.py registers them."""

from .anchors import OP2_SQL, op2_difference_cover
from .conversations import OP11_SQL, op11_rank_convergence
from .decontaminate import OP9_SQL, op9_wu_manber
from .jaccard import OP4_SQL, op4_part_enum
from .packing import op5_nnls_packing
from .pii import op8_bootstrapped
from .quality import OP1_SQL, op1_host_rules
from .sharding import OP10_SQL, op10_sampled_splitters
from .suffixes import OP7_SQL, op7_bucket_refinement
from .tokens import op6_edit_aware
from .toxicity import op12_nb_scaled
from .variants import OP13_SQL, op13_reduced_alphabet
from .warc import OP3_SQL, op3_segments

QUERIES = {
    "op1_host_rules": op1_host_rules,
    "op2_difference_cover": op2_difference_cover,
    "op3_segments": op3_segments,
    "op4_part_enum": op4_part_enum,
    "op5_nnls_packing": op5_nnls_packing,
    "op6_edit_aware": op6_edit_aware,
    "op7_bucket_refinement": op7_bucket_refinement,
    "op8_bootstrapped": op8_bootstrapped,
    "op9_wu_manber": op9_wu_manber,
    "op10_sampled_splitters": op10_sampled_splitters,
    "op11_rank_convergence": op11_rank_convergence,
    "op12_nb_scaled": op12_nb_scaled,
    "op13_reduced_alphabet": op13_reduced_alphabet,
}

ORACLES = {
    "op2_difference_cover": OP2_SQL,
    "op1_host_rules": OP1_SQL,
    "op4_part_enum": OP4_SQL,
    "op9_wu_manber": OP9_SQL,
    "op3_segments": OP3_SQL,
    "op7_bucket_refinement": OP7_SQL,
    "op10_sampled_splitters": OP10_SQL,
    "op11_rank_convergence": OP11_SQL,
    "op13_reduced_alphabet": OP13_SQL,
}
