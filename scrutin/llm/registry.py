"""The queries of this package and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from .caps import OP2_SQL, op2_caps
from .codes import OP11_SQL, op11_codes
from .langid import op12_langid
from .mixing import OP4_SQL, op4_mixing
from .packing import op10_packing
from .pii import op7_pii
from .prefixes import OP13_SQL, op13_prefixes
from .quality import op5_quality
from .secrets import op9_secrets
from .simhash import op6_simhash
from .tokens import op1_tokens
from .topk import OP3_SQL, op3_topk
from .toxicity import op8_toxicity

QUERIES = {f.__name__: f for f in (op1_tokens, op2_caps, op3_topk, op4_mixing, op5_quality, op6_simhash, op7_pii, op8_toxicity, op9_secrets, op10_packing, op11_codes, op12_langid, op13_prefixes)}
#: The others are beyond SQL (trees, tries, fingerprints, positions in code points) and are tested by brute force.
SQL = {"op2_caps": OP2_SQL, "op3_topk": OP3_SQL, "op4_mixing": OP4_SQL, "op11_codes": OP11_SQL, "op13_prefixes": OP13_SQL}
