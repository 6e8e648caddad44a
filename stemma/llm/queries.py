"""The queries of this folder, by name, and their SQL where SQL can say them."""

from __future__ import annotations

from .bpe import op6_bpe
from .brown import op7_brown
from .decontaminate import op8_decontaminate
from .licenses import op1_licenses
from .media import op5_media
from .near import op10_near
from .repeats import op2_repeats
from .secrets import op3_secrets
from .sharding import op9_shards
from .toxicity import op4_toxicity

QUERIES = {f.__name__: f for f in (op1_licenses, op2_repeats, op3_secrets, op4_toxicity, op5_media, op6_bpe, op7_brown, op8_decontaminate, op9_shards, op10_near)}
ORACLE_SQL: dict[str, str] = {}
