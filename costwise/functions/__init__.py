"""Row-level rules as Column builders: they compose in batch, SQL and streaming plans."""

from costwise.functions.answers import (  # noqa: F401
    consistency_fields,
    grade_consistency,
    grade_exact,
    last_integer,
)
from costwise.functions.buckets import (  # noqa: F401
    depth_from_bucket,
    depth_from_parameters,
    difficulty_bucket,
)
from costwise.functions.cost import (  # noqa: F401
    compact_dollars,
    efficiency,
    spend_units,
    to_dollars,
    waste_ratio,
    weighted_cost,
)
from costwise.functions.rounding import round6, round_sig  # noqa: F401
from costwise.functions.spec import split_spec  # noqa: F401
from costwise.functions.text import (  # noqa: F401
    any_leak,
    has_decomposition_marker,
    heuristic_tokens,
    leaked_values,
    utf8_bytes,
    word_count,
)
from costwise.functions.usage import block_usage, chat_usage  # noqa: F401
