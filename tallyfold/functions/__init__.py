"""Column expressions. All of them are native, so they stay inside codegen."""

from .conditions import (  # noqa: F401
    blank_to_null,
    count_where,
    is_in,
    longer_than,
    null_if_in,
)
from .numeric import (  # noqa: F401
    completed_years,
    cycle_position,
    finite_or_null,
    is_infinite,
    is_usable,
    rate_per,
    ratio,
    remap,
    round_to,
    weighted_sum,
)
