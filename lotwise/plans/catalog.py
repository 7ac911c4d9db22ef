"""All registered queries."""
from lotwise.plans import q_comps, q_extract, q_match, q_normalize, q_score, q_select, q_stream  # noqa: F401
from lotwise.plans.registry import ORACLE, QUERIES  # noqa: F401
