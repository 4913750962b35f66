from riskframe.functions.rules import (recommendations, risk_tier, rule_messages,
                                      target_gate, with_rules)
from riskframe.functions.scalar import (clip, compare, duration_days, flag, in_range_or_null,
                                       is_missing, map_values, prefix_any, row_sum,
                                       strip_prefix, versioned_code_predicate)

__all__ = ["recommendations", "risk_tier", "rule_messages", "target_gate", "with_rules",
           "clip", "compare", "duration_days", "flag", "in_range_or_null", "is_missing",
           "map_values", "prefix_any", "row_sum", "strip_prefix", "versioned_code_predicate"]
