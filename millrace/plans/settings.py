"""Preparation settings: a complete default and the merging of patches."""
from __future__ import annotations

import copy


def default_settings(target_is_class: bool = True) -> dict:
    # The published defaults.
    return {
        "Clean": {"trim": True, "case": "Keep as is", "to_num": True, "dups": True, "const": True, "max_missing": 60,
                  "drop_missing_target": True, "num_missing": "Median", "cat_missing": "Most common"},
        "Transform": {"outliers": "Leave as is", "out_cols": None, "skew": False, "skew_thr": 1.0,
                      "skew_method": "Log (log1p)", "drop": [], "corr": None},
        "Encode": {"low": "One-hot", "max_onehot": 10, "drop_first": True, "high": "Frequency", "dates": True,
                   "encode_target": target_is_class},
        "Scale": {"method": "Standard (z-score)", "cols": None},
    }


def merged(base: dict, patch: dict) -> dict:
    """base with patch laid over it: dicts by key, lists as ordered unions, other values replaced. Both stay as they are."""
    def over(old, new):
        if isinstance(old, dict) and isinstance(new, dict):
            return {k: over(old[k], new[k]) if k in old and k in new else copy.deepcopy(new.get(k, old.get(k))) for k in {**old, **new}}
        if isinstance(old, list) and isinstance(new, list):
            return copy.deepcopy(old) + [copy.deepcopy(x) for x in new if x not in old]
        return copy.deepcopy(new)

    return over(base, patch)
