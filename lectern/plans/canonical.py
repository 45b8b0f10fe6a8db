"""Queries of the rule engine: one for each rule, one for each stage."""

from __future__ import annotations

from lectern.operators import rules

from .registry import query

for _name in [*rules.rules(rules.DUCK), *rules.CHAINS]:
    query(f"rule_{_name}", "v_entries", sql=rules.oracle([_name], "v_entries", "id"))(
        lambda t, n=_name: rules.apply(t, [n]).select("id", *rules.COLUMNS)
    )
for _stage, _names in rules.STAGES.items():
    query(f"canon_{_stage}", "v_entries", sql=rules.oracle(_names, "v_entries", "id"))(
        lambda t, s=_stage: rules.canonicalize(t, s).select("id", *rules.COLUMNS)
    )
