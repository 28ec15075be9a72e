"""Registry of named queries and their SQL twins, collected from ``graniteflow.plans``."""

from __future__ import annotations

from graniteflow.plans import containing, content, events, exports, fusion, layout, ledgers, lists, made_up, marks, matching, merging, monitoring, nested, payloads, places, quantities, records, regions, rollups, rules, shapes, takeoff, tiers, tiling, workbooks

QUERIES: dict = {}
ORACLES: dict = {}
for _module in (takeoff, rollups, events, layout, records, content, matching, quantities, marks, tiling, merging, tiers, nested, lists, monitoring, regions, exports, payloads, ledgers, fusion, shapes, rules, containing, places, workbooks, made_up):
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
