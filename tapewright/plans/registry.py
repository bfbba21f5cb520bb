"""All registered queries of the analytics engine: name -> (plan builder, checking SQL or None)."""

from __future__ import annotations

from tapewright.plans import advice_queries, board_queries, chart_queries, cross_queries, decision_queries, entity_queries, fold_queries, indicator_queries, level_queries, market_queries, more_queries, session_queries, signal_queries, state_queries, study_queries, tape_queries

FLAGSHIP = "bt_window_signals"
QUERIES: dict = {}
for module in (indicator_queries, signal_queries, cross_queries, study_queries, session_queries, decision_queries, chart_queries, level_queries, more_queries, advice_queries, market_queries, state_queries, tape_queries, fold_queries, entity_queries, board_queries):
    QUERIES |= module.QUERIES
