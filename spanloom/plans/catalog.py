"""All queries of the core, and the SQL that DuckDB runs beside them."""

from __future__ import annotations

from spanloom.operators import hotkeys
from spanloom.plans import queries as q
from spanloom.plans.sql import SQL as _SQL

QUERIES = {
    "tokenize_docs": q.tokenize_docs,
    "vocab_ids": q.vocab_ids,
    "corpus_prefix_limit": q.corpus_prefix_limit,
    "doc_offsets": q.doc_offsets,
    "corpus_stats": q.corpus_stats,
    "shard_meta": q.shard_meta,
    "unigram_counts": q._counts(1),
    "bigram_counts": q._counts(2),
    "trigram_counts": q._counts(3),
    "distinct_grams_by_depth": q.distinct_grams_by_depth,
    "next_tokens_of_prefix": q.next_tokens_of_prefix,
    "gram_intervals_d1": q._intervals(1),
    "gram_intervals_d2": q._intervals(2),
    "gram_intervals_d3": q._intervals(3),
    "query_windows": q.query_windows,
    "query_counts": q.query_counts,
    "query_intervals_absent": q.query_intervals_absent,
    "uncached_steps": q.uncached_steps,
    "fixed_cache_unigram": q._fixed(1),
    "fixed_cache_bigram": q._fixed(2),
    "fixed_cache_trigram": q._fixed(3),
    "fixed_cache_snapshot": q.fixed_cache_snapshot,
    "greedy_cache_floor0": q._greedy(0),
    "greedy_cache_floor2": q._greedy(2),
    "greedy_snapshots": q.greedy_snapshots,
    "longest_prefix_hit": q.longest_prefix_hit,
    "cached_resolve": q.cached_resolve,
    "steps_summary_fixed": q.steps_summary_fixed,
    "steps_summary_greedy": q.steps_summary_greedy,
    "steps_by_length": q.steps_by_length,
    "pareto_points": q.pareto_points,
    "fixed_vs_greedy_ratio": q.fixed_vs_greedy_ratio,
    "latency_set": q.latency_set,
    "exact_suffix_rank": q.exact_suffix_rank,
    "p1_found": hotkeys.p1_found,
    "p1_key_stats": hotkeys.p1_key_stats,
    "p1_key_totals": hotkeys.p1_key_totals,
}

SQL = {name: text for name, text in _SQL.items() if name in QUERIES}
