"""Table operators: counts, statistics, ranks, draws, comparisons."""
