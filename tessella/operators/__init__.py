"""DataFrame operators: jobs, filters, joins, selection, trees, summaries, rules, changes and arrays."""
