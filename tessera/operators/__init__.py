"""DataFrame operators: tables, standardisation, search, joins, reconciliation, timelines."""
