"""From SQL text to DataFrames: lexer, parser, binder, planners of SELECT and of changes, EXPLAIN."""
