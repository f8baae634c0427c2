"""Column expressions.  All are built-ins, so they stay inside generated code."""
