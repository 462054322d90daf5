"""The rule language: syntax trees, parser, interpreter, compiler to columns, static analysis."""
