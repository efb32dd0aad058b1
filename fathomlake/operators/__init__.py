"""Operators: from profiling and cleaning to models and their selection."""
