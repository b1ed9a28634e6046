"""Functions on values: intervals, log statements and log records."""
