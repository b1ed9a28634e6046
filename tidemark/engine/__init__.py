"""The SQL dialect, its tables and transactions, and the key-value store."""
