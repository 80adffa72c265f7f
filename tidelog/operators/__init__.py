"""Timeline, correlation, rules, memory, integrity and pivot operators."""
