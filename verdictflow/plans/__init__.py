"""The batch jobs, each a chain of operators with its writes at the end."""
