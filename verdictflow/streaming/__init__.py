"""The same jobs over post streams. Batches end in sinks that tolerate being repeated."""
