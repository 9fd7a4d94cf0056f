"""DataFrame-to-DataFrame steps the jobs are made of."""
