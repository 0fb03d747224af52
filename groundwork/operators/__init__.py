"""DataFrame-to-DataFrame operators of evidence pipelines."""
