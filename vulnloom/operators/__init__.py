"""DataFrame-to-DataFrame operators; every table is keyed by repo_id first."""
