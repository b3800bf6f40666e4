"""Incremental loading: files already seen are skipped, their rows stay."""
