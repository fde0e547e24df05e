"""Row-local, aggregate and corpus operators."""
