"""Named queries, each with its SQL twin."""
