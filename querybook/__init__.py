"""The registered queries: an activity log derived from the ``events`` table, and what to ask it."""
