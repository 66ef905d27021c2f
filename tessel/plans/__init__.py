"""Query plans: registered queries, their SQL counterparts, staging and sessions."""
