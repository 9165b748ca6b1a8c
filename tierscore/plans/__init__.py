"""Rule-based test inputs, the registered queries and their SQL counterparts."""
