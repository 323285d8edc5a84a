"""Training-data operators; ``catalog`` lists their queries."""
