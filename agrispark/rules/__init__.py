"""Rule tables as data: limits, severities, actions, lexicon and text patterns."""
