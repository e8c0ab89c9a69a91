"""DataFrame operators: features, splits, models, metrics and archive analytics."""
