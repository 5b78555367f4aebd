"""DataFrame operators: features, detection, evaluation, incidents, routing and records."""
