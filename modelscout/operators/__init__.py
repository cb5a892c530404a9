"""Table operators: profile, roles, charts, preparation, models, metrics, explanation."""
