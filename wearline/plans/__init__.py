"""Multi-operator jobs: dataset building, training, scoring, retraining, queries."""
