"""Streams of run events: the stateful folds of the batch operators, and plain streaming aggregates."""
