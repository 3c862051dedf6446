"""Spark ML classifiers, tuning over folds, and batch scoring."""
