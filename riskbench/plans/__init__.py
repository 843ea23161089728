"""Evaluation runs, experiments, reports and batch scoring built from the operators."""
