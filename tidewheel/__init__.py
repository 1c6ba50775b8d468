"""Spark jobs for the data work around training and evaluating language-model agents."""
