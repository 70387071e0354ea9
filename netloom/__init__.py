"""Learning and scoring of Bayesian networks over Spark tables."""

__version__ = "0.1.0"
