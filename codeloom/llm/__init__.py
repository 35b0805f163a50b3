"""Operators for training data: each problem in its module, all queries in queries."""
