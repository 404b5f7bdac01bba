"""Operators for training-data pipelines; nothing else in sparkloom imports this."""
