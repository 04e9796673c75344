"""Readers of public recommendation data sets, and the driver's tables as interactions."""
