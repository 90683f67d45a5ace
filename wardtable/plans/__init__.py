"""Composite jobs: form tables to one wide table, and modelling runs on it."""
