"""The metric registry and the plan that computes any selection of it."""
