"""Sequences of recordings: scored queues, routes, and sheets that explain them."""
