"""Requests, and the engine that answers them."""
