"""Streaming: a fitted preparation plan is a pure projection, so it scores a
Structured Streaming DataFrame unchanged."""
