"""Structured Streaming: scoring of new rows with stored models.

The reference has no streaming operator (no watermark, window or state); the only
streaming-shaped need is scoring rows that arrive after training, which is stateless.
"""

from flawscope.streaming.scoring import start_scoring

__all__ = ["start_scoring"]
