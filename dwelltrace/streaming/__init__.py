"""Structured Streaming jobs. All are stateless: no watermark, no shuffle, no state store."""
