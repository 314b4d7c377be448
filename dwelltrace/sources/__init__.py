"""Readers: activity logs (batch and streaming), live events, rule and job configuration."""
