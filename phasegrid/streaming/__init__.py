"""Scoring of arriving files; scoring is a stateless projection, so no operator differs from batch."""
