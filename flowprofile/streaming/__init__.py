"""Scoring flows as they arrive."""

from flowprofile.streaming.scoring import score_stream, score_with_bundle, write_batch, write_scores

__all__ = ["score_stream", "score_with_bundle", "write_batch", "write_scores"]
