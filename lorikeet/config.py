"""Thresholds and sizes, in one place; every operator takes them as parameters."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    chunk_size: int = 512
    chunk_overlap: int = 128
    table_max_chars: int = 2000
    top_k: int = 12
    top_n: int = 6
    score_threshold: float = 0.3
    confidence_buffer: float = 0.15
    neighbour_radius: int = 2
    max_expanded: int = 30
    history_turns: int = 5
    history_tokens: int = 1500
    chars_per_token: int = 4
    narrative_tokens: int = 400
    narrative_chars_per_token: float = 3.5
    cache_ttl_s: int = 86_400
    intent_threshold: float = 0.6
    image_reject: float = 0.85
    rate_per_minute: int = 10
    breaker_failures: int = 5
    breaker_recovery_s: float = 30.0
    preview_chars: int = 300
    moderation_chars: int = 500
    max_images: int = 2
    max_image_bytes: int = 10 * 1024 * 1024
    max_image_side: int = 1280
    append_rows: int = 500
    embed_batch: int = 2048
    #: Stands over the context in a prompt; answers must not quote it.
    context_heading: str = "OFFICIAL INFORMATION"


DEFAULTS = Settings()
