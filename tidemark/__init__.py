"""Down-sampling of reading streams into time buckets with per-key settings."""
