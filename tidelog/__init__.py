"""Analytics over append-only change logs of typed, multi-version resources."""
