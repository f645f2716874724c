"""DataFrame operators over frames, regions, tracks and segments."""
