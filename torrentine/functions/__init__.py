"""Part of the torrentine engine."""
