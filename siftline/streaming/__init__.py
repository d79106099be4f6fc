"""The ratchet over a stream of findings."""
