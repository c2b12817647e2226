"""Relational operators over events, motifs and networks."""
