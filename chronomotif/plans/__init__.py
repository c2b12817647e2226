"""Whole analyses: motif finding with its null model, and motif queries."""
