"""Relational operators over sequence, alignment, hit and motif tables."""
