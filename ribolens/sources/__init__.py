"""Readers and writers of sequence and alignment formats."""
