"""ribolens: conserved-RNA-motif analytics as Spark DataFrame plans."""
