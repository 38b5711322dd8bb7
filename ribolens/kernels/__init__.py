"""Small numeric routines that run inside tasks on one sequence, pair or alignment."""
