"""Part of the trajectory analytics engine."""
