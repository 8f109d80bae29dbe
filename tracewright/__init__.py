"""Trajectory, rollout and corpus analytics on Spark."""
