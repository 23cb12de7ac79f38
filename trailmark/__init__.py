"""Trailmark: DataFrame operators for event, trajectory and text-claim data on Spark."""
