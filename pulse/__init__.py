"""Gameplay telemetry and game-content analytics on Spark DataFrames."""
