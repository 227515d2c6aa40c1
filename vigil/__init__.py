"""Supervisory analytics as Spark jobs: intake, assessment, indicators, scoring, sampling and trends."""
