"""Gridded, mesh, label-hierarchy and frame-stream analytics as Spark jobs."""
