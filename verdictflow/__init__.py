"""Spark jobs for forum posts whose verdict is voted on after they are written."""
