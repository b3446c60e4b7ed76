"""Tissue-imaging analytics as composable DataFrame operators on Spark."""
