"""Measurement-reliability analytics on PySpark.

From one fact table of scored measurements (clip x condition x model) the engine
derives condition-level error and confidence estimands over matching populations,
finds confidently wrong, silence-driven and mute conditions, compares models on common
cells, measures calibration, decomposes factorial experiments, profiles edits, detects
turn-taking faults and compares paired runs; all as DataFrame plans.
"""
