"""Cohort, utilisation-cost and time-to-event analytics as plain DataFrame functions."""
