"""Cohort plans: cohort object, encounter variables, continuous metrics, registered queries."""
