"""Structured Streaming form of the flowsheet ETL.

The reference has no streaming operators; this package only runs the batch flowsheet ETL
(SNK-02) incrementally over a folder of arriving extract files.
"""
