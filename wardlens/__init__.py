"""wardlens: procedure-anchored clinical cohort analytics as lazy Spark DataFrame operators.

Every public function takes and returns ``pyspark.sql.DataFrame`` objects and never
collects data to the driver; the caller triggers the single action.
"""

__version__ = "0.1.0"
