"""ordertide: sales analytics on Spark DataFrames.

Every public function takes a DataFrame (plus plain parameters) and returns
a DataFrame, so results stay distributed and lazily planned by Catalyst.
Driver-side actions are small: one-row bounds (min/max dates, quantile
cutoffs, feature statistics) that become literals so predicates push down,
row counts for guards and size checks, and pyspark.ml model fitting, whose
model state (coefficients, cluster centres, encoder vocabulary) lives on the
driver as in any Spark ML job.
"""

__version__ = "0.1.0"
