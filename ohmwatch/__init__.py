"""ohmwatch: asset-health analytics for fleets of power transformers on Spark.

Every public operator takes and returns DataFrames.  Rows are keyed by
``asset_id`` and ``ts``; series operators run on (asset, time block) groups of
bounded size, so one asset that owns a large share of all rows is still spread
over many tasks.
"""

__version__ = "0.1.0"
