"""noctua: set-at-a-time incident analytics on Spark.

Alarm correlation, ticket-volume deviation, vector and text ranking,
pattern memory custody and the evaluation harness, each expressed as a
DataFrame-in / DataFrame-out function over whole tables.
"""

__version__ = "0.1.0"
