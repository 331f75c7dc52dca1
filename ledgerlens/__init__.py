"""ledgerlens: a Spark-native transaction-risk analytics library.

Every operator is a plain ``DataFrame -> DataFrame`` function built on
``pyspark.sql.functions``; Catalyst plans the work and AQE re-plans it at
run time.  Sub-packages:

* ``sources``   - reading driver tables, raw files, lake layers, sinks
* ``functions`` - reusable Column expressions (hashing, time, geo, text)
* ``operators`` - cleansing, features, graph, metrics, governance, audit, search, models
* ``plans``     - compositions (silver/gold ETL, training, scoring, end to end)
* ``oracle``    - DuckDB SQL used as the independent correctness oracle
"""

__all__ = ["session"]
