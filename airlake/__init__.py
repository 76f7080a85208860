"""airlake: air-quality table and stream operators on Spark DataFrames.

Every operator is a plain ``DataFrame -> DataFrame`` function built from
Spark columns, joins, windows and aggregates, so Catalyst plans it and
Tungsten runs it. Python on executors appears only where a built-in
expression cannot state the semantics (route decoding, per-city model
fits, recursive forecasts, stateful alert streams).
"""

__version__ = "0.1.0"
