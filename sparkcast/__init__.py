"""sparkcast: a Spark-native engine for regional event panels, region
matching, adjacency, forecasting, indicator reshaping and news-text prep.

Everything is expressed as DataFrame / Spark SQL / Structured Streaming /
Spark ML jobs; see README.md for the operator map.
"""

__version__ = "0.1.0"
