"""Analytics and statistical learning as Spark plans.

``operators`` holds the data preparation, statistics and models, ``functions``
the column expressions they share, ``sources`` readers and writers, ``plans``
the registered queries with their SQL, ``streaming`` the scoring of streams.
"""
