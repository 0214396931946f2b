"""quaver: timed-text and signal analytics as PySpark DataFrame operations.

Subpackages: ``functions`` (Column -> Column), ``operators`` (DataFrame -> DataFrame), ``sources``
(readers and writers of the lyric formats), ``plans`` (named queries with their SQL oracles),
``streaming`` (tap-to-time state) and the optional ``llm`` (training-data operations).
"""
