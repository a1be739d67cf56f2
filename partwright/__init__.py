"""partwright: catalogue-data processing on PySpark.

Column expressions live in ``functions``, DataFrame operators in ``operators``, readers and
writers in ``sources``, streaming operators in ``streaming`` and the named queries with their
SQL in ``plans``.  The optional subpackage ``llm`` holds the operators for training text; nothing
else imports it.
"""
