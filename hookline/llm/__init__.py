"""Training-data operators: one module per operator, ``queries`` registers them.

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its
queries when it is present.
"""
