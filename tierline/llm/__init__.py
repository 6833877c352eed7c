"""Training-data operators: one module per operator, each a Spark job over whole tables.

Nothing else in the package imports this subpackage.
"""
