"""Expressions as SQL text.

Each function takes and returns SQL, to be used in ``selectExpr`` or ``F.expr``. Text composes
freely and reaches Spark in one piece, which keeps planning short even for wide records.
"""
