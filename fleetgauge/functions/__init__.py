"""Expression helpers.

Each takes SQL expressions (a column name is one) and returns a SQL expression
for ``selectExpr``, ``expr`` or ``where``, so that helpers nest and a report
is analysed in one step instead of one step per operator.
"""
