"""SQL expressions as text: null rules, labels, dates and numbers.

Each function takes a column name or any SQL expression and returns an expression for
``selectExpr``, ``where`` or ``F.expr``. Only fixed values are written into the text; what a user
filters by is passed as a literal by ``operators.filters``.
"""
