"""Training-data operators: each module holds one operator, `queries` registers them.

Every operator takes a DataFrame and a text column and adds ONE struct column (``out``), so other
columns, whatever their names, pass through untouched; a column already called ``out`` is replaced.
"""
