"""Scalar functions as Columns; Arrow UDFs only where Unicode normal forms or offsets need them."""
