"""Compositions of operators: the lazily wired workbook, the batch refresh and the query catalog."""
