"""feedloom: Spark operators for overlapping record feeds.

Sub-packages
------------
functions   Column -> Column expressions (normalization, scoring, parsing)
operators   DataFrame -> DataFrame building blocks
sources     scans of landed files and the tables the operators write
streaming   the incremental form of the batch run
plans       whole jobs composed from operators, and the query catalogue
"""
