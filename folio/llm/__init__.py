"""Operations of a training-data pipeline over a corpus of documents.

Nothing else in the library imports this subpackage. Every operator takes
DataFrames and returns a DataFrame; what it needs between two jobs is a table
in the shared folder that `spark.checkpoint.dir` names.
"""
