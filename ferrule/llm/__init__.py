"""Training-data operators: ten corpus operators built on DataFrames and Arrow batches.

Nothing outside this subpackage imports it; ``registry`` lists its queries.
"""
