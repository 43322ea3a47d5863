"""Operations for large training-data pipelines, each by its own named method.

Nothing else in the library imports this subpackage; ``registry`` lists its
queries for the driver.
"""
