"""Operations of a large-scale training-data pipeline, each one module.

Nothing else in the library imports this subpackage.
"""
