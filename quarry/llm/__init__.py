"""Operations of a training-data pipeline on Spark: thirteen operators over texts, conversations and vectors.

Nothing outside this subpackage imports it. ``queries`` registers the thin
``opN_<name>`` queries; every operator module has a general interface of its own.
"""
