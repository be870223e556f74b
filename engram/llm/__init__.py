"""Operators for preparing training data at corpus scale.

Nothing outside this package imports it; ``__spark_entry__.py`` adds its
queries when it can be imported.
"""
