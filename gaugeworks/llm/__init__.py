"""Training-data operators: thirteen corpus-scale building blocks and their registered queries.

Nothing outside this subpackage imports it.  ``queries.py`` holds the thin
``opN_<name>`` queries; the other modules hold the operators themselves.
"""
