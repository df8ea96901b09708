"""Training-data operators over document, page and vector tables.

Nothing else in the library imports this subpackage.  Each operator has a
module of its own with a general function and a thin ``opN_<name>`` query.
"""
