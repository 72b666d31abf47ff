"""Training-data operators.

One module per operator; :mod:`lectio.llm.queries` registers one query for
each.  Nothing else in the library imports this subpackage.
"""
