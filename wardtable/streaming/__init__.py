"""No streaming operator exists in the inventory.

The row-wise helpers of :mod:`wardtable.functions` and the projections of
:mod:`wardtable.operators.columns` are stateless, so they take a streaming
DataFrame as it is (``tests/test_streaming.py``); nothing else is needed here.
"""
