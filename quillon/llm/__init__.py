"""Operators for preparing language-model training data at corpus scale.

Each module holds one operator with a general interface.  ``registry`` holds
the thin queries registered with the driver and their SQL.  Nothing outside
this subpackage imports it.
"""
