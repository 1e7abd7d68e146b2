"""Training-data operators: each module is one operator, `queries` registers them.

Nothing outside this subpackage imports it.  On a cluster ship the package with
``--py-files`` (or install it) so that executors can import it.
"""
