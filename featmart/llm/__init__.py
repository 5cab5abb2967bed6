"""Training-data operators for text corpora: one module per operator, `queries` registers them.

Nothing outside this package imports it, apart from the guarded import of the driver entry module.
"""
