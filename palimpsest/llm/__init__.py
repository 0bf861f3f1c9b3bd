"""Training-data operators: thirteen stand-alone components over text and web pages.

Nothing else in the package imports this subpackage.
"""
