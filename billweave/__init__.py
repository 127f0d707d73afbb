"""billweave: a PySpark-native engine for invoice lines and catalogue text.

Every operator is a ``DataFrame -> DataFrame`` function; plans are declared with
DataFrame / SQL expressions so Catalyst can choose the physical strategy.
"""

__version__ = "0.1.0"
