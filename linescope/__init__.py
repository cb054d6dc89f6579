"""Analytics over large tables of source functions, written as Spark DataFrame operators."""
