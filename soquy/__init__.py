"""Hospital cash-book, revenue and stock reports as Spark DataFrame functions."""
