"""Analytics over ragged scientific records and text corpora, as PySpark DataFrame jobs."""
