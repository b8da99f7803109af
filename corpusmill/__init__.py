"""corpusmill: DataFrame operators that prepare and audit language-model training corpora."""
