"""quire: document-structure analytics and training-data preparation on Spark."""
