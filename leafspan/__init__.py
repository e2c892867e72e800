"""leafspan: paged-document analytics expressed as Spark DataFrame plans."""
