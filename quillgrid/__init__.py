"""A document-layout and text analytics engine expressed as Spark DataFrame plans."""
