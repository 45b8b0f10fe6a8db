"""Record linkage, data fusion and corpus preparation as Spark plans."""
