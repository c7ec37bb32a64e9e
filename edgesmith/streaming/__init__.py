"""No operator here is incremental: graphs are read whole. A ``foreachBatch`` caller can hand each batch's edges to the batch operators."""
